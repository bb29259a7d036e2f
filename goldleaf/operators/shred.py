"""One wide policy row becomes a policy, its parties and the edges between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldleaf.functions import kernels as K
from goldleaf.model.registry import PERSON
from goldleaf.sources.mapping import FieldMapping, PartyMapping, SourceMapping
from goldleaf.tables import stored

IDENTITY_SEPARATOR = "\x1f"

#: Attributes whose presence makes an occurrence of a party the more complete one.
COMPLETENESS = ("date_of_birth", "email_normalized", "phone_e164", "address_key", "postal_code")
POLICY_SCOPED = ("role", "role_sequence", "policy_number_normalized", "stated_relationship")


@dataclass(frozen=True)
class Shredded:
    policies: DataFrame
    occurrences: DataFrame
    parties: DataFrame
    relationships: DataFrame


def transformed(field: FieldMapping, mapping: SourceMapping) -> Column:
    if field.literal is not None:
        return F.lit(field.literal)
    x = F.col(field.source).cast("string")
    match field.transform:
        case "text" | "name":
            return F.trim(x)
        case "email":
            return K.normalize_email(x)
        case "phone":
            return K.normalize_phone(x, mapping.default_country_code)
        case "policy_number":
            return K.normalize_policy_number(x)
        case "date":
            return K.parse_date(x, mapping.date_formats)
        case "money":
            return K.parse_money(x)
        case "integer":
            return K.parse_integer(x)
        case "boolean":
            return K.parse_boolean(x)
        case "enum":
            return K.normalize_enum(x, field.vocabulary)
    raise ValueError(f"unhandled transform {field.transform!r}")


def _passed(raw: DataFrame, mapping: SourceMapping) -> list[Column]:
    """The record id, and the time the source gives; null columns where the batch has none."""
    record = F.col("source_record_id") if "source_record_id" in raw.columns else F.lit(None)
    time = F.col(mapping.source_timestamp_field) if mapping.source_timestamp_field in raw.columns else F.lit(None)
    return [record.cast("string").alias("source_record_id"), time.cast("string").try_cast("timestamp").alias("source_timestamp")]


def policy_number(mapping: SourceMapping) -> Column:
    field = next(f for f in mapping.policy if f.canonical == "policy_number")
    return K.normalize_policy_number(F.col(field.source).cast("string"))


def shred_policies(raw: DataFrame, mapping: SourceMapping) -> DataFrame:
    """Policy rows, the first record of each (source, normalised number); blank numbers drop out."""
    plain = [(F.trim(F.col(f.source).cast("string")) if f.canonical == "policy_number" else transformed(f, mapping)).alias(f.canonical) for f in mapping.policy]
    rows = raw.select(*plain, policy_number(mapping).alias("policy_number_normalized"), F.lit(mapping.source_system).alias("source_system"), *_passed(raw, mapping))
    first = Window.partitionBy("source_system", "policy_number_normalized").orderBy(F.col("source_record_id").asc_nulls_last(), F.xxhash64(*rows.columns))
    rows = rows.where(K.filled(F.col("policy_number_normalized")))
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def _block(party: PartyMapping, mapping: SourceMapping, columns: list[str], optional: set[str]) -> Column:
    """The struct of one role; fields that its block doesn't map are null."""
    own = {f.canonical: transformed(f, mapping) for f in party.fields}
    fields = [own.get(c, F.lit(None)).cast(PERSON.by_name[c].spark_type).alias(c) for c in columns]
    stated = F.lit(None)
    if party.relationship_field and party.relationship_field not in optional:
        stated = F.nullif(F.upper(F.trim(F.col(party.relationship_field).cast("string"))), F.lit(""))
    return F.struct(
        *fields,
        F.trim(F.col(party.key_field).cast("string")).alias("source_party_key"),
        F.lit(party.key_kind).alias("source_key_kind"),
        F.lit(party.role).alias("role"),
        F.lit(party.role_sequence).cast("short").alias("role_sequence"),
        stated.cast("string").alias("stated_relationship"),
        F.lit("address_line1" in own or "address_line2" in own).alias("has_address"),
    )


def shred_parties(raw: DataFrame, mapping: SourceMapping) -> DataFrame:
    """One row for each party occurrence, of all roles in a single scan, with its derived keys.

    Occurrences with neither a key nor a name are dropped.
    """
    columns = [f.name for f in PERSON.fields if any(f.name in p.mapped for p in mapping.parties)]
    absent = set(mapping.missing_optional_columns(raw.columns))
    blocks = F.array(*(_block(p, mapping, columns, absent) for p in mapping.parties))
    beside = ("policy_number_normalized", "source_system", "source_record_id", "source_timestamp")
    # The array is a column first: a generator interprets the expression that it is given. The outer form, since
    # for the other one Spark computes the array once more, to see that it isn't empty.
    rows = raw.select(blocks.alias("__blocks"), policy_number(mapping).alias("policy_number_normalized"), F.lit(mapping.source_system).alias("source_system"), *_passed(raw, mapping))
    rows = rows.select(F.explode_outer("__blocks").alias("p"), *beside).select("p.*", *beside)
    rows = rows.where(K.filled(F.col("source_party_key")) | K.filled(F.col("full_name")))
    return with_party_keys(rows, mapping.default_country_code).drop("has_address")


def with_party_keys(rows: DataFrame, country_code: str) -> DataFrame:
    """The columns that matching derives from the raw ones, where these are there."""
    there = set(rows.columns)
    null = F.lit(None).cast("string")
    name = F.col("full_name_normalized")
    rows = rows.withColumn("__text", K.normalize_text(F.col("full_name")))
    rows = rows.withColumn("full_name_normalized", K.without_affixes(F.col("__text")))
    rows = rows.withColumns(
        {
            "name_tokens": K.name_tokens(name),
            "name_sorted_key": K.sorted_key(name),
            "name_phonetic_key": K.phonetic_key(name),
            "name_initials": K.initials(name),
            "name_prefix_derived": K.name_prefix(F.col("__text")),
            "name_suffix_derived": K.name_suffix(F.col("__text")),
            "email_normalized": K.normalize_email(F.col("email_address")) if "email_address" in there else null,
            "phone_e164": K.normalize_phone(F.col("phone_raw"), country_code) if "phone_raw" in there else null,
        }
    )
    rows = rows.drop("__text").withColumn("party_type", K.party_type(F.col("name_tokens")))
    simple = (F.col("party_type") == "PERSON") & (F.size("name_tokens") == 2)
    lines = [F.col(c) for c in ("address_line1", "address_line2") if c in there]
    mapped = F.col("has_address") if "has_address" in there else F.lit(True)
    address = F.when(mapped, K.normalize_address(*lines)) if lines and "postal_code" in there else null
    rows = rows.withColumns(
        {
            "given_name_derived": F.when(simple, F.get("name_tokens", F.lit(0))),
            "middle_name_derived": null,
            "surname_derived": F.when(simple, F.get("name_tokens", F.lit(1))),
            "name_parse_confidence": F.when(simple, 0.75).otherwise(0.0),
            "name_parse_method": F.when(simple, "RULE_BASED").otherwise("NOT_PARSED"),
            "address_normalized": address,
        }
    )
    key = K.address_key(F.col("address_normalized"), F.col("postal_code")) if "postal_code" in there else null
    return rows.withColumn("address_key", key)


def source_identity() -> Column:
    """What resolution takes for one party: system, kind of key and key.

    A party without a key is no other party's equal, so it is named by its record and role.
    """
    anonymous = F.concat_ws(":", F.lit("anonymous"), "source_record_id", "role")
    key = F.when(K.filled(F.col("source_party_key")), F.col("source_party_key")).otherwise(anonymous)
    return F.concat_ws(IDENTITY_SEPARATOR, "source_system", "source_key_kind", key)


def collapse_parties(occurrences: DataFrame) -> DataFrame:
    """One row for each source identity: of every column the first value by completeness and record.

    A single pass of partial aggregates; an agent who is on every policy is a row in each map task.
    """
    rows = occurrences.withColumn("person_id", source_identity())
    complete = sum((F.col(c).isNotNull().cast("int") for c in COMPLETENESS if c in rows.columns), F.lit(0))
    # One text that sorts like (completeness descending, record, role): cheaper to compare than a struct.
    rows = rows.withColumn("__order", F.concat_ws("\x1f", (len(COMPLETENESS) - complete).cast("string"), F.coalesce("source_record_id", F.lit("￿")), "role"))
    values = [c for c in rows.columns if c not in ("person_id", "__order", *POLICY_SCOPED)]
    return rows.groupBy("person_id").agg(*(F.expr(f"min_by(`{c}`, __order) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in values))


def shred_relationships(occurrences: DataFrame) -> DataFrame:
    """Party-to-policy edges of all occurrences, still with source keys."""
    return occurrences.select(
        F.lit("PARTY_POLICY").alias("edge_kind"),
        source_identity().alias("person_id"),
        "source_party_key",
        "source_key_kind",
        "policy_number_normalized",
        "role",
        "role_sequence",
        "stated_relationship",
        "source_system",
        "full_name_normalized",
    )


def shred(raw: DataFrame, mapping: SourceMapping) -> Shredded:
    """The three outputs; occurrences are computed once and stored, parties and edges read them."""
    occurrences = stored(shred_parties(raw, mapping), "occurrences")
    return Shredded(shred_policies(raw, mapping), occurrences, collapse_parties(occurrences), shred_relationships(occurrences))


def empty_shredded(spark, mapping: SourceMapping) -> DataFrame:
    """A batch of the mapping's shape without rows."""
    names = ["source_record_id", *mapping.source_columns, *mapping.optional_columns]
    return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))

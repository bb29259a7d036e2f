"""Read paths over the golden store: search, duplicate check, lineage, 360, overview and exports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldleaf.functions import kernels as K
from goldleaf.functions.kernels import filled
from goldleaf.model.registry import EntitySpec

from .blocking import KEYS
from .scoring import COMPARATORS, VETOES, score_attached
from .shred import with_party_keys

SEARCH_LIMIT, PROBE_LIMIT, MATCH_LIMIT, POLICY_LIMIT = 200, 200, 10, 500
MATCHED_ON = 0.99
# Births more than 366 days apart are vetoed; slots of pairs where a date is missing.
BIRTH_SLOT, ANY_BIRTH, NO_BIRTH = 367, -(2**31), 2**31 - 1


def mask(rows: DataFrame, entity: EntitySpec) -> DataFrame:
    """Direct and sensitive attributes as ``***``; nulls stay null, and no column goes."""
    hidden = {f.name for f in entity.fields if f.masked}
    return rows.select(*(F.when(F.col(c).isNotNull(), F.lit("***")).alias(c) if c in hidden else F.col(c) for c in rows.columns))


def search(persons: DataFrame, name: str | None = None, email: str | None = None, postal_code: str | None = None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Persons whose normalised name has the normalised term in it, and whose email and postcode are these."""
    rows = persons
    if name:
        rows = rows.where(F.contains("full_name_normalized", K.normalize_full_name(F.lit(name))))
    if email:
        rows = rows.where(F.col("email_normalized") == K.normalize_email(F.lit(email)))
    if postal_code:
        rows = rows.where(F.upper(F.replace("postal_code", F.lit(" "), F.lit(""))) == F.upper(F.replace(F.lit(postal_code), F.lit(" "), F.lit(""))))
    return rows.orderBy("full_name_normalized", "person_id").limit(min(limit, SEARCH_LIMIT))


def duplicate_check(probes: DataFrame, persons: DataFrame, country_code: str, probe_id: str = "probe_id", limit: int = MATCH_LIMIT) -> DataFrame:
    """For each probe the best matches among persons: zone, score and the attributes that they agree on.

    Probes (probe_id, full_name, email_address, phone_raw, date_of_birth, address_line1, postal_code, ...)
    get the batch's own kernels and country code; a person is a candidate through any shared key.

    Keys carry their attributes, so a pair is scored where it meets and never shuffled: each task passes on
    its best ``limit`` of a probe. What a veto rules out doesn't meet, and a pair that shares several keys is
    scored under the first.
    """
    keyed = with_party_keys(probes, country_code).withColumnRenamed(probe_id, "person_id")
    compared = dict.fromkeys([*(c[0] for c in COMPARATORS.values()), *(v[0] for v in VETOES.values())])
    columns = [c for c in compared if c in keyed.columns and c in persons.columns]
    kinds = [c for c in KEYS.values() if c in columns]
    asked, there = _met(keyed, "left", columns, kinds), _met(persons, "right", columns, kinds)
    pairs = asked.join(there, ["kind", "key", "slot"])
    shared = [filled(F.col(f"l_{c}")) & (F.col(f"l_{c}") == F.col(f"r_{c}")) for c in kinds]
    first = F.coalesce(*(F.when(same, n) for n, same in enumerate(shared)))
    vetoed = [F.coalesce(conflict(F.col(f"l_{c}"), F.col(f"r_{c}")), F.lit(False)) for c, conflict in VETOES.values() if c in columns]
    pairs = pairs.where(first == F.col("kind")).where(~reduce(Column.__or__, vetoed, F.lit(False))).drop("kind", "key", "slot")
    # A number that isn't determined by the row keeps the filter above the scores, else it repeats them all.
    scored = score_attached(pairs).withColumn("__n", F.monotonically_increasing_id()).where("zone <> 'AUTO_REJECT' AND __n >= 0")
    agreed = F.concat_ws("+", *(F.when(F.col(c) >= MATCHED_ON, c[4:]) for c in scored.columns if c.startswith("cmp_")))
    listed = scored.select("left_id", "right_id", "score", "zone", agreed.alias("matched_on"))
    order = Window.partitionBy("left_id").orderBy(F.col("score").desc(), F.col("right_id").desc())
    best = listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return best.select(F.col("left_id").alias(probe_id), F.col("right_id").alias("person_id"), "score", "zone", "matched_on")


def _met(rows: DataFrame, side: str, columns: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """A row for each key and slot, with the attributes of its side.

    Births further apart than BIRTH_SLOT days don't match, so a date meets its own slot and the two beside
    it; who has none meets everybody. Every pair meets in one slot at most.
    """
    attributes = [F.col(c).alias(f"{side[0]}_{c}") for c in columns]
    keys = F.array(*(F.struct(F.lit(n).alias("kind"), F.col(c).alias("key")) for n, c in enumerate(kinds)))
    met = rows.select(F.col("person_id").alias(f"{side}_id"), *attributes, F.inline(keys)).where(filled(F.col("key")))
    anybody, nobody = F.lit(ANY_BIRTH), F.lit(NO_BIRTH)
    if "date_of_birth" not in columns:
        return met.withColumn("slot", anybody)
    born = F.col(f"{side[0]}_date_of_birth")
    slot = F.floor(F.datediff(born, F.lit("1970-01-01").cast("date")) / BIRTH_SLOT).cast("int")
    if side == "left":
        slots = F.when(born.isNull(), F.array(anybody)).otherwise(F.array(slot - 1, slot, slot + 1, nobody))
    else:
        slots = F.array(anybody, F.coalesce(slot, nobody))
    return met.withColumn("slot", F.explode(slots))


def lineage(crosswalk: DataFrame, provenance: DataFrame, golden_id: str | Column) -> DataFrame:
    """The source keys of a golden id and what they decided, by system and key."""
    own = crosswalk.where(F.col("golden_id") == golden_id)
    return own.join(provenance.withColumnRenamed("master_id", "golden_id"), "golden_id", "left").orderBy("source_system", "source_party_key", "attribute_name")


def policies_of(edges: DataFrame, policies: DataFrame, limit: int = POLICY_LIMIT) -> DataFrame:
    """edges ⋈ policies, newest first within each party, at most ``limit`` each."""
    joined = edges.join(policies, "policy_id")
    order = Window.partitionBy("person_id").orderBy(F.col("effective_date").desc_nulls_last(), "policy_id", "role")
    return joined.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def counterparties(edges: DataFrame) -> DataFrame:
    """person_id, other_id, shared_policies: who is on the same policies."""
    mine = edges.select("person_id", "policy_id").distinct()
    other = mine.withColumnRenamed("person_id", "other_id")
    return mine.join(other, "policy_id").where("person_id <> other_id").groupBy("person_id", "other_id").agg(F.count(F.lit(1)).alias("shared_policies"))


def version_history(history: DataFrame, key: str, value: str, limit: int = 20) -> DataFrame:
    """The newest versions of one entity."""
    return history.where(F.col(key) == value).orderBy(F.col("version").desc()).limit(limit)


def customer_360(golden_id: str, person: DataFrame, crosswalk: DataFrame, provenance: DataFrame, edges: DataFrame, policies: DataFrame, memberships: DataFrame, relations: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """Everything about one party, each part a frame: record, policies, counterparties, sources, household, ..."""
    mine = edges.where(F.col("person_id") == golden_id)
    shared = edges.join(mine.select("policy_id").distinct(), "policy_id", "left_semi").where(F.col("person_id") != golden_id)
    home = memberships.where((F.col("person_id") == golden_id) & F.col("household_id").isNotNull()).select("household_id")
    return {
        "record": person.where((F.col("person_id") == golden_id) & F.col("is_current")),
        "policies": policies_of(mine, policies),
        "counterparties": shared.groupBy("person_id").agg(F.countDistinct("policy_id").alias("shared_policies")).orderBy(F.col("shared_policies").desc(), "person_id"),
        "sources": crosswalk.where(F.col("golden_id") == golden_id),
        "provenance": provenance.where(F.col("master_id") == golden_id),
        "versions": version_history(person, "person_id", golden_id),
        "household": memberships.join(home, "household_id", "left_semi"),
        "relations": relations.where(F.col("person_id") == golden_id).withColumn("label", K.relation_label(F.col("association_type"), F.col("outgoing"))),
        "considered": pairs.where((F.col("left_id") == golden_id) | (F.col("right_id") == golden_id)).orderBy(F.col("score").desc()).limit(25),
    }


def total_sum_assured(edges: DataFrame, policies: DataFrame) -> DataFrame:
    """person_id, total: over policies that the party owns or is insured by, each once."""
    mine = edges.where(K.role_group(F.col("role")).isin("owns", "insured")).select("person_id", "policy_id").distinct()
    return mine.join(policies.select("policy_id", "sum_assured_amount"), "policy_id").groupBy("person_id").agg(F.sum("sum_assured_amount").alias("total_sum_assured"))


def overview(tables: dict[str, DataFrame], breakdowns: Sequence[tuple[str, str]]) -> DataFrame:
    """entity, dimension, value, n: row counts of the tables and of the values of some columns."""
    parts = [df.agg(F.lit(name).alias("entity"), F.lit("rows").alias("dimension"), F.lit("").alias("value"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    for name, column in breakdowns:
        counted = tables[name].groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(none)")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(counted.select(F.lit(name).alias("entity"), F.lit(column).alias("dimension"), "value", "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def browse(rows: DataFrame, key: str, page: int, size: int) -> DataFrame:
    return rows.orderBy(key).offset(page * size).limit(size)


def flat(rows: DataFrame) -> DataFrame:
    """Every column as text for a delimited file: arrays joined by '|', nulls empty."""
    kinds = dict(rows.dtypes)
    text = {c: F.concat_ws("|", F.col(c)) if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns}
    return rows.select(*(x.alias(c) for c, x in text.items()))


def export_entity(rows: DataFrame, entity: EntitySpec, unmask: bool = False) -> DataFrame:
    """What an export file holds; write it with ``.write.option('header', True).csv(path)``."""
    return flat(rows if unmask else mask(rows, entity))


def export_source_shaped(delivered: DataFrame, policy_ids: DataFrame, party_ids: DataFrame, number: Column, keys: dict[str, str]) -> DataFrame:
    """The delivered rows, none more or fewer, with PolicyMdmId and an id for each role.

    ``policy_ids`` (policy_number_normalized, policy_id) and ``party_ids`` (source_party_key,
    golden_id) have one row for each key; ``keys`` names the key column of each role.
    """
    out = delivered.withColumn("__number", number).join(policy_ids.select(F.col("policy_number_normalized").alias("__number"), F.col("policy_id").alias("PolicyMdmId")), "__number", "left").drop("__number")
    for role, column in keys.items():
        own = party_ids.select(F.col("source_party_key").alias("__key"), F.col("golden_id").alias(f"{role.title()}MdmId"))
        out = out.join(own, F.trim(F.col(column)) == F.col("__key"), "left").drop("__key")
    return out


def with_golden_values(shaped: DataFrame, persons: DataFrame, role: str, columns: dict[str, str]) -> DataFrame:
    """A source-shaped export with a role's delivered columns replaced by the golden record's, where it has one.

    ``columns`` names the attribute for each delivered column; rows stay one for one.
    """
    golden = persons.where("is_current").select(F.col("person_id").alias("__id"), *(F.col(a).cast("string").alias(f"__{c}") for c, a in columns.items()))
    joined = shaped.join(golden, shaped[f"{role.title()}MdmId"] == golden["__id"], "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop("__id", *(f"__{c}" for c in columns))


__all__ = ["KEYS", "browse", "counterparties", "customer_360", "duplicate_check", "export_entity", "export_source_shaped", "flat", "lineage", "mask", "overview", "policies_of", "search", "total_sum_assured", "version_history", "with_golden_values"]

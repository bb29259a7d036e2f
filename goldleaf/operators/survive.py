"""Survivorship: one golden value for each attribute by its declared strategy, and where it came from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldleaf.model.registry import EntitySpec, FieldSpec

DEFAULT_TRUST = 0.5
MAX_REJECTED = 20
RANKED = ("MOST_RECENT", "MOST_TRUSTED_SOURCE", "MOST_COMPLETE", "MOST_FREQUENT", "FIRST_NON_NULL", "DERIVED", "SYSTEM")


def trust(weights: Mapping[str, float] | None, column: str = "source_system") -> Column:
    """A source's weight, or the default."""
    if not weights:
        return F.lit(DEFAULT_TRUST)
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.col(column)), F.lit(DEFAULT_TRUST))


def contributor(columns: Sequence[str]) -> Column:
    """The composite key that settles ties, whatever order the rows come in."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_system", "source_key_kind", "source_party_key", "source_record_id") if c in columns]
    return F.concat_ws("\x1f", *parts)


def _frequency(name: str) -> str:
    return f"__n_{name}"


def _order(spec: FieldSpec) -> Column:
    """What the strategy ranks contributors by, least first; nulls rank least."""
    last = [F.col("__tie")]
    match spec.survivorship:
        case "MOST_RECENT":
            first = [F.col("__time"), F.col("__trust")]
        case "MOST_TRUSTED_SOURCE":
            first = [F.col("__trust"), F.col("__time")]
        case "MOST_COMPLETE":
            first = [F.coalesce(F.length(F.col(spec.name).cast("string")), F.lit(0)), F.col("__trust")]
        case "MOST_FREQUENT":
            first = [F.col(_frequency(spec.name)), F.col("__trust")]
        case _:
            first = [F.col("__trust")]
    return F.struct(*(c.alias(f"o{n}") for n, c in enumerate(first + last)))


def golden_value(spec: FieldSpec, parent: FieldSpec | None = None) -> Column:
    """The aggregate that survives: a derived field follows the contributor that won its parent."""
    column = F.col(spec.name)
    if parent is not None:
        order = F.when(F.col(parent.name).isNotNull(), _order(parent))
        return F.max_by(F.struct(column.alias("v")), order)["v"]
    match spec.survivorship:
        case "AGGREGATE_MAX":
            return F.max(column)
        case "AGGREGATE_MIN":
            return F.min(column)
        case "ANY_TRUE":
            return F.bool_or(F.coalesce(column, F.lit(False)))
    return F.max_by(column, F.when(column.isNotNull(), _order(spec)))


def _prepared(contributors: DataFrame, fields: Sequence[FieldSpec], weights: Mapping[str, float] | None, master: str) -> DataFrame:
    there = set(contributors.columns)
    rows = contributors.withColumns(
        {
            "__trust": trust(weights) if "source_system" in there else F.lit(DEFAULT_TRUST),
            "__time": F.col("source_timestamp") if "source_timestamp" in there else F.lit(None).cast("timestamp"),
            "__tie": contributor(contributors.columns),
        }
    )
    rows = rows.repartition(master)  # one exchange for all that follows: the votes and the aggregate
    voted = [f.name for f in fields if f.survivorship == "MOST_FREQUENT"]
    return rows.withColumns({_frequency(c): F.count(F.lit(1)).over(Window.partitionBy(master, c)) for c in voted}) if voted else rows


def surviving_fields(entity: EntitySpec, columns: Sequence[str]) -> list[FieldSpec]:
    """The fields that contributors bring and the system doesn't keep itself."""
    there = set(columns)
    return [f for f in entity.fields if f.name in there and f.survivorship != "SYSTEM"]


def survive(contributors: DataFrame, entity: EntitySpec, weights: Mapping[str, float] | None = None, master: str = "master_id") -> DataFrame:
    """One golden row for each master id, with source_count, contributing_records and contributing_sources."""
    fields = surviving_fields(entity, contributors.columns)
    there = {f.name: f for f in fields}
    rows = _prepared(contributors, fields, weights, master)
    values = [golden_value(f, there.get(f.derived_from)).alias(f.name) for f in fields]
    evidence = [
        F.count(F.lit(1)).cast("int").alias("source_count"),
        F.array_sort(F.collect_set("source_record_id")).alias("contributing_records"),
        F.array_sort(F.collect_set("source_system")).alias("contributing_sources"),
    ]
    return rows.groupBy(master).agg(*values, *evidence)


def provenance(contributors: DataFrame, golden: DataFrame, entity: EntitySpec, master: str = "master_id") -> DataFrame:
    """One row for each attribute that the contributors of a master dispute.

    The attributes become rows once, so that all are compared in one join and one aggregate. Values
    are compared without regard to case or outer blanks; the winner is the first such contributor by
    the tie-break key; at most 20 losers are listed, in that order too.
    """
    fields = [f for f in surviving_fields(entity, contributors.columns) if not f.logical.startswith("LIST")]
    strategy = F.create_map(*(F.lit(x) for f in fields for x in (f.name, f.survivorship)))

    def long(df: DataFrame, value: str, *carry: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(f.name).alias("attribute_name"), F.col(f.name).cast("string").alias(value)) for f in fields))
        return df.select(master, *carry, pairs.alias("__pairs")).select(master, *carry, F.inline_outer("__pairs"))

    rows = contributors.withColumn("__tie", contributor(contributors.columns))
    told = long(rows, "value", "source_record_id", "source_system", "__tie").where("value IS NOT NULL")
    won = long(golden, "value_text")
    same = F.lower(F.trim(F.col("value"))) == F.lower(F.trim(F.col("value_text")))
    joined = told.join(won, [master, "attribute_name"]).withColumn("__same", F.coalesce(same, F.lit(False)))
    winner = F.min_by(F.struct("source_record_id", "source_system"), F.when(F.col("__same"), F.col("__tie")))
    lost = F.array_sort(F.collect_list(F.when(~F.col("__same"), F.struct("__tie", "value", "source_system", "source_record_id"))))
    grouped = joined.groupBy(master, "attribute_name").agg(
        winner.alias("w"), F.max("value_text").alias("value_text"), F.countDistinct("value").alias("candidate_count"), lost.alias("lost")
    )
    shown = F.transform(F.slice("lost", 1, MAX_REJECTED), lambda x: F.struct(x["value"].alias("value"), x["source_system"].alias("source"), x["source_record_id"].alias("record")))
    return grouped.where("candidate_count > 1").select(
        master,
        "attribute_name",
        strategy[F.col("attribute_name")].alias("strategy"),
        F.col("w.source_record_id").alias("winning_source_record_id"),
        F.col("w.source_system").alias("winning_source_system"),
        "value_text",
        "candidate_count",
        F.to_json(shown).alias("rejected_values"),
    )


def provenance_rows(disputed: DataFrame, landed: DataFrame) -> DataFrame:
    """Provenance to append: rows whose winning record has landed, or that name none."""
    known = landed.select(F.col("source_record_id").alias("winning_source_record_id")).distinct()
    named = disputed.where("winning_source_record_id IS NOT NULL").join(known, "winning_source_record_id", "left_semi").select(*disputed.columns)
    return named.unionByName(disputed.where("winning_source_record_id IS NULL"))


def report(contributors: DataFrame, golden: DataFrame, disputed: DataFrame, entity: EntitySpec) -> DataFrame:
    """entities, contributors, attributes, contested_attributes, contested_rate in one row."""
    n = len(surviving_fields(entity, contributors.columns))
    counts = [df.agg(F.count(F.lit(1)).alias(name)) for df, name in ((golden, "entities"), (contributors, "contributors"), (disputed, "contested_attributes"))]
    row = reduce(lambda a, b: a.crossJoin(b), counts).withColumn("attributes", F.col("entities") * n)
    rate = F.when(F.col("attributes") > 0, F.round(F.col("contested_attributes") / F.col("attributes"), 6)).otherwise(0.0)
    return row.select("entities", "contributors", "attributes", "contested_attributes", rate.alias("contested_rate"))

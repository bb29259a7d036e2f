"""Quality of matching and of data, and the operational snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _choose2(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def pairwise_quality(assignments: DataFrame, labels: DataFrame, id_column: str = "person_id") -> DataFrame:
    """true/false positives and negatives among pairs, precision, recall and F1, in one row.

    Pairs are counted from the sizes of clusters, truths and their intersections, never enumerated.
    """
    both = assignments.select(id_column, "master_id").join(labels.select(id_column, "true_id"), id_column)
    cells = both.groupBy("master_id", "true_id").agg(F.count(F.lit(1)).alias("n"))
    hit = cells.agg(F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0)).alias("true_positives"))
    said = cells.groupBy("master_id").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0)).alias("predicted"))
    true = cells.groupBy("true_id").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0)).alias("actual"))
    row = hit.crossJoin(said).crossJoin(true)
    precision = F.when(F.col("predicted") > 0, F.col("true_positives") / F.col("predicted")).otherwise(1.0)
    recall = F.when(F.col("actual") > 0, F.col("true_positives") / F.col("actual")).otherwise(1.0)
    row = row.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return row.select(
        "true_positives", (F.col("predicted") - F.col("true_positives")).alias("false_positives"), (F.col("actual") - F.col("true_positives")).alias("false_negatives"),
        F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"),
    )


def wrong_clusters(assignments: DataFrame, labels: DataFrame, id_column: str = "person_id") -> DataFrame:
    """master_id, truths, members of clusters that join more than one truth."""
    both = assignments.join(labels, id_column)
    return both.groupBy("master_id").agg(F.countDistinct("true_id").alias("truths"), F.count(F.lit(1)).alias("members")).where("truths > 1")


def blocking_recall(pairs: DataFrame, labels: DataFrame, id_column: str = "person_id") -> DataFrame:
    """blocked, actual, blocking_recall over the true pairs, in one row."""
    left, right = (labels.select(F.col(id_column).alias(f"{s}_id"), F.col("true_id").alias(f"{s}_true")) for s in ("left", "right"))
    hit = pairs.join(left, "left_id").join(right, "right_id").where("left_true = right_true").agg(F.count(F.lit(1)).alias("blocked"))
    actual = labels.groupBy("true_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(_choose2(F.col("n"))), F.lit(0)).alias("actual"))
    row = hit.crossJoin(actual)
    return row.select("blocked", "actual", F.when(F.col("actual") > 0, F.round(F.col("blocked") / F.col("actual"), 6)).otherwise(1.0).alias("blocking_recall"))


def data_quality(rows: DataFrame, conforms: Mapping[str, Column], columns: Sequence[str]) -> DataFrame:
    """attribute, completeness, conformity (of what is there): one pass, then one row each."""
    aggregates = []
    for c in columns:
        there = F.length(F.col(c).cast("string")) > 0
        ok = conforms.get(c)
        aggregates.append(F.struct(
            F.lit(c).alias("attribute"),
            F.round(F.avg(F.coalesce(there, F.lit(False)).cast("double")), 6).alias("completeness"),
            (F.round(F.avg(F.when(there, F.coalesce(ok, F.lit(False)).cast("double"))), 6) if ok is not None else F.lit(None).cast("double")).alias("conformity"),
        ))
    return rows.agg(F.array(*aggregates).alias("a")).select(F.inline("a"))


def duplication(parties: DataFrame, assignments: DataFrame) -> DataFrame:
    """source_records, golden_records, duplication_rate in one row."""
    row = assignments.agg(F.count(F.lit(1)).alias("source_records"), F.countDistinct("master_id").alias("golden_records"))
    return row.withColumn("duplication_rate", F.when(F.col("source_records") > 0, F.round(1 - F.col("golden_records") / F.col("source_records"), 6)).otherwise(0.0))


def stale_key_kinds(crosswalk: DataFrame, declared: DataFrame) -> DataFrame:
    """source_system, source_key_kind, n of crosswalk rows whose kind no mapping declares any more."""
    kinds = crosswalk.groupBy("source_system", "source_key_kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(declared, ["source_system", "source_key_kind"], "left_anti")


def prometheus(metrics: Mapping[str, float | int | None], prefix: str = "goldleaf") -> str:
    """A one-row frame's values (``df.first().asDict()``) in the text exposition format."""
    lines = []
    for name, value in sorted(metrics.items()):
        if value is not None:
            lines += [f"# TYPE {prefix}_{name} gauge", f"{prefix}_{name} {value}"]
    return "\n".join(lines) + "\n"

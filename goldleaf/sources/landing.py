"""Batches: read as text, checked against their mapping, landed once, and read back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldleaf.functions import kernels as K

from .mapping import SourceMapping

MAX_BLANK_SHARE = 0.20
SPARSE_PARTY_SHARE = 0.5
DATE_WARNING, DATE_ERROR = 0.95, 0.50
NEWEST = 200_000


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A delivered file, every column as text by its declared name; nothing is inferred."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def _present(column: str) -> Column:
    return F.length(F.trim(F.col(column).cast("string"))) > 0


def _date_fields(mapping: SourceMapping) -> list[str]:
    fields = [*mapping.policy, *(f for p in mapping.parties for f in p.fields)]
    return list(dict.fromkeys(f.source for f in fields if f.transform == "date" and f.source))


def profile(raw: DataFrame, mapping: SourceMapping) -> DataFrame:
    """Every count that the checks need, from one pass, in one row."""
    number = next(f.source for f in mapping.policy if f.canonical == "policy_number")
    counts = [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.coalesce(_present(number), F.lit(False))).alias("blank_numbers"),
        (F.count_distinct(K.normalize_policy_number(F.col(number).cast("string"))) + F.max(F.when(F.col(number).isNull(), 1).otherwise(0))).alias("distinct_numbers"),
    ]
    for party in mapping.parties:
        name = next(f.source for f in party.fields if f.canonical == "full_name")
        counts.append(F.count_if(_present(name)).alias(f"named_{party.role}"))
    for column in _date_fields(mapping):
        counts.append(F.count_if(_present(column)).alias(f"dated_{column}"))
        counts.append(F.count(K.parse_date(F.col(column).cast("string"), mapping.date_formats)).alias(f"parsed_{column}"))
    return raw.agg(*counts)


ISSUES = "array<struct<severity: string, code: string, column: string, row_count: bigint>>"


def validate_batch(raw: DataFrame, mapping: SourceMapping) -> DataFrame:
    """severity, code, column, row_count of each issue; missing columns end the checks."""
    spark = raw.sparkSession
    missing = mapping.missing_columns(raw.columns)
    if missing:
        issues = [("ERROR", "MISSING_COLUMNS", ", ".join(missing))]
        listed = spark.createDataFrame(issues, "severity string, code string, column string")
        return listed.crossJoin(raw.agg(F.count(F.lit(1)).alias("row_count")))
    number = next(f.source for f in mapping.policy if f.canonical == "policy_number")
    rows = F.col("rows")

    def issue(when: Column, severity: Column | str, code: str, column: str | None, n: Column) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.when((rows > 0) & when, F.struct(level.alias("severity"), F.lit(code).alias("code"), F.lit(column).cast("string").alias("column"), n.cast("bigint").alias("row_count")))

    blank, repeats = F.col("blank_numbers"), rows - F.col("distinct_numbers")
    found = [
        F.when(rows == 0, F.struct(F.lit("ERROR").alias("severity"), F.lit("EMPTY_BATCH").alias("code"), F.lit(None).cast("string").alias("column"), F.lit(0).cast("bigint").alias("row_count"))),
        issue(blank > 0, F.when(blank > rows * MAX_BLANK_SHARE, "ERROR").otherwise("WARNING"), "BLANK_POLICY_NUMBER", number, blank),
        issue(repeats > 0, "WARNING", "DUPLICATE_POLICY_NUMBERS", number, repeats),
    ]
    absent = mapping.missing_optional_columns(raw.columns)
    if absent:
        found.append(issue(F.lit(True), "WARNING", "MISSING_OPTIONAL_COLUMNS", ", ".join(absent), rows))
    for party in mapping.parties:
        name, named = next(f.source for f in party.fields if f.canonical == "full_name"), F.col(f"named_{party.role}")
        found.append(issue(named == 0, "ERROR", "EMPTY_PARTY_BLOCK", name, rows))
        found.append(issue((named > 0) & (named < rows * SPARSE_PARTY_SHARE), "WARNING", "SPARSE_PARTY_BLOCK", name, rows - named))
    for column in _date_fields(mapping):
        there, parsed = F.col(f"dated_{column}"), F.col(f"parsed_{column}")
        found.append(issue(parsed < there * DATE_WARNING, F.when(parsed < there * DATE_ERROR, "ERROR").otherwise("WARNING"), "DATE_FORMAT_MISMATCH", column, there - parsed))
    listed = F.filter(F.array(*found), lambda x: x.isNotNull())
    return profile(raw, mapping).select(F.inline(listed))


def content_hash(payload: DataFrame, columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*(F.col(c).cast("string") for c in columns)), {"ignoreNullFields": "false"}), 256)


def landing_rows(raw: DataFrame, mapping: SourceMapping, batch_id: str, now: str) -> DataFrame:
    """The batch as landing records: mapped columns only, as JSON, with a hash of their content.

    The row key is the normalised policy number; of rows with one key the first by content lands, and
    rows without a number land each by its own content.
    """
    columns = [c for c in [*mapping.source_columns, *mapping.optional_columns] if c in raw.columns]
    number = next(f.source for f in mapping.policy if f.canonical == "policy_number")
    rows = raw.select(
        F.lit(mapping.source_system).alias("source_system"),
        F.lit(batch_id).alias("batch_id"),
        F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in columns)), {"ignoreNullFields": "false"}).alias("payload"),
        content_hash(raw, columns).alias("payload_hash"),
        K.normalize_policy_number(F.col(number).cast("string")).alias("__number"),
        F.lit(now).cast("timestamp").alias("ingested_at"),
    )
    rows = rows.withColumn("source_row_key", F.when(K.filled(F.col("__number")), F.col("__number")).otherwise(F.concat(F.lit("blank:"), F.col("payload_hash")))).drop("__number")
    first = Window.partitionBy("source_system", "batch_id", "source_row_key").orderBy("payload_hash")
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return rows.withColumn("source_record_id", F.substring(F.sha2(F.concat_ws("\x1f", "source_system", "batch_id", "source_row_key"), 256), 1, 32))


def land(landed: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Rows to append: those whose (source, batch, key) hasn't landed yet."""
    if landed is None:
        return rows
    return rows.join(landed.select("source_system", "batch_id", "source_row_key"), ["source_system", "batch_id", "source_row_key"], "left_anti")


def batch_hash(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """batch_hash in one row: equal for the same rows in any order, so a redelivery is known."""
    h = content_hash(raw, columns)
    parts = [F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(20,0)") for at in (1, 13, 25)]
    return raw.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)), *(F.coalesce(F.sum(p), F.lit(0)) for p in parts)), 256).alias("batch_hash"))


def read_batch(landed: DataFrame, mapping: SourceMapping, batch_id: str | None = None) -> DataFrame:
    """Landed records in the shape of the source, with their record id; of one batch or of all."""
    columns = [*mapping.source_columns, *mapping.optional_columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = landed.where(F.col("source_system") == mapping.source_system)
    rows = rows.where(F.col("batch_id") == batch_id) if batch_id is not None else rows
    return rows.select("source_record_id", F.from_json("payload", schema).alias("p")).select("source_record_id", "p.*")


def newest(landed: DataFrame, limit: int = NEWEST) -> DataFrame:
    """The newest records: a top-k, for work that looks at recent deliveries only."""
    return landed.orderBy(F.col("ingested_at").desc(), "source_record_id").limit(limit)


def accept_batch(landed: DataFrame | None, raw: DataFrame, mapping: SourceMapping, batch_id: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(issues, rows to append): nothing is landed where any issue is an error."""
    issues = validate_batch(raw, mapping)
    if not issues.where("severity = 'ERROR'").isEmpty():
        schema = landing_rows(raw, mapping, batch_id, now).schema if not mapping.missing_columns(raw.columns) else (landed.schema if landed is not None else T.StructType())
        return issues, raw.sparkSession.createDataFrame([], schema)
    return issues, land(landed, landing_rows(raw, mapping, batch_id, now))


def union_of(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

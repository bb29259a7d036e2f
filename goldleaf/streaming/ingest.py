"""Structured Streaming counterparts of the batch mechanisms: landing, redelivery, queue state and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from goldleaf.sources import landing
from goldleaf.sources.mapping import SourceMapping


def delivered_files(spark: SparkSession, folder: str, mapping: SourceMapping) -> DataFrame:
    """New CSV files of a folder as a stream, every column as text."""
    columns = [*mapping.source_columns, *mapping.optional_columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def land_stream(stream: DataFrame, mapping: SourceMapping, target: str, checkpoint: str, process: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Land each micro-batch once under ``target`` and hand it on; a replayed batch lands nothing anew."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = landing.landing_rows(batch, mapping, f"stream-{number}", "1970-01-01 00:00:00")
        rows.write.mode("overwrite").parquet(f"{target}/batch_id=stream-{number}")
        if process is not None:
            process(landing.read_batch(spark.read.parquet(f"{target}/batch_id=stream-{number}").withColumn("batch_id", F.lit(f"stream-{number}")), mapping), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_redeliveries(stream: DataFrame, key: str, time: str, within: str = "1 day") -> DataFrame:
    """Drop rows whose key came within the time before; the state is bounded by the watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, time: str, width: str, *keys: str, late: str | None = None) -> DataFrame:
    """window_start, keys, n, total of events; with ``late`` as a stream's watermark."""
    events = events.withWatermark(time, late) if late else events
    grouped = events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """key, session_start, session_end, n of runs of events without a longer gap."""
    events = events.withWatermark(time, late) if late else events
    grouped = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")

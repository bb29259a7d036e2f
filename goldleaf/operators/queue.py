"""The work queue as an append-only log of job events, and the model register beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEASE_SECONDS = 300


def latest_state(log: DataFrame, key: str = "job_id", time: str = "at") -> DataFrame:
    """The last event of each job."""
    order = Window.partitionBy(key).orderBy(F.col(time).desc(), F.col("event_id").desc())
    return log.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def enqueue(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs to append: those whose dedupe_key no open job has."""
    open_ = queue.where("state IN ('PENDING', 'CLAIMED') AND dedupe_key IS NOT NULL").select("queue_name", "dedupe_key")
    once = Window.partitionBy("queue_name", F.coalesce("dedupe_key", F.col("job_id").cast("string"))).orderBy("job_id")
    first = jobs.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    return first.join(open_, ["queue_name", "dedupe_key"], "left_anti")


def claim(queue: DataFrame, name: str, now: str, limit: int = 1) -> DataFrame:
    """The next pending jobs of a queue by priority, time and id, with a lease."""
    at = F.lit(now).cast("timestamp")
    due = queue.where((F.col("queue_name") == name) & (F.col("state") == "PENDING") & (F.col("visible_at") <= at))
    taken = due.orderBy("priority", "visible_at", "job_id").limit(limit)
    return taken.withColumns({"state": F.lit("CLAIMED"), "attempts": F.col("attempts") + 1, "leased_until": at + F.expr(f"INTERVAL {LEASE_SECONDS} SECONDS")})


def complete(jobs: DataFrame) -> DataFrame:
    """Claimed jobs as done; their lease ends."""
    return jobs.withColumns({"state": F.lit("DONE"), "leased_until": F.lit(None).cast("timestamp")})


def failed(jobs: DataFrame, now: str) -> DataFrame:
    """After a failure: pending again in 2**attempts seconds, or dead once the attempts are used up."""
    at = F.lit(now).cast("timestamp")
    last = F.col("attempts") >= F.col("max_attempts")
    later = F.timestamp_seconds(F.unix_timestamp(at) + F.pow(F.lit(2), F.col("attempts")).cast("bigint"))
    return jobs.withColumns({"state": F.when(last, "DEAD").otherwise("PENDING"), "visible_at": F.when(last, F.col("visible_at")).otherwise(later)})


def reap(queue: DataFrame, now: str) -> DataFrame:
    """Claimed jobs whose lease ran out are pending again."""
    late = (F.col("state") == "CLAIMED") & (F.col("leased_until") < F.lit(now).cast("timestamp"))
    return queue.withColumn("state", F.when(late, "PENDING").otherwise(F.col("state")))


def depth(queue: DataFrame) -> DataFrame:
    """queue_name, state, jobs, oldest."""
    return queue.groupBy("queue_name", "state").agg(F.count(F.lit(1)).alias("jobs"), F.min("visible_at").alias("oldest"))


def operational_snapshot(queue: DataFrame, log: DataFrame, now: str) -> DataFrame:
    """pending, claimed, dead, oldest_pending_seconds, and done and failed within the last day, in one row."""
    at = F.lit(now).cast("timestamp")
    state = F.col("state")
    waiting = queue.agg(
        F.count_if(state == "PENDING").alias("pending"), F.count_if(state == "CLAIMED").alias("claimed"), F.count_if(state == "DEAD").alias("dead"),
        (F.unix_timestamp(at) - F.unix_timestamp(F.min(F.when(state == "PENDING", F.col("visible_at"))))).alias("oldest_pending_seconds"),
    )
    recent = log.where((F.col("at") > at - F.expr("INTERVAL 24 HOURS")) & (F.col("at") <= at))
    return waiting.crossJoin(recent.agg(F.count_if(state == "DONE").alias("done_24h"), F.count_if(state == "FAILED").alias("failed_24h")))


# -- models: CANDIDATE, SHADOW, ACTIVE, RETIRED


def active_models(events: DataFrame) -> DataFrame:
    """kind, model, digest of the active model of each kind, from (event_id, kind, model, digest, state, at)."""
    now = latest_state(events, "model")
    newest = Window.partitionBy("kind").orderBy(F.col("at").desc(), "model")
    return now.where("state = 'ACTIVE'").withColumn("__n", F.row_number().over(newest)).where("__n = 1").select("kind", "model", "digest")


NEXT_STATES = {"CANDIDATE": ("SHADOW", "RETIRED"), "SHADOW": ("ACTIVE", "RETIRED"), "ACTIVE": ("RETIRED",), "RETIRED": ()}


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Model events that don't follow from the one before."""
    order = Window.partitionBy("model").orderBy("at", "event_id")
    allowed = [f"(before = '{a}' AND state = '{b}')" for a, follows in NEXT_STATES.items() for b in follows]
    return events.withColumn("before", F.lag("state").over(order)).where(f"NOT coalesce({' OR '.join(allowed)} OR (before IS NULL AND state = 'CANDIDATE'), false)")

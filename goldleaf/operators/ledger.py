"""The match ledger: runs, every pair that was considered, stewards' decisions and the exception log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUEUE_LIMIT, CONSIDERED_LIMIT = 100, 25


def ledger_rows(decided: DataFrame, run_id: str, now: str) -> DataFrame:
    """The pairs of a run with their scores by comparator as a JSON map; write with ``partitionBy('run_id')``."""
    compared = [c for c in decided.columns if c.startswith("cmp_")]
    # Joined texts, null where a comparison is: the function for JSON would cost more than the score.
    scores = F.concat_ws(",", *(F.concat(F.lit(f'"{c[4:]}":'), F.col(c).cast("string")) for c in compared))
    return decided.select(
        F.lit(run_id).alias("run_id"), F.lit(now).cast("timestamp").alias("created_at"), "left_id", "right_id", "blocking_keys", "score", "zone", "vetoed",
        F.concat(F.lit("{"), scores, F.lit("}")).alias("comparator_scores"), "ai_score", "ai_decision", "final_decision", "decided_by",
    )


def run_summary(rows: DataFrame) -> DataFrame:
    """run_id, pairs, matches, reviews, ai_share, vetoed of each run in the ledger."""
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("final_decision") == "MATCH").alias("matches"), F.count_if(F.col("final_decision") == "REVIEW").alias("reviews"),
        F.round(F.avg((F.col("zone") == "GREY").cast("double")), 6).alias("ai_share"), F.count_if("vetoed").alias("vetoed"),
    )


def latest_run(rows: DataFrame) -> DataFrame:
    """The pairs of the newest run."""
    newest = rows.select("run_id", "created_at").distinct().orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(1).select("run_id")
    return rows.join(newest, "run_id", "left_semi")


def grey_queue(rows: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """What a steward sees first: undecided pairs of the newest run, the likeliest on top."""
    return latest_run(rows).where("zone = 'GREY'").orderBy(F.col("score").desc(), "left_id", "right_id").limit(limit)


def considered(rows: DataFrame, person_id: str, limit: int = CONSIDERED_LIMIT) -> DataFrame:
    """Who else a party was compared with in the newest run, best first."""
    mine = latest_run(rows).where((F.col("left_id") == person_id) | (F.col("right_id") == person_id))
    other = F.when(F.col("left_id") == person_id, F.col("right_id")).otherwise(F.col("left_id"))
    return mine.select(other.alias("other_id"), "score", "zone", "final_decision", "decided_by").orderBy(F.col("score").desc(), "other_id").limit(limit)


def steward_decision(left_id: str, right_id: str, decision: str, actor: str, now: str, like: DataFrame) -> DataFrame:
    """A row to append to the decisions; the pair is put in order. It acts from the next run on."""
    if decision not in ("MATCH", "NO_MATCH"):
        raise ValueError(f"a steward says MATCH or NO_MATCH, not {decision!r}")
    if left_id == right_id:
        raise ValueError("a party can't be decided against itself")
    a, b = sorted((left_id, right_id))
    row = like.sparkSession.createDataFrame([(a, b, decision, actor, now)], "left_id string, right_id string, decision string, actor string, t string")
    return row.withColumn("decided_at", F.col("t").cast("timestamp")).drop("t")


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """left_id, right_id, decision: the last word on each pair."""
    last = Window.partitionBy("left_id", "right_id").orderBy(F.col("decided_at").desc(), "decision")
    return decisions.withColumn("__n", F.row_number().over(last)).where("__n = 1").select("left_id", "right_id", "decision")


def exception_rows(answers: DataFrame, batch_id: str, now: str) -> DataFrame:
    """What the gate asked and the fallback answered, for the log that rules are mined from."""
    value = F.coalesce(F.concat_ws(" ", F.nullif(F.col("given"), F.lit("")), F.nullif(F.col("middle"), F.lit("")), F.nullif(F.col("surname"), F.lit(""))), F.lit(""))
    answer = F.coalesce(F.nullif(value, F.lit("")), "address", "phone")
    return answers.select(F.lit(batch_id).alias("batch_id"), F.lit(now).cast("timestamp").alias("logged_at"), "person_id", "field_name", "failed_check", "party_type", "raw_value", "deterministic_value", answer.alias("ai_value"), "confidence", "ai_resolved")


def batch_states(batches: DataFrame, queue_log: DataFrame) -> DataFrame:
    """Delivered batches with the state of their job, by the key ``batch:<id>``."""
    jobs = queue_log.select("dedupe_key", F.col("state").alias("job_state"))
    return batches.join(jobs, F.concat(F.lit("batch:"), batches["batch_id"]) == jobs["dedupe_key"], "left").drop("dedupe_key")


def current_book(person: DataFrame, relationship: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current parties and their policy edges: what households are derived from."""
    live = lambda df: df.where(F.col("is_current") & ~F.coalesce(F.col("is_deleted"), F.lit(False))) if "is_deleted" in df.columns else df.where("is_current")
    edges = live(relationship) if "is_current" in relationship.columns else relationship
    return live(person), edges.where("edge_kind = 'PARTY_POLICY'")

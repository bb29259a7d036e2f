"""What runs over a store in a folder: deliveries, the worker that processes them, and files to hand out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldleaf.model.registry import EntitySpec
from goldleaf.operators import ledger, queue, reads, rules, store
from goldleaf.operators.folder import Conflict, Folder, View
from goldleaf.operators.shred import IDENTITY_SEPARATOR
from goldleaf.sources import landing
from goldleaf.sources.mapping import SourceMapping
from goldleaf.tables import Scratch, small_methods, stored, together

from .pipeline import GoldenStore, Result, run_pipeline

QUEUE, MAX_ATTEMPTS = "batches", 3
JOB = "job_id string, event_id bigint, queue_name string, dedupe_key string, batch_id string, state string, priority int, attempts int, max_attempts int, error string"
PARTY_KEY = ("source_system", "source_key_kind", "source_party_key")
POLICY_KEY = ("source_system", "policy_number_normalized")


def deliver(folder: Folder, raw: DataFrame, mapping: SourceMapping, batch_id: str, now: str) -> DataFrame:
    """Check, land and enqueue a batch in one commit; the issues found.

    Nothing is landed where an issue is an error. Content that has been delivered before, under any id and
    in any order, is the error REDELIVERED; so is a batch id that is taken, as BATCH_ID_TAKEN.
    """
    view, spark = folder.view(), raw.sparkSession
    if mapping.missing_columns(raw.columns):
        return landing.validate_batch(raw, mapping)
    digest = landing.batch_hash(raw, [c for c in (*mapping.source_columns, *mapping.optional_columns) if c in raw.columns])
    delivery = digest.select(F.lit(mapping.source_system).alias("source_system"), F.lit(batch_id).alias("batch_id"), "batch_hash", F.lit(now).cast("timestamp").alias("delivered_at"))
    delivery = stored(delivery, "delivery")
    before = view.table("deliveries")
    if before is not None:
        own = before.where(F.col("source_system") == mapping.source_system)
        for code, column in (("REDELIVERED", "batch_hash"), ("BATCH_ID_TAKEN", "batch_id")):
            if not own.join(delivery, column, "left_semi").isEmpty():
                return spark.createDataFrame([("ERROR", code, None, None)], "severity string, code string, column string, row_count bigint")
    issues = stored(landing.validate_batch(raw, mapping), "issues")
    if issues.where("severity = 'ERROR'").isEmpty():
        rows = landing.landing_rows(raw, mapping, batch_id, now)
        job = spark.createDataFrame([(f"{mapping.source_system}:{batch_id}", view.number + 1, QUEUE, f"batch:{batch_id}", batch_id, "PENDING", 100, 0, MAX_ATTEMPTS, None)], JOB)
        job = job.withColumns({"visible_at": F.lit(now).cast("timestamp"), "leased_until": F.lit(None).cast("timestamp"), "at": F.lit(now).cast("timestamp")})
        folder.commit(view, append={"landing": rows, "deliveries": delivery, "jobs": job})
    return issues


def _event(jobs: DataFrame, view: View, now: str) -> DataFrame:
    return jobs.withColumns({"event_id": F.lit(view.number + 1).cast("bigint"), "at": F.lit(now).cast("timestamp")})


def claim(folder: Folder, now: str, limit: int = 1) -> DataFrame | None:
    """The next jobs, taken in one commit; None if there are none or another worker was faster."""
    view = folder.view()
    if view.table("jobs") is None:
        return None
    due = queue.claim(queue.reap(queue.latest_state(view.table("jobs")), now), QUEUE, now, limit)
    taken = stored(_event(due, view, now), "claimed")
    if taken.isEmpty():
        return None
    try:
        folder.commit(view, append={"jobs": taken})
    except Conflict:
        return None
    return taken


def golden_store(view: View) -> GoldenStore:
    """The current versions and the active keys, which is all that a batch is held against."""
    crosswalk = view.table("crosswalk")
    known = crosswalk.where("is_active").select(F.concat_ws(IDENTITY_SEPARATOR, *PARTY_KEY).alias("person_id"), "golden_id") if crosswalk is not None else None
    return GoldenStore(view.table("person"), view.table("policy"), known)


def _upserted(before: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    return new if before is None else before.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


@dataclass(frozen=True)
class Written:
    replace: dict[str, DataFrame]
    append: dict[str, DataFrame]


def written(view: View, result: Result, run_id: str, batch_id: str, now: str) -> Written:
    """The tables after a run. Closed versions are only ever appended, so a batch rewrites current ones alone."""
    replace, append = {}, {}
    edges = store.write_versions(view.table("relationship"), result.relationships, "relationship_id", [c for c in result.relationships.columns if c != "relationship_id"], now)
    reports = []
    made = {"person": result.person, "policy": result.policy, "relationship": edges}
    histories = together(*(partial(stored, versions.history, f"{name}-history") for name, versions in made.items()))
    for (name, versions), history in zip(made.items(), histories, strict=True):
        replace[name], append[f"{name}_closed"] = history.where("is_current"), history.where("NOT is_current")
        reports.append(versions.report.withColumn("entity", F.lit(name)))
    append["runs"] = reports[0].unionByName(reports[1]).unionByName(reports[2]).withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id), "ended_at": F.lit(now).cast("timestamp")})
    identity = F.split("person_id", IDENTITY_SEPARATOR)
    parties = result.known.select(*(identity[i].alias(c) for i, c in enumerate(PARTY_KEY)), "golden_id")
    policies = replace["policy"].select(*POLICY_KEY, F.col("policy_id").alias("golden_id"))
    keyed = (("crosswalk", parties, PARTY_KEY), ("policy_crosswalk", policies, POLICY_KEY))
    before = {}
    for name, incoming, key in keyed:
        empty = incoming.select(*key, "golden_id", F.lit(True).alias("is_active"), F.lit(now).cast("timestamp").alias("first_seen"), F.lit(now).cast("timestamp").alias("last_seen")).limit(0)
        there = view.table(name)
        before[name] = empty if there is None else there
    upserted = together(*(partial(stored, store.upsert_crosswalk(before[name], incoming, now, key), name) for name, incoming, key in keyed))
    for (name, _, key), now_there in zip(keyed, upserted, strict=True):
        replace[name] = now_there.drop("moved")
        append[f"{name}_moved"] = store.moved_keys(before[name], now_there, now, key)
    replace["membership"] = _upserted(view.table("membership"), result.memberships, "person_id")
    replace["merged"] = _upserted(view.table("merged"), result.merged, "golden_id")
    append["ledger"] = ledger.ledger_rows(result.pairs, run_id, now)
    append["provenance"] = result.provenance.withColumn("run_id", F.lit(run_id))
    append["exceptions"] = ledger.exception_rows(result.exceptions, batch_id, now)
    return Written(replace, append)


def process(folder: Folder, job: DataFrame, mapping: SourceMapping, now: str, active: Sequence[rules.Rule] = ()) -> View:
    """Run one claimed batch into the store; the new tables and the job's end are one commit.

    What is stored on the way is deleted when the commit has been written, or has failed.
    """
    view = folder.view()
    batch_id = job.select("batch_id").first()[0]
    decisions = view.table("decisions")
    with Scratch(folder.spark):
        raw = stored(landing.read_batch(view.table("landing"), mapping, batch_id), "batch")
        result = run_pipeline(raw, mapping, now, golden_store(view), list(active), ledger.latest_decisions(decisions) if decisions is not None else None)
        new = written(view, result, f"run-{view.number + 1}", batch_id, now)
        return folder.commit(view, new.replace, {**new.append, "jobs": _event(queue.complete(job), view, now)})


def work(folder: Folder, mapping: SourceMapping, now: str, active: Sequence[rules.Rule] = ()) -> str | None:
    """Claim and process the next batch: DONE, PENDING or DEAD as it ended, None without work.

    A failed job waits and is tried again, then is dead; one whose worker is lost is claimed anew when its
    lease ends. What a lost or overtaken worker wrote is in no manifest.
    """
    job = claim(folder, now)
    if job is None:
        return None
    try:
        with small_methods(folder.spark):
            process(folder, job, mapping, now, active)
        return "DONE"
    except Exception as error:  # whatever it was, it belongs to the job
        view = folder.view()
        ended = stored(_event(queue.failed(job, now).withColumn("error", F.lit(f"{type(error).__name__}: {error}"[:500])), view, now), "failed")
        folder.commit(view, append={"jobs": ended})
        return ended.first()["state"]


def requeue(folder: Folder, batch_id: str, now: str) -> View:
    """Have a landed batch processed again, whether it was done or dead; unless something changed, nothing will."""
    view = folder.view()
    job = queue.latest_state(view.table("jobs")).where(F.col("batch_id") == batch_id)
    job = job.withColumns({"state": F.lit("PENDING"), "attempts": F.lit(0), "error": F.lit(None).cast("string"), "visible_at": F.lit(now).cast("timestamp")})
    return folder.commit(view, append={"jobs": _event(job, view, now)})


def decide(folder: Folder, left_id: str, right_id: str, decision: str, actor: str, now: str) -> View:
    """Record a steward's word on a pair; it acts from the next run on."""
    view = folder.view()
    return folder.commit(view, append={"decisions": ledger.steward_decision(left_id, right_id, decision, actor, now, view.table("jobs"))})


def history(view: View, name: str) -> DataFrame:
    """All versions of an entity, closed and current."""
    return view.table(f"{name}_closed").unionByName(view.table(name), allowMissingColumns=True)


def lineage(view: View, golden_id: str) -> dict[str, DataFrame]:
    """What a golden party was made from: its keys, its disputed values and its versions."""
    return {
        "keys": view.table("crosswalk").where(F.col("golden_id") == golden_id),
        "provenance": view.table("provenance").where(F.col("master_id") == golden_id),
        "versions": reads.version_history(history(view, "person"), "person_id", golden_id),
    }


def export_csv(rows: DataFrame, entity: EntitySpec, path: str, unmask: bool = False) -> None:
    """An entity as CSV files with a header each, masked unless asked; executors write them, nothing is collected."""
    reads.export_entity(rows, entity, unmask).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)

"""Jobs over the whole store: backfill, rebuild, checks, evaluation and rule mining."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldleaf.operators import blocking, clustering, fallback, gate, quality, rules, shred, store
from goldleaf.sources import landing
from goldleaf.sources.mapping import SourceMapping
from goldleaf.tables import stored

from .pipeline import GoldenStore, Result, run_pipeline


def process_landed(landed: DataFrame, mapping: SourceMapping, now: str, before: GoldenStore, batch_id: str | None = None, active: Sequence[rules.Rule] = ()) -> Result:
    """Run the pipeline over landed records, of one batch or of all: reprocessing changes nothing new."""
    return run_pipeline(stored(landing.read_batch(landed, mapping, batch_id), "batch"), mapping, now, before, list(active))


@dataclass(frozen=True)
class RebuildPlan:
    """What a rebuild would change; nothing is written until the tables of ``result`` are."""

    result: Result
    report: DataFrame


def rebuild(landed: DataFrame, mapping: SourceMapping, now: str, current: GoldenStore) -> RebuildPlan:
    """The store anew from the landing zone, keeping known ids, and how it differs from the current one."""
    result = process_landed(landed, mapping, now, GoldenStore(None, None, current.known))
    new = result.person.history.select("person_id", F.col("record_hash").alias("new_hash"))
    old = current.person.where("is_current").select("person_id", F.col("record_hash").alias("old_hash"))
    joined = new.join(old, "person_id", "full_outer")
    report = joined.agg(
        F.count_if(F.col("old_hash").isNull()).alias("appear"), F.count_if(F.col("new_hash").isNull()).alias("vanish"),
        F.count_if(F.col("old_hash") != F.col("new_hash")).alias("differ"), F.count_if(F.col("old_hash") == F.col("new_hash")).alias("equal"),
    )
    return RebuildPlan(result, report)


def backfill_columns(history: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Fill columns that are null in current versions from newly derived ones, without a new version."""
    new = incoming.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = history.join(new, (history[key] == new["__key"]) & history["is_current"], "left")
    return joined.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop("__key", *(f"__{c}" for c in columns))


def check(person: DataFrame, relationship: DataFrame, pairs: DataFrame) -> DataFrame:
    """The constraints that don't hold."""
    return store.violations(person, relationship, pairs).where("violations > 0")


def evaluate(raw: DataFrame, mapping: SourceMapping, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1, blocking recall and wrong clusters against labels (person_id, true_id), in one row."""
    parties = stored(shred.collapse_parties(shred.shred_parties(raw, mapping)), "evaluated")
    found = clustering.cluster(parties, pairs.where("final_decision = 'MATCH'"))
    wrong = quality.wrong_clusters(found, labels).agg(F.count(F.lit(1)).alias("wrong_clusters"))
    return quality.pairwise_quality(found, labels).crossJoin(quality.blocking_recall(blocking.block_pairs(parties), labels).select("blocking_recall")).crossJoin(wrong)


def mine(raw: DataFrame, mapping: SourceMapping, min_evidence: int = rules.MIN_EVIDENCE, existing: Sequence[str] = ()) -> list[rules.Rule]:
    """Rules that the fallback's answers suggest, each tried in the shadow: those that break nothing."""
    parties = stored(shred.collapse_parties(shred.shred_parties(raw, mapping)), "mined")
    answers = fallback.standardise(fallback.requests(gate.apply_gate(parties)), mapping.default_country_code)
    found = rules.mine_signatures(answers.withColumn("deterministic_value", F.coalesce("deterministic_value", "raw_value")), min_evidence)
    proposed = rules.propose_rules([(r["field_name"], r["failed_check"], r["shape"], r["evidence_count"]) for r in found.collect()], existing)
    return [rule.shadowed(rules.shadow_evaluate(parties, rule).first()["regressed"]) for rule in proposed]

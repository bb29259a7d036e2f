"""The whole batch: land, shred, standardise, resolve, survive, version, group into households."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldleaf.model.registry import PERSON, POLICY
from goldleaf.operators import blocking, clustering, fallback, gate, household, rules, scoring, shred, store, survive
from goldleaf.sources.mapping import SourceMapping
from goldleaf.tables import stored, together


@dataclass(frozen=True)
class GoldenStore:
    """The current tables; all None before the first batch."""

    person: DataFrame | None = None
    policy: DataFrame | None = None
    known: DataFrame | None = None  # person_id (source identity), golden_id


@dataclass(frozen=True)
class Resolution:
    pairs: DataFrame
    assignments: DataFrame


@dataclass(frozen=True)
class Result:
    person: store.Versions
    policy: store.Versions
    relationships: DataFrame
    pairs: DataFrame
    provenance: DataFrame
    memberships: DataFrame
    known: DataFrame
    merged: DataFrame
    exceptions: DataFrame


def standardise(parties: DataFrame, active: list[rules.Rule], country_code: str) -> tuple[DataFrame, DataFrame]:
    """(parties, exceptions): gate, rules, gate, fallback for what still fails, write-back, gate.

    What is gated and what is asked are stored: each is read twice, and one plan of all the steps repeats
    their expressions until planning takes longer than the work.
    """
    gated = gate.apply_gate(parties)
    ruled = gate.apply_gate(rules.apply_rules(gated, active).drop("failed_checks", "gate_passed")) if active else gated
    ruled = stored(ruled, "gated")
    asked = stored(fallback.standardise(fallback.requests(ruled), country_code), "asked")
    written = fallback.write_back(ruled.drop("failed_checks", "gate_passed"), asked)
    return gate.apply_gate(written), asked


def resolve(parties: DataFrame, overrides: DataFrame | None = None) -> Resolution:
    """Block, score, decide and cluster.

    Pairs are scored where they meet. Of their parties' attributes only those of the grey zone are stored with
    them, which models read; the others are in ``parties``, and would be written once for each pair.
    """
    met = blocking.met_pairs(parties, scoring.compared_columns(parties))
    decided = scoring.decide(scoring.grey_decisions(scoring.score_attached(met)), overrides)
    kept = {f"{side}_{c}" for side in "lr" for c in scoring.GREY_COLUMNS}
    decided = stored(decided.drop(*(c for c in met.columns if c.startswith(("l_", "r_")) and c not in kept)), "scored")
    return Resolution(decided, clustering.cluster(parties, decided.where("final_decision = 'MATCH'")))


def run_pipeline(raw: DataFrame, mapping: SourceMapping, now: str, before: GoldenStore = GoldenStore(), active: list[rules.Rule] | None = None, overrides: DataFrame | None = None, trust: dict[str, float] | None = None) -> Result:
    """One batch into the store. Nothing of ``before`` is changed: the result has the new tables."""
    policies = shred.shred_policies(raw, mapping)
    policies = policies.withColumn("policy_id", store.uuid5(store.GOLDEN_NAMESPACE, F.concat_ws("|", "source_system", "policy_number_normalized")))
    policies = policies.drop("source_record_id", "source_timestamp")
    # Several tables are made from each of these: they are stored, so that none is computed again.
    occurrences, policies = together(partial(stored, shred.shred_parties(raw, mapping), "occurrences"), partial(stored, policies, "policies"))
    parties, exceptions = standardise(shred.collapse_parties(occurrences), active or [], mapping.default_country_code)
    parties = stored(parties, "parties")
    resolution = resolve(parties, overrides)
    known = before.known if before.known is not None else raw.sparkSession.createDataFrame([], "person_id string, golden_id string")
    ids = stored(store.golden_ids(resolution.assignments, known), "ids")
    contributors = parties.join(ids.select("person_id", "golden_id"), "person_id").drop("person_id").withColumnRenamed("golden_id", "master_id")
    golden = stored(survive.survive(contributors, PERSON, trust), "golden")
    disputed = survive.provenance(contributors, golden, PERSON)
    persons = golden.withColumnRenamed("master_id", "person_id").drop("source_count", "contributing_records", "contributing_sources")
    person = store.write_versions(before.person, persons, "person_id", store.hashed_columns(PERSON, persons.columns), now)

    policy = store.write_versions(before.policy, policies, "policy_id", store.hashed_columns(POLICY, policies.columns), now)

    edges = shred.shred_relationships(occurrences).join(ids.select("person_id", "golden_id"), "person_id")
    edges = edges.join(policies.select("source_system", "policy_number_normalized", "policy_id"), ["source_system", "policy_number_normalized"])
    edges = edges.drop("person_id").withColumnRenamed("golden_id", "person_id").dropDuplicates(["person_id", "policy_id", "role", "role_sequence"])
    edges = stored(store.edge_ids(edges), "edges")
    found = stored(household.associations(household.stated_pairs(edges), persons), "associations")
    party_policy = edges.select(
        "relationship_id", "edge_kind", F.col("person_id").alias("from_person_id"), F.col("policy_id").alias("to_policy_id"), F.lit(None).cast("string").alias("to_person_id"), "role",
        F.lit(None).cast("string").alias("association_type"), F.lit(None).cast("array<string>").alias("evidence_policy_ids"), F.lit(0).alias("evidence_count"), F.lit(None).cast("boolean").alias("same_address"),
    )
    relationships = party_policy.unionByName(household.party_edges(found))
    all_known = known.join(ids.select("person_id"), "person_id", "left_anti").unionByName(ids.select("person_id", "golden_id"))
    return Result(person, policy, relationships, resolution.pairs, disputed, household.membership(persons, found), all_known, store.merge_pointers(ids), exceptions)

"""The golden store as functions of tables: versioned writes, crosswalks, merge pointers and constraints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldleaf.functions.kernels import uuid5
from goldleaf.model.registry import EntitySpec

MAX_HOPS = 10
GOLDEN_NAMESPACE = "0d1c2f5e-7a57-5c1e-9a67-3f1d52b3c0de"
EDGE_NAMESPACE = "b2c48d16-7e35-5f09-9d63-4a1f8e05c7b2"  # fixed value of derived edges
LINEAGE = ("version", "valid_from", "valid_to", "is_current", "record_hash", "created_at", "updated_at")


def record_hash(names: Sequence[str], types: dict[str, str]) -> Column:
    """128 bits of the named columns: null differs from empty, and a value from its neighbour's."""
    parts = []
    for name in sorted(names):
        text = F.to_json(F.struct(F.col(name))) if types[name].startswith(("array", "struct", "map")) else F.col(name).cast("string")
        parts.append(F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.lit("v"), text), F.lit("n"))))
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


@dataclass(frozen=True)
class Versions:
    history: DataFrame
    report: DataFrame


def hashed_columns(entity: EntitySpec, columns: Sequence[str]) -> list[str]:
    return [f.name for f in entity.select(hashed=True) if f.name in set(columns)]


def write_versions(history: DataFrame | None, incoming: DataFrame, key: str, hashed: Sequence[str], now: str) -> Versions:
    """Slowly changing history: unchanged rows stay, changed ones are closed and followed by a new version.

    Entities that aren't in ``incoming`` are left alone. The same input twice changes nothing.
    """
    at = F.lit(now).cast("timestamp")
    values = [c for c in incoming.columns if c not in LINEAGE]
    new = incoming.select(*values).withColumn("record_hash", record_hash(hashed, dict(incoming.dtypes)))
    columns = [*values, *LINEAGE]
    if history is None:
        first = new.withColumns({"version": F.lit(1), "valid_from": at, "valid_to": F.lit(None).cast("timestamp"), "is_current": F.lit(True), "created_at": at, "updated_at": at})
        made = first.select(*columns)
        return Versions(made, made.agg(*_counts(F.lit(True), F.lit(False), F.lit(False))))
    kept = [c for c in values if c in history.columns]
    now_there = history.where("is_current").select(F.col(key).alias("__key"), F.col("record_hash").alias("__hash"), F.col("version").alias("__version"), F.col("created_at").alias("__created"))
    joined = new.join(now_there, new[key] == now_there["__key"], "left")
    is_new, changed = F.col("__key").isNull(), F.col("__key").isNotNull() & ~F.col("__hash").eqNullSafe(F.col("record_hash"))
    fresh = joined.where(is_new | changed).select(
        *kept,
        (F.coalesce("__version", F.lit(0)) + 1).cast("int").alias("version"),
        at.alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
        F.lit(True).alias("is_current"),
        "record_hash",
        F.coalesce("__created", at).alias("created_at"),
        at.alias("updated_at"),
    )
    superseded = joined.where(changed).select(F.col(key).alias("__closed"))
    marked = history.join(superseded, history[key] == superseded["__closed"], "left")
    closing = F.col("__closed").isNotNull() & F.col("is_current")
    closed = marked.withColumns({"valid_to": F.when(closing, at).otherwise(F.col("valid_to")), "updated_at": F.when(closing, at).otherwise(F.col("updated_at")), "is_current": F.col("is_current") & ~closing})
    return Versions(closed.select(*kept, *LINEAGE).unionByName(fresh), joined.agg(*_counts(is_new, changed, ~(is_new | changed))))


def _counts(new: Column, changed: Column, same: Column) -> list[Column]:
    return [F.count_if(c).alias(n) for n, c in (("inserted", new), ("versioned", changed), ("unchanged", same))]


def as_of(history: DataFrame, when: str) -> DataFrame:
    """The versions that held at a time."""
    t = F.lit(when).cast("timestamp")
    return history.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def golden_ids(assignments: DataFrame, known: DataFrame) -> DataFrame:
    """person_id, golden_id and merged_from for clusters (person_id, master_id) and the crosswalk (person_id, golden_id).

    A cluster without known ids gets one made from its least member, so that a rerun agrees; one with
    one keeps it; of several the least survives and the others are listed as merged into it.
    """
    joined = assignments.join(known.withColumnRenamed("golden_id", "__known"), "person_id", "left")
    per = joined.groupBy("master_id").agg(F.array_sort(F.collect_set("__known")).alias("ids"))
    made = uuid5(GOLDEN_NAMESPACE, F.col("master_id"))
    per = per.select("master_id", F.coalesce(F.get("ids", F.lit(0)), made).alias("golden_id"), F.when(F.size("ids") > 1, F.slice("ids", F.lit(2), F.size("ids"))).alias("merged_from"))
    return assignments.join(per, "master_id").select("person_id", "master_id", "golden_id", "merged_from")


def merge_pointers(ids: DataFrame) -> DataFrame:
    """golden_id, merged_into_id of the ids that lost a merge."""
    return ids.where("merged_from IS NOT NULL").select("merged_from", F.col("golden_id").alias("merged_into_id")).distinct().select(F.explode("merged_from").alias("golden_id"), "merged_into_id")


def resolve_pointers(ids: DataFrame, pointers: DataFrame, column: str = "golden_id", max_hops: int = MAX_HOPS) -> DataFrame:
    """Follow merge pointers to the surviving id: ``resolved_id`` and ``hops``; too long a chain has a null id."""
    now = ids.withColumns({"resolved_id": F.col(column), "hops": F.lit(0)})
    step = pointers.select(F.col("golden_id").alias("__from"), F.col("merged_into_id").alias("__to"))
    for _ in range(max_hops):
        now = now.join(step, F.col("resolved_id") == F.col("__from"), "left")
        now = now.withColumns({"hops": F.col("hops") + F.col("__to").isNotNull().cast("int"), "resolved_id": F.coalesce("__to", "resolved_id")}).drop("__from", "__to")
    beyond = now.join(step, F.col("resolved_id") == F.col("__from"), "left")
    return beyond.withColumn("resolved_id", F.when(F.col("__to").isNull(), F.col("resolved_id"))).drop("__from", "__to")


def upsert_crosswalk(current: DataFrame, incoming: DataFrame, now: str, key: Sequence[str] = ("source_system", "source_key_kind", "source_party_key")) -> DataFrame:
    """Crosswalk rows (key, golden_id, is_active, first_seen, last_seen): moved keys point anew, the others stay."""
    at = F.lit(now).cast("timestamp")
    new = incoming.select(*key, F.col("golden_id").alias("__new")).distinct()
    joined = current.join(new, list(key), "full_outer")
    seen = F.col("__new").isNotNull()
    return joined.select(
        *key,
        F.coalesce("__new", "golden_id").alias("golden_id"),
        F.coalesce(F.when(seen, F.lit(True)), "is_active").alias("is_active"),
        F.coalesce("first_seen", at).alias("first_seen"),
        F.when(seen, at).otherwise(F.col("last_seen")).alias("last_seen"),
        (seen & F.col("golden_id").isNotNull() & (F.col("golden_id") != F.col("__new"))).alias("moved"),
    )


def moved_keys(current: DataFrame, upserted: DataFrame, now: str, key: Sequence[str] = ("source_system", "source_key_kind", "source_party_key")) -> DataFrame:
    """The rows that moved keys had before, as inactive: what is left of where a key used to point."""
    moved = upserted.where("moved").select(*key)
    return current.join(moved, list(key), "left_semi").withColumns({"is_active": F.lit(False), "last_seen": F.lit(now).cast("timestamp")})


def edge_ids(edges: DataFrame) -> DataFrame:
    """Party-to-policy edges with an id that follows from what they join, null-safe in the sequence."""
    name = F.concat_ws("|", "person_id", "policy_number_normalized", "role", F.coalesce(F.col("role_sequence").cast("string"), F.lit("")))
    return edges.withColumn("relationship_id", uuid5(EDGE_NAMESPACE, name))


def fill_required(rows: DataFrame, entity: EntitySpec) -> DataFrame:
    """Zero, false or an empty list where a required field is missing; a missing required text is an error."""
    zeros = {"short": 0, "int": 0, "bigint": 0, "smallint": 0, "double": 0.0, "boolean": False}
    out = rows
    for f in entity.fields:
        if not f.required or f.survivorship == "SYSTEM" and f.name != entity.primary_key:
            continue
        kind = f.spark_type.simpleString()
        default = F.array().cast(kind) if kind.startswith("array") else F.lit(zeros[kind]).cast(kind) if kind in zeros else None
        if f.name not in rows.columns:
            if default is None:
                raise ValueError(f"{entity.name}.{f.name} is required and has no default")
            out = out.withColumn(f.name, default)
        elif default is not None:
            out = out.withColumn(f.name, F.coalesce(F.col(f.name), default))
    return out


def violations(person: DataFrame, relationship: DataFrame, pairs: DataFrame) -> DataFrame:
    """constraint, violations: each must be 0."""

    def count(df: DataFrame, name: str, bad: Column) -> DataFrame:
        return df.agg(F.lit(name).alias("constraint"), F.count_if(F.coalesce(bad, F.lit(True))).alias("violations"))

    current = person.where("is_current").groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    party = F.col("edge_kind") == "PARTY_PARTY"
    checks = [
        count(person, "validity_order", F.col("valid_to").isNotNull() & (F.col("valid_to") < F.col("valid_from"))),
        count(person, "current_is_open", F.col("is_current") != F.col("valid_to").isNull()),
        count(current, "one_current_version", F.col("n") > 1),
        count(relationship, "target_is_policy_or_party", F.col("to_policy_id").isNull() == F.col("to_person_id").isNull()),
        count(relationship, "kind_fits_target", party != F.col("to_person_id").isNotNull()),
        count(relationship, "role_present", ~party & F.col("role").isNull()),
        count(relationship, "no_self_edge", party & F.col("from_person_id").eqNullSafe(F.col("to_person_id"))),
        count(pairs, "pair_is_ordered", F.col("left_id") >= F.col("right_id")),
        count(pairs, "score_in_range", (F.col("score") < 0) | (F.col("score") > 1)),
        count(pairs, "ai_only_in_grey", (F.col("zone") != "GREY") & F.col("ai_score").isNotNull()),
    ]
    return reduce(DataFrame.unionByName, checks)

"""Clusters of matched parties: connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldleaf.tables import forget, stored

SUSPICIOUS_CLUSTER = 25
MAX_ROUNDS = 60
#: Edges that the driver joins by itself, where rounds over the cluster would take longer to plan than to run.
AT_ONCE = 500_000


def _with_least(arcs: DataFrame) -> DataFrame:
    """Arcs (u, v) with m, the least of u and its neighbours.

    A hub has most arcs under one key. The join is on a struct of it, so that the sums are dealt out
    once more and both sides of the join are plain shuffles, which Spark can split where they are skewed.
    """
    least = arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return arcs.withColumn("key", F.struct("u")).join(least.select(F.struct("u").alias("key"), "m"), "key").drop("key")


def _large_star(edges: DataFrame) -> DataFrame:
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(arcs).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour, and the node itself, is linked to the least of them; edges have the greater node first."""
    found = _with_least(edges)
    moved = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(found.select("u", F.col("m").alias("v"))).distinct()


def _stored_with_sums(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """Edges as stored, with a count and two sums that are equal for equal sets, taken while they are written."""
    seen, h = Observation(), F.xxhash64("u", "v")
    out = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.pmod(h, F.lit(1 << 40))).alias("low"), F.sum(F.shiftrightunsigned(h, 24)).alias("high")), label, narrow=True)
    return out, tuple(seen.get[k] for k in ("n", "low", "high"))


def _joined_at_once(edges: DataFrame) -> DataFrame:
    """node, component of at most AT_ONCE edges, by union and find over the places of their nodes in order."""
    found = edges.toArrow()
    ends = [found.column(c).combine_chunks() for c in ("u", "v")]
    nodes = pc.unique(pa.concat_arrays(ends))
    nodes = nodes.take(pc.sort_indices(nodes))
    over = list(range(len(nodes)))

    def top(n: int) -> int:
        while over[n] != n:
            over[n] = n = over[over[n]]
        return n

    for u, v in zip(*(pc.index_in(end, nodes).to_pylist() for end in ends), strict=True):
        a, b = top(u), top(v)
        over[max(a, b)] = min(a, b)
    tops = [top(n) for n in over]
    below = [n for n, t in enumerate(tops) if n != t]
    table = pa.table({"node": nodes.take(pa.array(below, pa.int64())), "component": nodes.take(pa.array([tops[n] for n in below], pa.int64()))})
    kind = edges.schema["u"].dataType
    return edges.sparkSession.createDataFrame(table, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))


def components(edges: DataFrame) -> DataFrame:
    """node, component for edges (u, v) of any ordered type; a component's least node isn't listed.

    Up to AT_ONCE edges of texts or whole numbers are joined on the driver. For more, rounds grow with the
    logarithm of the nodes; each is written to the shared folder, so that the lineage stays short and a lost
    executor costs one round.
    """
    now, before = _stored_with_sums(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if 0 < before[0] <= AT_ONCE and isinstance(now.schema["u"].dataType, (T.StringType, T.IntegralType)):
        out = stored(_joined_at_once(now), "components", narrow=True)
        forget(now)
        return out
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        new, after = _stored_with_sums(_small_star(_large_star(now)), "star")
        forget(now)
        now = new
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")


def cluster(ids: DataFrame, matched: DataFrame, id_column: str = "person_id") -> DataFrame:
    """person_id, master_id of every id: the least id that it is matched with, over any steps, or itself."""
    found = components(matched.select(F.col("left_id").alias("u"), F.col("right_id").alias("v")))
    return ids.select(id_column).join(found, F.col(id_column) == F.col("node"), "left").select(id_column, F.coalesce("component", id_column).alias("master_id"))


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    """master_id, members, suspicious."""
    return assignments.groupBy("master_id").agg(F.count(F.lit(1)).alias("members")).withColumn("suspicious", F.col("members") >= SUSPICIOUS_CLUSTER)

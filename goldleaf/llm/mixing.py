"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a weight and a schedule: its share of the stream at training time t in [0, 1] is
``start + (end - start) * t`` times the weight. A source's documents, in an order drawn from their
ids, lie one after the other on its axis of tokens, repeated up to ``cap`` times; the target is the
demand that the whole schedule adds up to. A copy whose middle lies below the target is taken, and
its training position is the time at which the cumulative demand reaches its first token: the
inverse of the integrated schedule. The stream is range-sorted by position.

Prefix sums, over documents and over sources, are taken in two steps (inside range partitions, then
over one row for each partition), so neither a source that holds most rows nor a great number of
sources is one task.

Defined results: a null text has size 0 and is never taken; very long texts are counted whole; null
is a source of its own, the last; documents of a source are ordered by the MD5 of their id, then by
id, size and text, so rows that repeat an id agree in every run, and rows that repeat id, source and
text are taken each on its own axis interval; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_words, stored

#: (start, end) of the schedule by weight: heavier sources come in later.
RAMPS = {1: (1.5, 0.5), 2: (1.0, 1.0), 3: (0.5, 1.5)}


def _lined(rows: DataFrame, *order: Column, label: str) -> DataFrame:
    """``rows`` stored in range partitions of the order, with the partition's number ``part``."""
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), label, narrow=True)


def _in_front(lined: DataFrame, values: dict[str, Column], *by: str) -> DataFrame:
    """For each ``by`` and part: the sums of ``values`` over all earlier parts, as columns of those names; one row a part."""
    parts = lined.groupBy(*by, "part").agg(*(F.sum(value).alias(name) for name, value in values.items()))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*(F.col(c).alias(f"front_{c}") for c in (*by, "part")), *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in values))


def _running(lined: DataFrame, order: tuple[Column, ...], values: dict[str, Column]) -> DataFrame:
    """``lined`` with the sums of ``values`` over all rows before each row, in the order that it was lined up in."""
    local = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    fronts = F.broadcast(_in_front(lined, values))  # one row for each partition
    joined = lined.withColumns({f"own_{n}": F.coalesce(F.sum(v).over(local), F.lit(0)) for n, v in values.items()}).join(fronts, F.col("part") == F.col("front_part"))
    return joined.select(*lined.columns, *((F.col(n) + F.col(f"own_{n}")).alias(n) for n in values))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size, weight, target from rows (source, source_size).

    Sources, by code point and null last, get the weights of ``cycle`` in turn and share all sizes;
    a target stops at ``cap`` times its source's size and the excess goes to the others by weight.
    With sources in the order of cap size over weight, the level of the water is found at the first
    source that stays below its cap, so no iteration is needed.
    """
    by_name = (F.col("source").asc_nulls_last(),)
    ranked = _running(_lined(sizes, *by_name, label="ranks"), by_name, {"rank": F.lit(1).cast("long")}).drop("part")
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") % len(cycle) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    ranked = ranked.withColumn("fill", F.col("most").cast("double") / F.col("weight"))
    by_fill = (F.col("fill"), F.col("rank"))
    lined = _lined(ranked, *by_fill, label="fills")
    placed = _running(lined, by_fill, {"below": F.col("most"), "lighter": F.col("weight").cast("long")})
    totals = lined.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    placed = placed.crossJoin(F.broadcast(totals))  # one row
    placed = placed.withColumn("level", (F.col("all_size") - F.col("below")).cast("double") / (F.col("all_weight") - F.col("lighter")))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("fill", "rank", "level"))
    level = placed.agg(F.min(fits)["level"].alias("level"))  # one row
    out = lined.crossJoin(F.broadcast(level))
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    return out.select("source", "source_size", "weight", target.alias("target"))


def _position(share: Column, weight: Column, ramps: dict[int, tuple[float, float]]) -> Column:
    """Inverse of the integrated schedule at ``share`` of the target."""
    out = share
    for value, (start, end) in ramps.items():
        if start != end:
            slope = end - start
            root = (F.sqrt(F.lit(start * start) + F.lit(slope * (start + end)) * share) - start) / slope
            out = F.when(weight == value, root).otherwise(out)
    return out


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    cycle: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    ramps: dict[int, tuple[float, float]] | None = None,
    row_col: str | None = None,
) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, copies, taken, positions.

    ``copies`` documents' repeats are taken (0 to ``cap``), at the training ``positions`` in [0, 1).
    With ``row_col``, that column comes along as ``row``.
    """
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_planned(docs, id_col, source_col, text_col, cycle, cap, RAMPS if ramps is None else ramps, row_col), "plan")


def _planned(docs: DataFrame, id_col: str, source_col: str, text_col: str, cycle: tuple[int, ...], cap: int, ramps: dict[int, tuple[float, float]], row_col: str | None) -> DataFrame:
    row = F.lit(None).cast("long") if row_col is None else docs[row_col]
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), ascii_words(docs[text_col]).alias("size"), F.xxhash64(docs[text_col]).alias("text_key"), row.alias("row"))
    rows = rows.withColumn("shuffle_key", F.md5(F.col("id").cast("string").cast("binary")))
    counted = stored(rows, "sizes")
    order = tuple(F.col(c) for c in ("shuffle_key", "id", "size", "text_key"))
    lined = _lined(counted, F.col("source"), *order, label="lined")
    parts = _in_front(lined, {"part_start": F.col("size")}, "source")
    sources = source_targets(counted.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, cap).withColumnRenamed("source", "known_source")
    parts = parts.join(sources, F.col("front_source").eqNullSafe(F.col("known_source"))).drop("known_source")
    local = Window.partitionBy("part", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = lined.withColumn("start", F.coalesce(F.sum("size").over(local), F.lit(0)))
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("front_source")) & (F.col("part") == F.col("front_part")), "left")
    placed = placed.withColumn("start", F.col("start") + F.col("part_start"))
    starts = [F.lit(k) * F.col("source_size") + F.col("start") for k in range(cap)]
    taken = [(F.col("size") > 0) & (2 * s + F.col("size") < 2 * F.col("target")) for s in starts]
    spots = F.filter(F.array(*(F.when(t, _position(F.try_divide(s.cast("double"), F.col("target")), F.col("weight"), ramps)) for s, t in zip(starts, taken, strict=True))), lambda p: p.isNotNull())
    placed = placed.withColumn("positions", spots).withColumn("copies", F.size("positions"))
    extra = [] if row_col is None else ["row"]
    return placed.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "positions", *extra)


def mixed_stream(plan: DataFrame) -> DataFrame:
    """The plan's copies, one row each, range-sorted by training position."""
    copies = plan.select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    return copies.repartitionByRange("position", "id", "copy").sortWithinPartitions("position", "id", "copy")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents as often as the mix takes them, whole rows, range-sorted by training position."""
    number = "row"
    while number in docs.columns:
        number += "_"
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    plan = plan_mix(numbered, id_col, source_col, text_col, row_col=number, **options).where("copies > 0")
    spots = plan.select(F.col("row").alias("__row"), F.posexplode("positions").alias("__copy", "__position"))
    joined = numbered.join(spots, F.col(number) == F.col("__row"))
    order = ("__position", number, "__copy")
    return joined.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)

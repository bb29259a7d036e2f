"""Candidate pairs of parties that share a key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldleaf.functions.kernels import filled

#: Kind of key and the column that has it.
KEYS = {
    "email": "email_normalized",
    "phone": "phone_e164",
    "name_sorted": "name_sorted_key",
    "name_phonetic": "name_phonetic_key",
    "address": "address_key",
}
#: Larger blocks aren't paired, but reported.
MAX_BLOCK = 1000
#: Parties of a cell, where blocks of any size are paired.
CELL = 500
#: Tasks for each core in which pairs meet.
TASKS = 8


def key_rows(parties: DataFrame, id_column: str = "person_id") -> DataFrame:
    """id, kind, key for every key that a party has; columns that aren't there are passed over."""
    there = [(kind, column) for kind, column in KEYS.items() if column in parties.columns]
    keys = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(column).alias("key")) for kind, column in there))
    return parties.select(F.col(id_column).alias("id"), keys.alias("keys")).select("id", F.inline_outer("keys")).where(filled(F.col("key")))


def block_sizes(parties: DataFrame, id_column: str = "person_id") -> DataFrame:
    """kind, key, n of every block."""
    return key_rows(parties, id_column).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


def block_pairs(parties: DataFrame, id_column: str = "person_id", max_block: int | None = MAX_BLOCK) -> DataFrame:
    """left_id < right_id and the kinds of key that they share, joined by '+'.

    The keys of all kinds are paired in one join; a block of one makes no pair and one beyond
    ``max_block`` is left out, so both are taken away before it. With ``max_block=None`` no block is
    left out: large ones are cut into cells of about ``CELL`` parties, and each pair of cells is
    joined under a key of its own, so that no task pairs a whole block.
    """
    rows = key_rows(parties, id_column)
    sizes = rows.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    if max_block is not None:
        sizes = sizes.where(F.col("n") <= max_block).withColumn("n", F.lit(1))
    cells = F.ceil(F.col("n") / CELL).cast("int")
    rows = rows.join(sizes.select("kind", "key", cells.alias("cells")), ["kind", "key"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    met = rows.select("id", "kind", "key", "own", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    met = met.select("id", "kind", "key", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    left = met.select("kind", "key", "x", "y", F.col("id").alias("left_id"), F.col("own").alias("left_own"))
    right = met.select("kind", "key", "x", "y", F.col("id").alias("right_id"), F.col("own").alias("right_own"))
    pairs = left.join(right, ["kind", "key", "x", "y"]).where("left_id < right_id and (x = y or left_own <> right_own)")
    return pairs.groupBy("left_id", "right_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("blocking_keys"))


def met_pairs(parties: DataFrame, columns: Sequence[str], id_column: str = "person_id", max_block: int = MAX_BLOCK) -> DataFrame:
    """The rows of :func:`block_pairs` with both sides' ``columns`` as ``l_`` and ``r_`` columns; no pair is shuffled.

    Parties take their attributes into each of their blocks, and know by a bit for each kind which of their
    blocks are paired. So a pair knows all keys that it shares wherever it meets, and stays in the first of them.
    """
    spark = parties.sparkSession
    kinds = [(n, kind, column) for n, (kind, column) in enumerate(KEYS.items()) if column in parties.columns]
    columns = list(dict.fromkeys([*columns, *(column for _, _, column in kinds)]))
    keys = key_rows(parties, id_column)
    paired = keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, max_block))
    number = F.create_map(*(F.lit(x) for n, kind, _ in kinds for x in (kind, n)))
    own = keys.join(paired.select("kind", "key"), ["kind", "key"]).select("id", F.try_element_at(number, F.col("kind")).alias("block"), "key")
    own = own.groupBy("id").agg(F.collect_list(F.struct("block", "key")).alias("blocks"), F.sum(F.pow(F.lit(2), F.col("block")).cast("int")).cast("int").alias("bits"))
    rows = parties.select(F.col(id_column).alias("id"), *columns).join(own, "id").select("id", "bits", *columns, F.inline("blocks"))
    # More tasks than AQE would make of these bytes: the work is in the pairs that come of them.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS * spark.sparkContext.defaultParallelism)
    rows = rows.repartition(tasks, "block", "key")
    left, right = (rows.select("block", "key", F.col("id").alias(f"{side}_id"), F.col("bits").alias(f"{side}_bits"), *(F.col(c).alias(f"{side[0]}_{c}") for c in columns)) for side in ("left", "right"))
    met = left.join(right, ["block", "key"])
    both = F.col("left_bits").bitwiseAND(F.col("right_bits"))
    shared: dict[str, Column] = {kind: (both.bitwiseAND(F.lit(1 << n)) != 0) & (F.col(f"l_{column}") == F.col(f"r_{column}")) for n, kind, column in kinds}
    first = reduce(lambda rest, x: F.when(shared[x[1]], x[0]).otherwise(rest), reversed(kinds), F.lit(-1))
    met = met.where((F.col("left_id") < F.col("right_id")) & (F.col("block") == first))
    names = F.concat_ws("+", *(F.when(shared[kind], kind) for kind in sorted(shared)))
    return met.withColumn("blocking_keys", names).drop("block", "key", "left_bits", "right_bits")


def blocking_report(parties: DataFrame, id_column: str = "person_id", max_block: int = MAX_BLOCK) -> DataFrame:
    """One row for each kind: blocks, pairs before union, dropped blocks and pairs, the largest block."""
    n = F.col("n")
    pairs = (n * (n - 1) / 2).cast("long")
    return (
        block_sizes(parties, id_column)
        .groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("blocks"),
            F.coalesce(F.sum(F.when(n <= max_block, pairs)), F.lit(0)).alias("pairs"),
            F.count_if(n > max_block).alias("dropped_blocks"),
            F.coalesce(F.sum(F.when(n > max_block, pairs)), F.lit(0)).alias("dropped_pairs"),
            F.max("n").alias("largest_block"),
        )
    )


def reduction(parties: DataFrame, pairs: DataFrame) -> DataFrame:
    """parties, naive_pairs, candidate_pairs, reduction_ratio in one row."""
    n = F.col("parties")
    counted = parties.agg(F.count(F.lit(1)).alias("parties")).crossJoin(pairs.agg(F.count(F.lit(1)).alias("candidate_pairs")))
    naive = (n * (n - 1) / 2).cast("long")
    return counted.select("parties", naive.alias("naive_pairs"), "candidate_pairs", F.round(naive / F.greatest(F.col("candidate_pairs"), F.lit(1)), 6).alias("reduction_ratio"))

"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

1. Every document becomes its set of word shingles, a 128-bit digest of it, and the band keys of its
   circulant signature; documents with equal sets collapse to the one with the least id.
2. Band keys make buckets. In small buckets the pairs of documents are named once each. Each document
   of large ones is dealt to one block in each of its first ``CHAINS`` large buckets, beside that
   bucket's pivots; blocks are compared inside a task. Rows are in proportion to the documents.
3. Components of the links so far are found. A large bucket whose documents are all in one component
   is done; of the others, only documents outside of the bucket's largest component are compared,
   block by block, with the documents of other components. No bucket is capped and no pair lost.
4. Sets are made again from the whole texts of candidates only, and each link is confirmed on them.
5. Components of all links are found by star contraction.

Blocks are bounded in documents and in shingles. Many documents that share a bucket and are truly
not linked cost the square of their number in arithmetic, and that over ``BLOCK`` in rows.

With 60 bands of 7 coordinates a pair at the threshold of 0.8 shares no band with probability
``(1 - 0.8**7)**60``, about 7e-7; with 45 bands of 8 it is 6e-7 at 0.85. Everything else is exact.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; very long texts give their whole set; rows without an id have no component unless an
identified document has the same set, and are kept then only; rows that repeat an id are one node;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldleaf.operators.clustering import components

from . import minhash_kernel as kernel
from .common import Scratch, stored

WIDTH = 5
BANDS, ROWS = 60, 7
THRESHOLD = (80, 100)

#: Buckets of at most SMALL documents name their pairs; larger ones are compared in blocks of BLOCK
#: documents, or of BLOCK_SHINGLES if these are fewer.
SMALL, BLOCK, BLOCK_SHINGLES = 16, 256, 1 << 20
#: Large buckets in which a document is compared before components are looked at, and their pivots.
CHAINS, PIVOTS = 3, 8

SKETCH = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n (set size), hi and lo (digest of the set), bands (null without words) of each document."""

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, hi, lo, keys = [], [], [], []
            for text in part.column(1):
                found = kernel.shingle_set(text.as_py(), width)
                digest = kernel.set_digest(found) if len(found) else (None, None)
                n.append(len(found))
                hi.append(digest[0])
                lo.append(digest[1])
                keys.append(kernel.band_keys(kernel.signature(found, bands * rows), bands, rows) if len(found) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip((n, hi, lo, keys), SKETCH.types[1:], strict=True))], schema=SKETCH)

    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(sketch, "id long, n long, hi long, lo long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id and the set (sorted 64-bit hashes as bytes) of the documents whose id is wanted."""

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [kernel.shingle_set(text.as_py(), width).tobytes() for text in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["id", "shingles"])

    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    # The same join at every size: the texts are dealt out once, whatever the number of candidates.
    return narrow.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(build, "id long, shingles binary")


def _linked(shared: int, a: int, b: int, threshold: tuple[int, int]) -> bool:
    return threshold[1] * shared >= threshold[0] * (a + b - shared)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def test(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good = []
            for x, y in zip(part.column(2), part.column(3), strict=True):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                good.append(_linked(kernel.overlap(a, b), len(a), len(b), threshold))
            yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("y"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(test, "u long, v long")


def _forest(ids: np.ndarray, sets: list[np.ndarray], asked: np.ndarray, threshold: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that join whatever is linked among the pairs for which the matrix ``asked`` holds.

    Overlaps are counted over the shingles that two or more members share, a slice of members at a time.
    """
    sizes = np.array([len(s) for s in sets])
    everything = np.concatenate(sets)
    _, where, count = np.unique(everything, return_inverse=True, return_counts=True)
    shared = count >= 2
    column = np.cumsum(shared) - 1
    member = np.repeat(np.arange(len(sets)), sizes)
    use = shared[where]
    member, place = member[use], column[where[use]]
    order = np.argsort(place, kind="stable")
    member, place = member[order], place[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        here = slice(*np.searchsorted(place, (at, at + 4096)))
        bits = np.zeros((len(sets), 4096), np.float32)
        bits[member[here], place[here] - at] = 1
        total += bits @ bits.T
    union = sizes[:, None] + sizes[None, :] - total
    link = (threshold[1] * total >= threshold[0] * union) & asked & (np.tri(len(sets), k=-1) > 0)
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(link), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(ids[a]), int(ids[b])))
    return out


def _compared(groups: DataFrame, by: tuple[str, ...], sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links (u, v) inside groups of rows (by, id, kin): between members of different kin, or of any if it is null."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id")
        kin = rows["kin"].to_numpy()
        asked = np.ones((len(kin), len(kin)), bool) if rows["kin"].isna().all() else kin[:, None] != kin[None, :]
        found = _forest(rows["id"].to_numpy(np.int64), [np.frombuffer(s, np.uint64) for s in rows["shingles"]], asked, threshold)
        return pd.DataFrame(found, columns=["u", "v"], dtype=np.int64)

    return groups.join(sets, "id").groupBy(*by).applyInPandas(compare, "u long, v long")


def _blocks(documents: Column, shingles: Column) -> Column:
    """Number of blocks for so many documents with so many shingles."""
    return F.greatest(F.ceil(documents / F.lit(BLOCK)), F.ceil(shingles / F.lit(BLOCK_SHINGLES))).cast("int")


def _chained(large: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links inside blocks of the first large buckets of each document: rows are ``CHAINS`` a document, and pivots."""
    # Buckets of a document by key; at most one for each band, so a window over few rows.
    rank = F.row_number().over(Window.partitionBy("id").orderBy("key"))
    first = large.withColumn("rank", rank).where(F.col("rank") <= CHAINS).select("key", "id", "m", "shingles_m")
    dealt = first.withColumn("blocks", _blocks(F.col("m"), F.col("shingles_m")))
    dealt = dealt.withColumn("x", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    # The least ids of a bucket stand in each of its blocks.
    least = _least_ids(first.select("key", "id"), PIVOTS)
    blocks = dealt.select("key", "x").distinct()
    pivots = blocks.join(least, "key").select("key", "x", F.explode("least").alias("id"))
    groups = dealt.select("key", "x", "id").unionByName(pivots).withColumn("kin", F.lit(None).cast("long"))
    return _compared(groups, ("key", "x"), sets, threshold)


def _least_ids(rows: DataFrame, n: int) -> DataFrame:
    """key, least: ``n`` small ids of each bucket, the least one among them, from the minima of its slices."""
    sliced = rows.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(8 * n)).alias("slice")).agg(F.min("id").alias("id"))
    return sliced.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("id")), 1, n).alias("least"))


def _crossed(large: DataFrame, found: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links between components inside large buckets: what isn't of a bucket's largest component meets all others."""
    own = large.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("kin", F.coalesce("component", "id"))
    kins = own.groupBy("key", "kin").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    # The largest component of each bucket, and what lies outside of it.
    heads = kins.groupBy("key").agg(F.max(F.struct("members", "weight", "kin")).alias("head"), F.sum("members").alias("members"), F.sum("weight").alias("weight"))
    heads = heads.where("members > head.members").select(
        "key",
        F.col("head.kin").alias("head"),
        _blocks(F.col("head.members"), F.col("head.weight")).alias("head_blocks"),
        _blocks(F.col("members") - F.col("head.members"), F.col("weight") - F.col("head.weight")).alias("rest_blocks"),
    )
    open_ = stored(own.join(stored(heads, "heads", narrow=True), "key").select("key", "id", "kin", F.col("kin") == F.col("head"), "head_blocks", "rest_blocks").toDF("key", "id", "kin", "major", "head_blocks", "rest_blocks"), "open", narrow=True)
    rest = open_.where("not major").withColumn("own", F.pmod(F.xxhash64("id"), F.col("rest_blocks")).cast("int"))
    head = open_.where("major").withColumn("own", F.pmod(F.xxhash64("id"), F.col("head_blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("rest_blocks") - 1)
    # Groups (rest block x, rest block y >= x), and (rest block x, head block y) with y counted from -1 downwards.
    among = rest.select("key", "id", "kin", "own", F.explode(every).alias("other")).select("key", "id", "kin", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    ahead = head.select("key", "id", "kin", F.explode(every).alias("x"), (-F.col("own") - 1).alias("y"))
    towards = rest.select("key", "id", "kin", F.col("own").alias("x"), F.explode(F.sequence(F.lit(1), F.col("head_blocks"))).alias("y")).withColumn("y", -F.col("y"))
    return _compared(among.unionByName(ahead).unionByName(towards), ("key", "x", "y"), sets, threshold)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    bands: int = BANDS,
    rows: int = ROWS,
    threshold: tuple[int, int] = THRESHOLD,
) -> DataFrame:
    """id, n_shingles, component_id, kept of each document; links need ``threshold`` (part, whole) of the union."""
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_near_duplicates(docs, id_col, text_col, width, bands, rows, threshold), "near")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, threshold: tuple[int, int]) -> DataFrame:
    sketched = stored(sketches(docs, id_col, text_col, width, bands, rows), "sketch")

    # Equal sets: one representative, the least id.
    worded = sketched.where("n > 0")
    chosen = worded.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # Stored, so that the join below has an exchange right under each side and Spark can split the
    # rows of a large group of copies over many tasks.
    copies = stored(chosen.where("copies > 1").drop("copies"), "copies", narrow=True)
    members = worded.select("id", "n", "hi", "lo", "bands").join(copies, ["hi", "lo"], "left").withColumn("rep", F.coalesce("rep", "id"))
    members = stored(members.select("id", "n", "rep", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")), "members", narrow=True)

    # Buckets of two and more.
    banded = members.where("bands is not null").select("id", "n", F.explode("bands").alias("key"))
    sized = stored(banded.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles_m")).where("m > 1"), "sizes", narrow=True)
    bucketed = stored(banded.join(sized, "key"), "buckets", narrow=True)

    fits = F.least("a.n", "b.n") * threshold[1] >= F.greatest("a.n", "b.n") * threshold[0]
    listed = bucketed.where(F.col("m") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("all"))
    pairs = listed.select(F.posexplode("all").alias("at", "a"), "all").select("a", F.explode(F.slice("all", F.lit(1), F.col("at"))).alias("b"))
    pairs = stored(pairs.where(fits).where("a.id <> b.id").select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct(), "pairs", narrow=True)
    large = bucketed.where(F.col("m") > SMALL).select("key", "id", "n", "m", "shingles_m")

    wanted = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).unionByName(large.select("id")).distinct()
    sets = stored(_sets(docs, wanted, id_col, text_col, width).dropDuplicates(["id"]), "sets")
    found = components(_verified(pairs, sets, threshold).unionByName(_chained(large, sets, threshold)))
    crossed = _crossed(large, found, sets, threshold)
    # A component's links are those to its least node, which stands for it from here on.
    found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(crossed))

    placed = members.select("id", "n", "rep").join(found, F.col("rep") == F.col("node"), "left")
    placed = placed.select("id", "n", F.coalesce("component", "rep").alias("component_id"))
    wordless = sketched.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = placed.unionByName(wordless).select("id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()))

"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

A line's key is its text without leading or trailing space and U+0009 to U+000D, A-Z lower-cased;
keys are held as 128-bit digests. The exact tables say, for each key, how many documents hold it and
the largest id of these. Each shard of the key space has a cuckoo filter of the keys in its table:
an arriving key that the filter doesn't know is new and skips the exact lookup, one that it may know
is looked up. Removing documents takes their references back and, at zero, the key and its
fingerprint, which a Bloom filter could not do. Keys arrive added up (one row a key and batch), so a
line that every document holds is one row in its shard. Shards split in two when they hold more than
``KEYS_PER_SHARD`` keys on average.

:func:`dedup_lines` inserts its table in ``BATCHES`` batches dealt by a hash of the id, so all
batches but the first meet filled filters; the index after the last one says which lines go.

Defined results: a null or empty text is one empty line; very long texts are split whole; each input
row is a document (rows that repeat an id add references each, and all keep the line if the id is
the largest); a null id is smaller than any other; ``min_docs`` and ``min_chars`` are inclusive; an
empty table gives an empty result; columns other than ``id_col`` and ``text_col`` pass through in
:func:`dedup_lines`, but for columns named ``n_lines`` and ``n_dropped``, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored, with_columns

BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
KEYS_PER_SHARD = 100_000
SHARDS = 16
BATCHES = 3
NO_ID = -(1 << 63)  # in the exact tables, below any id
SLOTS = 4


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Digest of a UTF-8 line's key; None where the key is too short to count."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; the two buckets of a key differ by a hash of its fingerprint."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets  # a power of two
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(1 << max(3, int(np.ceil(np.log2(max(n, 1) / (SLOTS * 0.8))))))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        slots = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(slots), slots)

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = lo.view(np.uint64)
        mark = ((x >> np.uint64(48)).astype(np.uint16) | np.uint16(1)).astype(np.uint16)
        first = (x & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mark.astype(np.int64) * 0x5BD1E995 & (self.buckets - 1))

    def contains(self, lo: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(lo)
        return (self.slots[a] == mark[:, None]).any(axis=1) | (self.slots[b] == mark[:, None]).any(axis=1)

    def insert(self, lo: np.ndarray) -> bool:
        """Put keys in, all at once; False (and a filter to throw away) if they don't fit."""
        mark, bucket, other = self._places(lo)
        rng = np.random.default_rng(len(lo))
        mark, bucket = self._settle(mark, bucket)
        if len(mark):
            mark, bucket = self._settle(mark, self._other(bucket, mark))
        for _ in range(500):
            if not len(mark):
                return True
            # Homeless fingerprints, one a bucket, throw out a random slot; the rest wait.
            _, chosen = np.unique(bucket, return_index=True)
            waiting = np.ones(len(mark), bool)
            waiting[chosen] = False
            slot = rng.integers(0, SLOTS, len(chosen))
            out = self.slots[bucket[chosen], slot]
            self.slots[bucket[chosen], slot] = mark[chosen]
            moved, target = self._settle(out, self._other(bucket[chosen], out))
            mark, bucket = np.concatenate([moved, mark[waiting]]), np.concatenate([target, bucket[waiting]])
        return not len(mark)

    def _settle(self, mark: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fill free slots of the given buckets; what found none comes back."""
        order = np.argsort(bucket, kind="stable")
        mark, bucket = mark[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
        rank = np.arange(len(bucket)) - np.repeat(starts, np.diff(np.r_[starts, len(bucket)]))
        free = self.slots[bucket] == 0
        nth = np.cumsum(free, axis=1) == rank[:, None] + 1
        hit = (nth & free).any(axis=1)
        self.slots[bucket[hit], (nth & free)[hit].argmax(axis=1)] = mark[hit]
        return mark[~hit], bucket[~hit]

    def remove(self, lo: np.ndarray) -> None:
        """Take out one fingerprint of each key; only for keys that are in."""
        for mark, a, b in zip(*self._places(lo), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.slots[bucket] == mark)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break


@dataclass
class LineIndex:
    """Stored references (hi, lo, id) and the sharded state that sums them up."""

    references: DataFrame
    state: DataFrame | None = None  # shard, hi, lo, refs, keeper; one more row a shard has the filter
    shards: int = SHARDS

    def counts(self) -> DataFrame:
        return self.state.where("filter is null").select("hi", "lo", "refs", F.nullif("keeper", F.lit(NO_ID)).alias("keeper"))

    def asked(self) -> tuple[int, int]:
        """Of the keys of the last batch: how many were looked up in the exact tables, and how many the filters spared that."""
        return tuple(self.state.where("filter is not null").agg(F.coalesce(F.sum("refs"), F.lit(0)), F.coalesce(F.sum("keeper"), F.lit(0))).first())

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        new = stored(references(docs, id_col, text_col), "lines")
        return replace(self, references=self.references.unionByName(new)).counted(new)

    def counted(self, new: DataFrame) -> LineIndex:
        """The index after adding up references that it holds already."""
        return self._with(_summed(new).withColumn("recount", F.lit(False)))

    def remove(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Take the documents with these ids out again: the index is as if they had never come."""
        gone = ids.select(ids[id_col].cast("long").alias("gone")).distinct()
        matches = self.references["id"].eqNullSafe(gone["gone"])
        left = stored(self.references.join(gone, matches, "left_anti"), "left")
        touched = self.references.join(gone, matches, "left_semi").select("hi", "lo").distinct()
        still = _summed(left.join(touched, ["hi", "lo"], "left_semi"))
        changes = touched.join(still, ["hi", "lo"], "left").withColumns({"refs": F.coalesce("refs", F.lit(0)), "keeper": F.coalesce("keeper", F.lit(NO_ID)), "recount": F.lit(True)})
        return replace(self, references=left)._with(changes.select("hi", "lo", "refs", "keeper", "recount"))

    def _with(self, changes: DataFrame) -> LineIndex:
        """Apply key sums: added to what is there, or put in its place where ``recount`` is set."""
        place = F.pmod(F.xxhash64("hi"), F.lit(self.shards)).cast("int")
        new = changes.withColumn("shard", place).groupBy("shard")
        if self.state is None:
            merged = new.applyInPandas(lambda key, rows: _merge_shard(key[0], None, rows), STATE)
        else:
            # After a split the filter rows of the halves are gone and are made again from the exact rows.
            old = self.state.where(F.col("filter").isNull() | (F.col("of") == self.shards))
            old = old.withColumn("shard", F.when(F.col("filter").isNull(), place).otherwise(F.col("shard"))).groupBy("shard")
            merged = old.cogroup(new).applyInPandas(lambda key, held, rows: _merge_shard(key[0], held, rows), STATE)
        state = stored(merged.withColumn("of", F.lit(self.shards)), "state")
        shards = self.shards
        while state.where("filter is null").count() > shards * KEYS_PER_SHARD:
            shards *= 2
        return replace(self, state=state, shards=shards)

    def drops(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """id and the keys whose lines it loses."""
        often = self.counts().where((F.col("refs") >= min_docs) & F.col("keeper").isNotNull()).select("hi", "lo", "keeper")
        lost = self.references.join(often, ["hi", "lo"]).where("id is null or id < keeper")
        return lost.groupBy("id").agg(F.collect_set(F.struct("hi", "lo")).alias("keys"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> LineIndex:
    """Insert a whole table into an empty index, in batches dealt by a hash of the id."""
    index = LineIndex(stored(references(docs, id_col, text_col), "lines"))
    for batch in range(batches):
        index = index.counted(index.references.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == batch))
    return index


def references(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """hi, lo, id: one row for each document and key of one of its lines."""

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, keys = [], []
            for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = text.as_py()
                if text:
                    found = {line_key(x) for x in text.encode("utf-8", "surrogatepass").split(b"\n")} - {None}
                    keys += found
                    ids += [i] * len(found)
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64())], names=["hi", "lo", "id"])

    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(split, "hi long, lo long, id long")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("refs"), F.max(F.coalesce("id", F.lit(NO_ID))).alias("keeper"))


STATE = "shard int, hi long, lo long, refs long, keeper long, filter binary"


def _merge_shard(shard: int, old: pd.DataFrame | None, new: pd.DataFrame) -> pd.DataFrame:
    """The shard's exact rows after a batch, and its filter with the batch's count of lookups and of keys spared one."""
    columns = ["hi", "lo", "refs", "keeper"]
    if old is None or not len(old):
        table, seen = new[columns].iloc[:0], CuckooFilter.for_keys(len(new))
    else:
        held = old["filter"].notna()
        table = old.loc[~held, columns]
        seen = CuckooFilter.from_bytes(old.loc[held, "filter"].iloc[0]) if held.any() else _filled(table)
    maybe = seen.contains(new["lo"].to_numpy(np.int64)) if len(new) else np.zeros(0, bool)
    fresh, known = new[~maybe], new[maybe]
    if len(known):  # the exact lookup; a false positive of the filter finds nothing and is fresh
        both = known.merge(table[columns], on=["hi", "lo"], suffixes=("", "_old"))
        absent = known.merge(both[["hi", "lo"]].assign(there=1), on=["hi", "lo"], how="left")["there"].isna().to_numpy()
        fresh = pd.concat([fresh, known[absent]])
        recount = both["recount"].to_numpy(bool)
        refs = np.where(recount, both["refs"], both["refs"] + both["refs_old"])
        keeper = np.where(recount, both["keeper"], np.maximum(both["keeper"], both["keeper_old"]))
        table = pd.concat([table, both[["hi", "lo"]].assign(refs=refs, keeper=keeper)]).drop_duplicates(["hi", "lo"], keep="last")
        gone = table["refs"].to_numpy(np.int64) <= 0
        if gone.any():
            seen.remove(table.loc[gone, "lo"].to_numpy(np.int64))
            table = table[~gone]
    fresh = fresh.loc[fresh["refs"] > 0, columns]
    table = pd.concat([table, fresh]) if len(table) else fresh
    if not seen.insert(fresh["lo"].to_numpy(np.int64)):  # too full: build a larger one from the exact table
        seen = _filled(table)
    out = table.assign(shard=np.int32(shard), filter=None)[["shard", "hi", "lo", "refs", "keeper", "filter"]]
    last = pd.DataFrame({"shard": [np.int32(shard)], "hi": [0], "lo": [0], "refs": [int(maybe.sum())], "keeper": [int((~maybe).sum())], "filter": [seen.to_bytes()]})
    return pd.concat([out, last], ignore_index=True)


def _filled(table: pd.DataFrame) -> CuckooFilter:
    seen = CuckooFilter.for_keys(2 * len(table))
    while not seen.insert(table["lo"].to_numpy(np.int64)):
        seen = CuckooFilter(2 * seen.buckets)
    return seen


def without_lines(text: str | None, keys: set[bytes], min_chars: int = MIN_CHARS) -> tuple[str, int, int]:
    """The text less the lines with these keys, its number of lines, and how many went."""
    text = text or ""
    if not keys:
        return text, text.count("\n") + 1, 0
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    kept = [x for x in lines if line_key(x, min_chars) not in keys]
    return b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with text_col less its repeated lines, and n_lines (before) and n_dropped."""
    with Scratch(docs.sparkSession) as scratch:
        drops = scratch.result(build_index(docs, id_col, text_col).drops(min_docs), "drops", narrow=False)
    drops = drops.select(F.col("id").alias("__id"), F.transform("keys", lambda k: F.concat(F.hex(k["hi"]), F.lit("."), F.hex(k["lo"]))).alias("__keys"))
    joined = docs.join(drops, docs[id_col].eqNullSafe(drops["__id"]), "left").drop("__id")

    joined = joined.withColumn(text_col, F.col(text_col).cast("string"))
    rewritten = with_columns(joined, [text_col, "__keys"], lambda text, keys: without_lines(text, _digests(keys)), f"`{text_col}` string, n_lines long, n_dropped long")
    return rewritten.drop("__keys")


def _digests(keys) -> set[bytes]:
    if keys is None:
        return set()
    return {b"".join(int(x, 16).to_bytes(8, "little") for x in k.split(".")) for k in keys}

"""Exact deduplication by a log-structured merge index of text digests, in DataFrame operations only.

Memtables (the rows of one input partition each, so of bounded size) are flushed in ``FAN_IN`` runs;
a run has one entry (digest, keep_id, entries) for each of its digests, sorted by digest, and a
bitmap filter. Compaction merges the runs two by two, level by level: an entry that the other run's
filter doesn't know passes on as it is, and only what both filters may know is merged, where the
smallest (or largest) identifier stays. The last level has a filter of the digests that more than one
row holds. Rows that it doesn't know are single and are looked up nowhere, and their texts are never
shuffled; the others are looked up in the level, and every hit is held against the keeper's text
byte by byte.

A filter has ``BITS_PER_ENTRY`` bits for each of its digests but at most ``MAX_BITS`` (16 MB), so
sending it to all executors has a proven bound; a fuller filter lets more rows through to the exact
lookup and changes no result.

Defined results: a null text counts as empty; very long texts are compared whole; rows with a null
id never outrank rows with one, and a group of null ids only has a null keeper; rows that repeat id
and text are one document, flagged alike, and count each in the group's size; an empty table gives
an empty result; columns other than ``id_col`` and ``text_col`` are never read, so their names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored

BITS_PER_ENTRY = 16
#: Bits of the largest filter: 2**27, or 16 MB.
MAX_BITS = 1 << 27
#: Runs that the memtables are flushed in.
FAN_IN = 4
#: Bits of one row of a bitmap.
_ROW = 32768


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@dataclass(frozen=True)
class Filters:
    """Bitmaps of the digests of each run, in rows (of_run, bucket, bitmap)."""

    rows: DataFrame
    bits: int

    @classmethod
    def of(cls, entries: DataFrame) -> Filters:
        most = entries.groupBy("run").count().agg(F.max("count")).first()[0] or 0
        bits = min(MAX_BITS, max(_ROW, BITS_PER_ENTRY * most))
        place = _place(bits)
        marked = entries.select(F.col("run").alias("of_run"), F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        return cls(marked.groupBy("of_run", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap")), bits)

    def tested(self, rows: DataFrame, run: Column) -> DataFrame:
        """``rows`` with a column ``maybe``: false only where the digest isn't in the filter of ``run``."""
        place = _place(self.bits)
        byte = "cast(conv(hex(substring(bitmap, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)"
        passed = F.coalesce(F.expr(f"(shiftright({byte}, cast(bit % 8 as int)) & 1) = 1"), F.lit(False))
        placed = rows.select("*", run.alias("asked_run"), F.bitmap_bucket_number(place).alias("asked_bucket"), F.bitmap_bit_position(place).alias("bit"))
        # At most MAX_BITS / 8 bytes for each run go to an executor.
        joined = placed.join(F.broadcast(self.rows), (F.col("asked_run") == F.col("of_run")) & (F.col("asked_bucket") == F.col("bucket")), "left")
        return joined.select(*rows.columns, passed.alias("maybe"))


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + F.lit(1)


class DigestIndex:
    """Entries (run, digest, keep_id, entries); compaction merges all runs to one level, run 0."""

    def __init__(self, keep: str = "min", fan_in: int = FAN_IN):
        if keep not in ("min", "max"):
            raise ValueError(f"keep is 'min' or 'max', not {keep!r}")
        self.extreme = F.max if keep == "max" else F.min
        self.fan_in = fan_in
        self.entries: DataFrame | None = None
        self.runs = 0
        self.repeated: Filters | None = None

    def flush(self, rows: DataFrame) -> None:
        """Write rows (id, digest, memtable) as sorted runs; memtable m goes to run m modulo ``fan_in``."""
        dealt = rows.withColumn("run", (F.pmod("memtable", F.lit(self.fan_in)) + F.lit(self.runs)).cast("int"))
        made = dealt.groupBy("run", "digest").agg(self.extreme("id").alias("keep_id"), F.count(F.lit(1)).alias("entries"))
        new = stored(made.sortWithinPartitions("run", "digest"), "runs", narrow=True)
        self.entries = new if self.entries is None else self.entries.unionByName(new)
        self.runs += self.fan_in
        self.repeated = None

    def crossed(self) -> DataFrame:
        """The entries, and whether their neighbour (run 1 for 0, 2 for 3 and so on) may have their digest too."""
        return Filters.of(self.entries).tested(self.entries, F.col("run").bitwiseXOR(F.lit(1)))

    def compact(self) -> DataFrame:
        """Merge neighbouring runs, level by level, until one is left; then build the filter of its repeated digests."""
        while self.runs > 1:
            tested = self.crossed().withColumn("run", F.floor(F.col("run") / 2).cast("int"))
            merged = tested.where("maybe").groupBy("run", "digest").agg(self.extreme("keep_id").alias("keep_id"), F.sum("entries").alias("entries"))
            level = merged.unionByName(tested.where("not maybe").drop("maybe"))
            self.entries = stored(level.sortWithinPartitions("run", "digest"), "level", narrow=True)
            self.runs = (self.runs + 1) // 2
        self.repeated = Filters.of(self.entries.where("entries > 1"))
        return self.entries

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with a digest that may be repeated, and those of single digests."""
        if self.repeated is None:
            self.compact()
        tested = self.repeated.tested(rows, F.lit(0))
        return tested.where("maybe").drop("maybe"), tested.where("not maybe").drop("maybe")

    def probe(self, rows: DataFrame) -> DataFrame:
        """Rows (id, digest) with keep_id and entries of their digest; null where it isn't repeated."""
        maybe, single = self.split(rows.select("id", "digest"))
        hit = self.entries.where("entries > 1").select(F.col("digest").alias("known"), "keep_id", "entries")
        found = maybe.join(hit, F.col("digest") == F.col("known"), "left").select("id", "digest", "keep_id", "entries")
        id_type = found.schema["keep_id"].dataType
        return found.unionByName(single.select("id", "digest", F.lit(None).cast(id_type).alias("keep_id"), F.lit(None).cast("long").alias("entries")))


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row for each input row: id, digest, keep_id, group_size, kept."""
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_exact_duplicates(docs, id_col, text_col, keep, digest), "exact")


def _exact_duplicates(docs: DataFrame, id_col: str, text_col: str, keep: str, digest: Callable[[Column], Column]) -> DataFrame:
    whole = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    whole = whole.withColumn("digest", digest(F.col("text")))
    rows = stored(whole.select("id", "digest", F.spark_partition_id().alias("memtable")), "memtables")
    index = DigestIndex(keep)
    index.flush(rows)
    index.compact()
    found = stored(index.probe(rows), "probed", narrow=True)
    hits = found.where("entries > 1")

    # Byte verification: the texts of hits only, each against its keeper's text. The filter is asked
    # again where the texts are read, so that other texts aren't shuffled.
    wanted = hits.select(F.col("id").alias("hit_id"), F.col("digest").alias("hit_digest"), "keep_id").distinct()
    candidates, _ = index.split(whole)
    hit_texts = stored(
        candidates.join(wanted, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest"))).select("id", "digest", "keep_id", "text"),
        "hits",
    )
    # Both sides of this join are stored and nothing that needs a digest's rows together stands
    # above it, so Spark can split the rows of a large group over many tasks.
    keepers = stored(hit_texts.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("keeper_text")), "keepers")
    different = stored(hit_texts.join(keepers, "digest").where("text <> keeper_text").select("digest"), "different", narrow=True)
    collided = different.distinct()
    apart = hit_texts.join(collided, "digest", "left_semi")
    by_text = apart.groupBy("digest", "text").agg(index.extreme("id").alias("true_keep"), F.count(F.lit(1)).alias("true_size"))
    mended = (
        apart.join(by_text, ["digest", "text"])
        .groupBy(F.col("id").alias("mend_id"), F.col("digest").alias("mend_digest"))
        .agg(F.min(F.struct("true_keep", "true_size")).alias("mend"))
    )

    out = found.join(mended, found.id.eqNullSafe(mended.mend_id) & (found.digest == mended.mend_digest), "left")
    keep_id = F.when(F.col("mend").isNotNull(), F.col("mend.true_keep")).when(F.col("entries").isNotNull(), F.col("keep_id")).otherwise(F.col("id"))
    return out.select(
        "id",
        "digest",
        keep_id.alias("keep_id"),
        F.coalesce("mend.true_size", "entries", F.lit(1)).cast("long").alias("group_size"),
    ).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))

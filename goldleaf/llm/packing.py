"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Documents are cut into pieces (only those longer than a sequence; the first piece takes the short
rest) and range-sorted by length, which gives every piece its rank among those of its length. Gaps
and waiting pieces are kept as sorted runs of equal length, so the state of a superstep has at most
one run for each length up to the sequence length, whatever the number of documents. A superstep
takes the longest waiting run and sweeps the gap runs from its successor (the smallest gap that
holds it) upwards; pieces and gaps of two runs that meet are matched by rank, the first with the
first, so no two claim the same place; the gaps shrink, and the next superstep follows. What finds
no gap opens new sequences. The plan of all supersteps is a bounded table of rank ranges, by which
every piece then finds its sequence and offset where it lies.

Defined results: a null text is empty and has the end-of-document token only; pieces are never
longer than a sequence; ties of length go by document id and piece; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LENGTH = 1024
END = 2

# The byte alphabet of byte-level BPE vocabularies: printable Latin-1 stands for itself, the other
# bytes for U+0100 onwards, in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {chr(b): b for b in _PLAIN} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}

#: How byte-level BPE cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A run of this many characters without a border between words goes to the slower library.
LONG_RUN = re.compile(r"\s{20000}|[^\W\d_]{20000}|\d{20000}|[^\w\s]{20000}")


@functools.cache
def _fast(path: str):
    """The vocabulary in a second library, with the same results in a quarter of the time; and its special tokens."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = tuple(t["content"] for t in model.get("added_tokens", []))
    ranks = {bytes(_BYTES[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("from-file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}), special


@functools.cache
def _whole(path: str):
    """The vocabulary file in its own library; loaded only where a text needs it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of the whole text, without special tokens added."""
    text = text or ""
    fast, special = _fast(path)
    if any(s in text for s in special) or len(text) >= 20000 and LONG_RUN.search(text):
        return np.array(_whole(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(fast.encode_ordinary(text), np.uint32)


def cut(total: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: all but the first are full."""
    if total <= length:
        return [(0, total)]
    first = total % length
    return ([(0, first)] if first else []) + [(at, length) for at in range(first, total, length)]


def tokenised_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids (little-endian unsigned 32 bits)."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * keep_ids)

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns: list[list] = [[] for _ in schema]
            for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids = np.append(token_ids(text.as_py(), tokenizer), np.uint32(end)).astype("<u4")
                for n, (start, size) in enumerate(cut(len(ids), length)):
                    data = ids[start : start + size].tobytes()
                    for column, value in zip(columns, (i, n, start, size, zlib.crc32(data), data), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def best_fit_plan(waiting: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (size, first rank, end rank, first sequence, pieces a sequence, offset) from counts by size.

    ``waiting`` has at most ``length`` entries. Piece number r of a size, first <= r < end, goes to
    sequence ``first sequence + (r - first) // pieces`` at ``offset + (r - first) % pieces * size``.
    """
    plan, opened = [], 0
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count) with that gap
    gaps: list[int] = []  # the gaps that have runs, ascending

    def put(gap: int, first: int, count: int) -> None:
        if gap > 0 and count:
            if gap not in runs:
                runs[gap] = []
                bisect.insort(gaps, gap)
            runs[gap].append((first, count))

    for size in sorted(waiting, reverse=True):
        rank, last = 0, waiting[size]
        while rank < last:
            at = bisect.bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, count = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first, count = length, opened, -(-(last - rank) // (length // size))
                opened += count
            each = gap // size
            full = min(count, (last - rank) // each)
            if full:
                plan.append((size, rank, rank + full * each, first, each, length - gap))
                put(gap - each * size, first, full)
                rank += full * each
            rest = last - rank
            if full < count:
                if rest:  # fewer pieces than one sequence takes
                    plan.append((size, rank, last, first + full, each, length - gap))
                    put(gap - rest * size, first + full, 1)
                    put(gap, first + full + 1, count - full - 1)
                    rank = last
                else:
                    put(gap, first + full, count - full)
    return plan


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces (doc_id, piece, length, ...) with sequence_id and offset.

    ``pieces`` should be a stored table. Nothing but counts by size and by partition and size
    reaches the driver: at most ``length`` entries more than there are partitions.
    """
    order = (F.col("length").desc(), F.col("doc_id"), F.col("piece"))
    lined = pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    lined = stored(lined.mapInArrow(_ranked, f"{fields}, part int, local_rank long"), "lined")
    counted = sorted((r["length"], r["part"], r["n"]) for r in lined.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, sizes = {}, {}
    for size, part, n in counted:
        before[part, size] = sizes.get(size, 0)
        sizes[size] = sizes.get(size, 0) + n
    if any(size > length or size < 1 for size in sizes):
        raise ValueError(f"a piece is empty or longer than {length}")
    rows = sorted(best_fit_plan(sizes, length))
    table = {size: np.array([r[1:] for r in rows if r[0] == size], np.int64) for size in sizes}
    shared = pieces.sparkSession.sparkContext.broadcast((before, table))

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, plans = shared.value
        for batch in parts:
            part, size, local = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("part", "length", "local_rank"))
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            border = np.flatnonzero(_changes(part, size))
            for a, b in zip(border, [*border[1:], len(size)], strict=True):
                rank = starts[int(part[a]), int(size[a])] + local[a:b]
                plan = plans[int(size[a])]
                row = plan[np.searchsorted(plan[:, 0], rank, side="right") - 1]
                sequence[a:b] = row[:, 2] + (rank - row[:, 0]) // row[:, 3]
                offset[a:b] = row[:, 4] + (rank - row[:, 0]) % row[:, 3] * size[a]
            kept = batch.drop_columns(["part", "local_rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    return lined.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def _changes(part: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where a run of equal partition and size begins."""
    out = np.ones(len(size), bool)
    out[1:] = (size[1:] != size[:-1]) | (part[1:] != part[:-1])
    return out


def _ranked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each size in a sorted partition."""
    seen: dict[int, int] = {}
    for batch in parts:
        size = batch.column(batch.schema.get_field_index("length")).to_numpy()
        rank = np.empty(len(size), np.int64)
        border = np.flatnonzero(_changes(size, size))
        for a, b in zip(border, [*border[1:], len(size)], strict=True):
            start = seen.get(int(size[a]), 0)
            rank[a:b] = np.arange(start, start + b - a)
            seen[int(size[a])] = start + int(b - a)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], names=[*batch.schema.names, "local_rank"])

"""Shared helpers of the corpus operators: word counts and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from goldleaf.tables import Scratch, forget, read_table, shared_dir, stored

__all__ = ["Scratch", "ascii_words", "batches", "forget", "read_table", "shared_dir", "stored", "with_columns"]


def ascii_words(column):
    """Number of runs of characters other than space and U+0009 to U+000D; a null text has none."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_columns(df: DataFrame, inputs: Sequence[str], compute: Callable, new: str, size: int = 256) -> DataFrame:
    """``df`` with the columns that ``compute`` makes from the values of ``inputs``, row by row.

    ``new`` declares them (``"kept string, n_lines long"``); a column of that name is replaced. The
    other columns pass through as Arrow buffers, and Python sees ``size`` rows at a time, so a
    worker's memory is bounded by one Arrow batch.
    """
    added = T.StructType.fromDDL(new)
    kept = [c for c in df.columns if c not in added.names]
    at = [df.columns.index(c) for c in inputs]
    keep = [df.columns.index(c) for c in kept]
    types = [to_arrow_type(f.dataType) for f in added]

    def convert(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, size):
                rows = part.slice(start, size)
                made = [compute(*values) for values in zip(*(rows.column(i).to_pylist() for i in at), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in keep), *columns], names=[*kept, *added.names])
            pa.default_memory_pool().release_unused()

    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in kept] + list(added))
    return df.mapInArrow(convert, schema)


def batches(rows: Iterable, schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of at most ``size`` rows."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

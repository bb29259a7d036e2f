"""Hashes of identifiers that must not be stored as they are."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_VARIABLE = "GOLDLEAF_ID_KEY"


class MissingKey(RuntimeError):
    """No key to hash identifiers with."""


def hash_identifier(value: str | None, id_type: str, key: bytes) -> str | None:
    """128 keyed bits of an identifier's letters and digits, in capitals, and of its type."""
    kept = "".join(c for c in (value or "").upper() if c.isalnum())
    return hashlib.blake2b(f"{id_type}\x1f{kept}".encode(), key=key, digest_size=16).hexdigest() if kept else None


def keyed_identifier_hash(value: Column, id_type: Column) -> Column:
    """The keyed hash of a column. The key is read from the workers' environment, so no plan or log holds it."""

    @F.pandas_udf("string")
    def hashed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        key = os.environ.get(KEY_VARIABLE, "").encode()
        if not key:
            raise MissingKey(f"{KEY_VARIABLE} is not set")
        for values, types in parts:
            yield pd.Series([hash_identifier(v, t, key) for v, t in zip(values, types, strict=True)], dtype=object)

    return hashed(value, id_type)

"""A training corpus from the documents table, in five stages, each written as Parquet and read by the next.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. A stage's result is written before the next stage is called, which then deletes
the tables that its predecessor kept in the shared folder. Stages handle the same odd inputs as their
operators: nulls in any column, empty and very long texts, repeated rows, extra columns and empty
tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldleaf.llm import language_id, line_dedup, minhash, mixing, packing
from goldleaf.llm.common import Scratch, read_table, stored
from goldleaf.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_before: list[Scratch] = []


def stage(f: Stage, first: bool = False) -> Stage:
    """Open a scope for the tables that a stage stores; the stage after it closes it."""

    @functools.wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _before:
            last = _before.pop()
            if not first and last.spark is spark:
                last.clear()
        scope = Scratch(spark)
        with scope.held():
            out = f(spark, docs, sf_dir)
        _before.append(scope)
        return out

    return call


@functools.partial(stage, first=True)
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter, or without text, go.

    Also with no labelled row to learn from nothing is rejected but these.
    """
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs, ~language_id.held_out(docs["doc_id"]))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language_id.identify(docs, model).where(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the lines that its corpus repeats; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates (five words, similarity of 0.8).

    Rows are told apart by a number of their own, not by their id: rows that share an id, or have
    none, stay unless their texts are near-duplicates. Of a group rows without an id rank last, and
    rows of one id by their text.
    """
    numbered = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")
    found = minhash.near_duplicates(numbered, id_col="row").select(F.col("id").alias("row"), "component_id")
    names = numbered.select("row", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("text"), "row").alias("name"))
    kept = found.join(names, "row").groupBy("component_id").agg(F.min("name")["row"].alias("row"))
    return numbered.join(kept.select("row"), "row", "left_semi").select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (left out, once, or up to three times), by training position.

    Each row is mixed on its own, also where rows share an id or have none.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    pieces = stored(packing.tokenised_pieces(docs, tokenizer_path()), "pieces")
    return packing.pack(pieces)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for n, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, f"stage{n}")
    return docs


#: Expectation-maximisation and tokenisation are beyond SQL; tests hold the rows against a plain version.
ORACLE_SQL = None

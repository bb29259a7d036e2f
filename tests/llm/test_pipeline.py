"""The corpus pipeline stage by stage against plain versions."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from goldleaf.llm.common import stored

from . import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en", "x", 0), (900002, "", None, None, 0), (900003, "12 34", "en", "x", 5), (None, "some words without an id at all", "en", "x", 31)], docs.schema)
    out = [docs.unionByName(odd)]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(stored(stage(spark, out[-1], sf_dir), f"test{n}"))
    return [{r["doc_id"]: r for r in df.collect()} if n < 4 else df.collect() for n, df in enumerate(out)], out


def test_columns(stages):
    rows, frames = stages
    assert all(df.columns == list(corpus_pipeline.COLUMNS) for df in frames[1:-1])


def test_language_keeps_all_with_letters(stages):
    before, after = stages[0][0], stages[0][1]
    assert set(after) == {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")}


def test_lines(stages):
    before, after = stages[0][1], stages[0][2]
    want = brute.lines([(i if i is not None else -1, r["text"]) for i, r in before.items()])
    assert {i: r["text"] for i, r in after.items()} == {(None if i == -1 else i): t for i, (_, _, t) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_near_duplicates(stages):
    before, after = stages[0][2], stages[0][3]
    want = brute.near([(i, r["text"]) for i, r in before.items() if i is not None], part=80)
    assert set(after) == {i for i, (_, c) in want.items() if i == c} | {None}


def test_mixing(stages):
    before, frame = stages[0][3], stages[1][4]
    sizes = {i: len(brute.WORD.findall(r["text"])) for i, r in before.items()}
    of = {}
    for i, r in before.items():
        of[r["source"]] = of.get(r["source"], 0) + sizes[i]
    taken = {r["source"]: r["n"] for r in frame.groupBy("source").agg(F.sum(F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))), F.lit(0))).alias("n")).collect()}
    want, largest = brute.targets(of), max(sizes.values())
    assert all(abs(taken.get(s, 0) - want[s]) <= largest for s in want)
    assert all(1 <= n <= 3 for (n,) in frame.groupBy("doc_id").count().select("count").collect())


def test_packing(stages):
    places = {}
    for r in stages[0][5]:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert stages[1][5].where("piece = 0").count() == stages[1][4].count()


def test_rows_that_share_an_id_or_have_none(spark, sf_dir):
    """Near-duplicates go by their texts, whatever the ids; mixing takes each row on its own; long texts and clashing columns pass."""
    base = " ".join(f"word{i}" for i in range(300))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35), (1, "a wholly different text under the same id", "en", "a", 41), (2, base, "en", "a", len(base)),
        (2, base + " end", "en", "a", len(base) + 4), (None, base, "en", "b", len(base)), (None, "one without an id at all", None, "b", 24), (None, "one without an id at all", None, "b", 24),
        (3, None, None, None, None), (4, " ".join(f"very{i}" for i in range(50_000)), "en", "a", None),
    ]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS).schema
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in ("row", "id", "component_id", "keys", "lang_pred", "n")})
    kept = stored(corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir), "test").collect()
    assert sorted((str(r["doc_id"]), r["text"]) if r["text"] else ("3", "") for r in kept) == sorted([("1", rows[0][1]), ("1", rows[1][1]), ("2", next(r["text"] for r in kept if r["doc_id"] == 2)), ("None", rows[5][1]), ("3", ""), ("4", rows[8][1])])
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir).collect()
    assert {r["text"] for r in mixed if r["doc_id"] is None} <= {base, rows[5][1]} and all(tuple(r) in set(rows) for r in mixed)
    lines = corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir)
    assert lines.count() == len(rows) and lines.columns == list(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.identify_language(spark, docs, sf_dir).count() == 8


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), "empty")
    assert docs.count() == 0

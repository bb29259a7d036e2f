"""The store in a folder: commits, deliveries, the worker and what a second run changes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from goldleaf import tables
from goldleaf.model.registry import PERSON
from goldleaf.operators.folder import Conflict, Folder
from goldleaf.operators import store
from goldleaf.plans import jobs
from goldleaf.sources.extract import policy_extract
from goldleaf.sources.mapping import EXTRACT_MAPPING, load_mapping

MAPPING = load_mapping(EXTRACT_MAPPING)


def test_commits(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/store")
    assert folder.view().table("a") is None
    first = folder.commit(folder.view(), {"a": spark.range(3).select(F.col("id").alias("x"))})
    folder.commit(folder.view(), append={"a": spark.createDataFrame([(7, "late")], "x bigint, y string")})
    assert sorted(map(tuple, folder.view().table("a").collect()), key=str) == sorted([(0, None), (1, None), (2, None), (7, "late")], key=str)
    assert first.table("a").count() == 3  # a view stays as it was
    with pytest.raises(Conflict):
        folder.commit(first, {"a": spark.range(1).select(F.col("id").alias("x"))})
    assert folder.view().table("a").count() == 4
    assert len(folder.compact("a").tables["a"]["parts"]) == 1 and folder.vacuum(keep=1) == 2
    assert folder.view().table("a").count() == 4


def test_moved_keys(spark):
    current = spark.createDataFrame([("S", "K", "1", "g1", True), ("S", "K", "2", "g2", True)], "source_system string, source_key_kind string, source_party_key string, golden_id string, is_active boolean")
    current = current.withColumns({"first_seen": F.lit("2024-01-01").cast("timestamp"), "last_seen": F.lit("2024-01-01").cast("timestamp")})
    incoming = spark.createDataFrame([("S", "K", "2", "g1")], current.select("source_system", "source_key_kind", "source_party_key", "golden_id").schema)
    new = store.upsert_crosswalk(current, incoming, "2024-02-01 00:00:00")
    assert [(r["source_party_key"], r["golden_id"], r["is_active"]) for r in store.moved_keys(current, new, "2024-02-01 00:00:00").collect()] == [("2", "g2", False)]


def test_worker(spark, sf_dir, tmp_path):
    raw = policy_extract(spark, sf_dir).orderBy("source_record_id").limit(60)
    folder = Folder(spark, f"file://{tmp_path}/store")
    assert jobs.work(folder, MAPPING, "2024-01-01 00:00:00") is None
    assert jobs.deliver(folder, raw, MAPPING, "b1", "2024-01-01 00:00:00").where("severity = 'ERROR'").isEmpty()
    assert [r["code"] for r in jobs.deliver(folder, raw.repartition(3), MAPPING, "b2", "2024-01-02 00:00:00").collect()] == ["REDELIVERED"]
    assert [r["code"] for r in jobs.deliver(folder, raw.limit(9), MAPPING, "b1", "2024-01-02 00:00:00").collect()] == ["BATCH_ID_TAKEN"]
    assert jobs.work(folder, MAPPING, "2024-01-02 00:00:00") == "DONE" and jobs.work(folder, MAPPING, "2024-01-02 00:00:00") is None
    view = folder.view()
    people = view.table("person").count()
    assert people > 0 and view.table("policy").count() == raw.select("PolicyNumber").distinct().count()
    jobs.requeue(folder, "b1", "2024-02-01 00:00:00")
    assert jobs.work(folder, MAPPING, "2024-02-01 00:00:00") == "DONE"
    after = folder.view()
    report = {r["entity"]: (r["inserted"], r["versioned"]) for r in after.table("runs").where("ended_at > '2024-01-15'").collect()}
    assert report == dict.fromkeys(("person", "policy", "relationship"), (0, 0))
    assert after.table("person").count() == people and jobs.history(after, "policy").count() == view.table("policy").count()
    assert after.table("crosswalk_moved").count() == 0 and after.table("ledger").select("run_id").distinct().count() == 2
    jobs.export_csv(after.table("person"), PERSON, f"file://{tmp_path}/out")
    out = spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/out")
    assert out.count() == people and {r[0] for r in out.select("full_name").distinct().collect()} <= {"***", None}


def test_failed_jobs_wait_and_die(spark, sf_dir, tmp_path, monkeypatch):
    folder = Folder(spark, f"file://{tmp_path}/store")
    jobs.deliver(folder, policy_extract(spark, sf_dir).limit(20), MAPPING, "b1", "2024-01-01 00:00:00")
    monkeypatch.setattr(jobs, "process", lambda *_: 1 / 0)
    assert jobs.work(folder, MAPPING, "2024-01-01 00:00:00") == "PENDING"
    assert jobs.work(folder, MAPPING, "2024-01-01 00:00:01") is None  # not yet due again
    assert [jobs.work(folder, MAPPING, f"2024-01-01 00:0{m}:00") for m in (1, 2, 3)] == ["PENDING", "DEAD", None]
    assert folder.view().table("person") is None


def test_no_table_of_a_batch_is_computed_twice(spark, sf_dir, tmp_path, monkeypatch):
    """Policies, gated parties and answers are stored, so what reads them repeats neither kernels nor fallback."""
    from goldleaf.plans import pipeline

    labels, kept = [], pipeline.stored
    monkeypatch.setattr(pipeline, "stored", lambda df, label, *more: labels.append(label) or kept(df, label, *more))
    raw = policy_extract(spark, sf_dir).orderBy("source_record_id").limit(20)
    result = pipeline.run_pipeline(raw.select(*raw.columns), MAPPING, "2024-01-01 00:00:00")
    assert {"occurrences", "policies", "gated", "asked", "parties"} <= set(labels)
    for made in (result.exceptions, result.policy.history):
        assert "regexp_replace" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_together_ends_all_before_it_raises(spark):
    ended = []
    with pytest.raises(ZeroDivisionError):
        tables.together(lambda: 1 / 0, lambda: ended.append(spark.range(3).count()))
    assert ended == [3] and tables.together(lambda: 1, lambda: 2) == [1, 2]


def test_small_methods_hold_inside_only(spark):
    before = spark.conf.get(tables.HUGE_METHOD)
    with pytest.raises(ZeroDivisionError), tables.small_methods(spark):
        assert spark.conf.get(tables.HUGE_METHOD) == "8000"
        1 / 0
    assert spark.conf.get(tables.HUGE_METHOD) == before


def test_pairs_meet_with_their_attributes(spark, sf_dir):
    """The pairs of the blocks, with the same kinds of key and attributes as by joins, and none of a block that is too large."""
    from goldleaf.operators import blocking, scoring, shred

    people = tables.stored(shred.collapse_parties(shred.shred_parties(policy_extract(spark, sf_dir), MAPPING)), "parties")
    for most in (blocking.MAX_BLOCK, 3):
        joined = scoring.attach_attributes(blocking.block_pairs(people, max_block=most), people)
        met = blocking.met_pairs(people, scoring.compared_columns(people), max_block=most).select(*joined.columns)
        assert joined.count() == met.count() > 0 and joined.exceptAll(met).isEmpty()


def test_a_batch_shuffles_no_pair_and_leaves_no_scratch(spark, sf_dir, tmp_path, monkeypatch):
    from goldleaf.plans import pipeline

    made, kept = {}, pipeline.stored
    monkeypatch.setattr(pipeline, "stored", lambda df, label, *more: made.update({label: df}) or kept(df, label, *more))
    held, clear = [], tables.Scratch.clear
    monkeypatch.setattr(tables.Scratch, "clear", lambda self: held.extend(self.paths) or clear(self))
    folder = Folder(spark, f"file://{tmp_path}/store")
    jobs.deliver(folder, policy_extract(spark, sf_dir).orderBy("source_record_id").limit(60), MAPPING, "b1", "2024-01-01 00:00:00")
    assert jobs.work(folder, MAPPING, "2024-01-02 00:00:00") == "DONE"
    assert "pairs" not in made and "l_address_key" not in made["scored"].columns and "l_surname_derived" in made["scored"].columns
    assert any("/scored-" in path for path in held) and not any(Path(path.removeprefix("file://")).exists() for path in held)
    assert folder.view().table("ledger").count() > 0


def test_components_on_the_driver_are_those_of_the_rounds(spark, monkeypatch):
    from goldleaf.operators import clustering

    rows = [(f"n{a:03}", f"n{b:03}") for a, b in [(9, 3), (3, 7), (7, 9), (20, 21), (21, 40), (40, 5), (60, 61), (8, 8)]]
    edges = spark.createDataFrame([*rows, ("é", "z"), ("z", "\U0001f600")], "u string, v string")
    rounds = []
    star = clustering._small_star
    monkeypatch.setattr(clustering, "_small_star", lambda e: rounds.append(1) or star(e))
    numbers = spark.range(40).selectExpr("id AS u", "id % 7 AS v")
    at_once = [set(map(tuple, clustering.components(e).collect())) for e in (edges, numbers)]
    assert not rounds
    monkeypatch.setattr(clustering, "AT_ONCE", 0)
    assert [set(map(tuple, clustering.components(e).collect())) for e in (edges, numbers)] == at_once and rounds
    assert ("é", "z") in at_once[0] and ("n040", "n005") in at_once[0]


def test_prefixes_and_scores_as_json(spark):
    """Counting equal prefixes may end at the first that differs; the ledger's texts are those of to_json."""
    from goldleaf.operators import ledger, scoring

    names = ["A", "AB", "ABC DEF", "ABX DEF", "ABC DEFGHIJKLM", "ABC DEFGHIJKLMNO", "É B", "ÉB"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for a, b, got in pairs.select("a", "b", scoring.prefix_similarity(F.col("a"), F.col("b"))).collect():
        equal = sum(a[:n] == b[:n] and min(len(a), len(b)) >= n for n in range(1, 13))
        assert got == min(1.0, equal / max(len(a), len(b)))
    values = "'l' AS left_id, 'r' AS right_id, 'email' AS blocking_keys, 0.5D AS score, 'GREY' AS zone, false AS vetoed, 0.1D AS ai_score, 'MATCH' AS ai_decision, 'MATCH' AS final_decision, 'X' AS decided_by"
    scored = spark.sql(f"SELECT {values}, c1 AS cmp_a, c2 AS cmp_b FROM VALUES (1.0D, 0.0D), (NULL, 1.0D / 3), (NULL, NULL), (0.9D, 1.0D / 70000) AS t(c1, c2)")
    want = scored.selectExpr("to_json(map_filter(map('a', cmp_a, 'b', cmp_b), (k, v) -> v IS NOT NULL)) AS j")
    assert sorted(r[0] for r in ledger.ledger_rows(scored, "r", "2024-01-01 00:00:00").select("comparator_scores").collect()) == sorted(r[0] for r in want.collect())

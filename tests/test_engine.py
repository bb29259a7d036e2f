"""Behaviour that single queries don't show: mapping, registry, rules, versions, the whole pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from goldleaf.model.enums import ENUMS
from goldleaf.model.registry import ENTITIES, PERSON, POLICY, EntitySpec, FieldSpec
from goldleaf.operators import blocking, clustering, fallback, gate, governance, quality, queue, reads, rules, scoring, shred, store, survive
from goldleaf.plans.pipeline import GoldenStore, run_pipeline
from goldleaf.sources import landing
from goldleaf.sources.extract import policy_extract
from goldleaf.sources.mapping import EXTRACT_MAPPING, FieldMapping, MappingError, load_mapping, parse_mapping
from goldleaf.streaming import ingest
from goldleaf.tables import stored

MAPPING = load_mapping(EXTRACT_MAPPING)


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return stored(policy_extract(spark, sf_dir), "raw")


# -- registry and mapping


def test_registry_shape():
    assert {n: len(e.fields) for n, e in ENTITIES.items()} == {"policy": 45, "person": 57, "relationship": 30}
    assert PERSON.schema()["party_type"].metadata["enum"] == list(ENUMS["PartyType"])
    assert PERSON.by_name["full_name"].masked and not PERSON.by_name["postal_code"].masked
    assert "decimal(18,4)" in POLICY.ddl() and POLICY.natural_key == ("source_system", "policy_number_normalized")


@pytest.mark.parametrize("bad", [dict(survivorship="MOST_RECENT", derived=True), dict(survivorship="MOST_RECENT", derived_from="x"), dict(survivorship="NOPE"), dict(survivorship="SYSTEM", enum="NoSuch")])
def test_registry_refuses(bad):
    with pytest.raises(ValueError):
        FieldSpec("f", "STRING", **bad)
    with pytest.raises(ValueError):
        EntitySpec("e", (FieldSpec("a", "STRING", "SYSTEM"),) * 2, "a")


@pytest.mark.parametrize(("old", "new"), [('"PolicyNumber", transform = "policy_number"', '"PolicyNumber", transform = "shout"'), ("policy_number =", "policy_id2 ="), ("phone_raw =", "phone_e164 ="), ("full_name =", "city ="), ('currency_code = { literal = "GBP" }', "currency_code = { }")])
def test_mapping_refuses(old, new):
    text = EXTRACT_MAPPING.read_text().replace(old, new)
    with pytest.raises((MappingError, ValueError)):
        parse_mapping(text)
    with pytest.raises(MappingError):
        FieldMapping("x", source="a", literal="b")


def test_missing_columns_stop_the_checks(raw):
    issues = landing.validate_batch(raw.drop("OwnerName", "AgentCode"), MAPPING).collect()
    assert [(r["severity"], r["code"]) for r in issues] == [("ERROR", "MISSING_COLUMNS")]
    codes = {r["code"] for r in landing.validate_batch(raw.drop("OwnerRelationshipToInsured"), MAPPING).collect()}
    assert "MISSING_OPTIONAL_COLUMNS" in codes
    assert [r["code"] for r in landing.validate_batch(raw.limit(0), MAPPING).collect()] == ["EMPTY_BATCH"]


def test_csv_and_redelivery(spark, raw, tmp_path):
    raw.write.option("header", True).csv(str(tmp_path / "in"))
    read = landing.read_csv(spark, str(tmp_path / "in"), raw.columns)
    assert {d for _, d in read.dtypes} == {"string"} and read.count() == raw.count()
    columns = MAPPING.source_columns
    first, again = landing.batch_hash(raw, columns).first()[0], landing.batch_hash(raw.repartition(5).orderBy(F.rand()), columns).first()[0]
    assert first == again != landing.batch_hash(raw.limit(10), columns).first()[0]
    issues, rows = landing.accept_batch(None, raw, MAPPING, "b1", "2024-01-01 00:00:00")
    assert rows.count() > 0 and landing.accept_batch(rows, raw, MAPPING, "b1", "2024-01-02 00:00:00")[1].count() == 0
    assert landing.accept_batch(None, raw.drop("OwnerName"), MAPPING, "b2", "2024-01-01 00:00:00")[1].count() == 0


# -- shredding


def test_anonymous_parties_stay_apart(spark):
    base = dict.fromkeys([*MAPPING.source_columns, *MAPPING.optional_columns], None)
    rows = [base | {"PolicyNumber": f"P{i}", "OwnerName": "John Smith", "source_record_id": f"r{i}"} for i in range(3)]
    frame = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in rows[0]))
    parties = shred.collapse_parties(shred.shred_parties(frame, MAPPING)).collect()
    assert len({r["person_id"] for r in parties}) == 3
    assert shred.shred(shred.empty_shredded(spark, MAPPING), MAPPING).parties.count() == 0


def test_collapse_is_independent_of_row_order(raw):
    table = lambda df: {str(r) for r in shred.collapse_parties(shred.shred_parties(df, MAPPING)).collect()}
    assert table(raw) == table(raw.repartition(7).orderBy(F.rand(3)))


# -- resolution


PARTY = "person_id string, full_name_normalized string, name_sorted_key string, name_phonetic_key string, email_normalized string, phone_e164 string, address_key string, date_of_birth date, party_type string, postal_code string, gender string"


def party(i, name="JOHN SMITH", email=None, phone=None, dob=None, kind="PERSON"):
    import datetime

    return (i, name, " ".join(sorted(name.split())), name[:3], email, phone, None, dob and datetime.date.fromisoformat(dob), kind, None, None)


def test_missing_is_not_disagreement(spark):
    people = spark.createDataFrame([party("a", email="x@y.z", dob="1980-01-01"), party("b", email="x@y.z"), party("c", email="x@y.z", dob="1990-01-01"), party("d", kind="TRUST", email="x@y.z"), party("e"), party("f", phone="+1")], PARTY)
    scored = {(r["left_id"], r["right_id"]): r for r in scoring.score_pairs(blocking.block_pairs(people), people).collect()}
    assert scored["a", "b"]["cmp_dob"] is None and scored["a", "b"]["score"] == 1.0 and scored["a", "b"]["zone"] == "AUTO_MATCH"
    assert scored["a", "c"]["vetoed"] and scored["a", "c"]["zone"] == "AUTO_REJECT"
    assert scored["a", "d"]["vetoed"] and scored["e", "f"]["under_corroborated"] and scored["e", "f"]["zone"] == "AUTO_REJECT"


def test_large_blocks_are_dropped_and_reported(spark):
    people = spark.createDataFrame([party(f"p{i:02}", email=f"e{i // 2}") for i in range(12)], PARTY)
    assert {r["blocking_keys"] for r in blocking.block_pairs(people, max_block=5).collect()} == {"email"}
    report = {r["kind"]: r for r in blocking.blocking_report(people, max_block=5).collect()}
    assert report["name_sorted"]["dropped_pairs"] == 66 and report["email"]["pairs"] == 6


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_search(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(260)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    ids = spark.createDataFrame([(x,) for x in root], "person_id string")
    pairs = spark.createDataFrame(edges, "left_id string, right_id string")
    got = {r["person_id"]: r["master_id"] for r in clustering.cluster(ids, pairs).collect()}
    assert got == {x: find(x) for x in root}
    assert clustering.cluster(ids, pairs.limit(0)).where("person_id <> master_id").count() == 0


# -- survivorship


def test_strategies_and_order_independence(spark):
    rows = [
        ("m", "r1", "HIGH", "2020-01-01 00:00:00", "Jon", "JON", "A", False), ("m", "r2", "LOW", "2024-01-01 00:00:00", "Jonathan Smith", None, "B", True),
        ("m", "r3", "LOW", "2022-01-01 00:00:00", None, "ORPHAN", "B", None), ("n", "r4", "LOW", None, None, "X", None, None),
    ]
    frame = spark.createDataFrame(rows, "master_id string, source_record_id string, source_system string, t string, full_name string, full_name_normalized string, national_id_hash string, do_not_contact boolean").withColumn("source_timestamp", F.col("t").cast("timestamp")).drop("t")
    for df in (frame, frame.repartition(3).orderBy(F.desc("source_record_id"))):
        got = {r["master_id"]: r for r in survive.survive(df, PERSON, {"HIGH": 0.9, "LOW": 0.2}).collect()}
        assert got["m"]["full_name"] == "Jonathan Smith" and got["m"]["full_name_normalized"] is None  # derived follows its parent, null or not
        assert got["m"]["national_id_hash"] == "A" and got["m"]["do_not_contact"] and got["n"]["do_not_contact"] is False
        assert got["m"]["contributing_records"] == ["r1", "r2", "r3"]
    told = survive.provenance(frame, survive.survive(frame, PERSON, {"HIGH": 0.9}), PERSON).collect()
    won = {(r["master_id"], r["attribute_name"]): r for r in told}
    assert won["m", "full_name"]["winning_source_record_id"] == "r2" and "Jon" in won["m", "full_name"]["rejected_values"]
    assert ("n", "full_name") not in won


# -- rules


@pytest.mark.parametrize("pattern", ["", "x" * 501, "(a+)+", "(", "no groups"])
def test_unsafe_rules_are_refused(pattern):
    with pytest.raises(rules.InvalidRule):
        rules.Rule("r", "EXTRACT", "full_name_normalized", pattern, targets=("given_name_derived",)).validate()


def test_rule_life_cycle():
    rule = rules.Rule("r", "REWRITE", "full_name", "a", "b")
    with pytest.raises(rules.InvalidRule):
        rule.approved("me")
    with pytest.raises(rules.InvalidRule):
        rule.shadowed(3).approved("me")
    assert rule.shadowed(0).approved("me").state == "ACTIVE"
    made = rules.propose_rules([("full_name", "name_parsed_cleanly", "W-P-P-W", 40), ("full_name", "name_parsed_cleanly", "W-I-W", 50), ("full_name", "name_no_digits", "W-N", 90)])
    assert [r.name for r in made] == ["name_parsed_cleanly_w-i-w", "name_parsed_cleanly_w-p-p-w"]


def test_learning_lowers_the_share_that_fails(raw):
    parties = stored(shred.collapse_parties(shred.shred_parties(raw, MAPPING)), "p")
    before = gate.apply_gate(parties)
    asked = fallback.standardise(fallback.requests(before), "44")
    mined = rules.mine_signatures(asked.withColumn("deterministic_value", F.coalesce("deterministic_value", "raw_value")), 1)
    made = rules.propose_rules([(r["field_name"], r["failed_check"], r["shape"], r["evidence_count"]) for r in mined.collect()])
    assert made
    after = gate.apply_gate(rules.apply_rules(before, made).drop("failed_checks", "gate_passed"))
    failing = lambda df: df.where("NOT gate_passed").count()
    assert failing(after) < failing(before)
    for rule in made:
        shadow = rules.shadow_evaluate(parties, rule).first()
        assert shadow["regressed"] == 0
    assert failing(gate.apply_gate(fallback.write_back(before.drop("failed_checks", "gate_passed"), asked))) < failing(before)


@pytest.mark.parametrize(("name", "parts"), [("SMITH, JOHN MICHAEL", ("JOHN", "MICHAEL", "SMITH", 0.7)), ("JAN VAN DER BERG", ("JAN", "", "VAN DER BERG", 0.9)), ("ANN B C REED", ("ANN", "B C", "REED", 0.9)), ("VAN BERG", ("VAN", "", "BERG", 0.9)), ("CHER", None), ("", None)])
def test_name_parts(spark, name, parts):
    got = spark.range(1).select(fallback.name_parts(F.lit(name)).alias("p")).first()["p"]
    assert (tuple(got) if got else None) == parts


def test_phone_and_address_recovery(spark):
    got = spark.range(1).select(fallback.longest_phone(F.lit("020 7946 0958 x221 / 12"), "44"), fallback.longest_phone(F.lit("12"), "44"), fallback.spaced_address(F.lit("12A highstreet flat2")), fallback.spaced_address(F.lit("x"))).first()
    assert tuple(got) == ("+442079460958", None, "12 A HIGHSTREET FLAT 2", None)


# -- the store and the whole


@pytest.fixture(scope="module")
def first(raw):
    return run_pipeline(raw, MAPPING, "2024-01-01 00:00:00")


def test_pipeline_and_second_run_changes_nothing(raw, first):
    person, policy = stored(first.person.history, "person"), stored(first.policy.history, "policy")
    edges = stored(first.relationships, "edges")
    assert person.count() > 100 and edges.where("edge_kind = 'PARTY_POLICY'").count() >= 2 * policy.count()
    assert first.memberships.where("household_id IS NOT NULL").count() > 0
    again = run_pipeline(raw, MAPPING, "2024-02-01 00:00:00", GoldenStore(person, policy, stored(first.known, "known")))
    for versions in (again.person, again.policy):
        report = versions.report.first()
        assert (report["inserted"], report["versioned"]) == (0, 0) and report["unchanged"] > 0
    bad = store.violations(person, edges, first.pairs).where("violations > 0").collect()
    assert not bad
    assert first.provenance.count() > 0


def test_quality_floors(raw, first):
    """Against the numbering of the generator, over customers with a key."""
    parties = stored(shred.collapse_parties(shred.shred_parties(raw, MAPPING)), "p")
    truth = parties.where("length(source_party_key) > 0 AND source_key_kind = 'CUSTOMER_ID'").select("person_id", F.regexp_replace("source_party_key", "^[CD]-", "").alias("true_id"))
    found = clustering.cluster(parties, first.pairs.where("final_decision = 'MATCH'"))
    row = quality.pairwise_quality(found, truth).first()
    assert row["precision"] >= 0.85 and row["recall"] >= 0.60
    assert quality.blocking_recall(blocking.block_pairs(parties), truth).first()["blocking_recall"] >= 0.88


def test_steward_overrides_win(raw, first):
    pair = first.pairs.where("final_decision = 'MATCH'").select("left_id", "right_id").limit(1).withColumn("decision", F.lit("NO_MATCH"))
    pair = stored(pair, "pair")
    out = run_pipeline(raw, MAPPING, "2024-01-01 00:00:00", overrides=pair)
    row = out.pairs.join(pair, ["left_id", "right_id"]).first()
    assert (row["final_decision"], row["decided_by"]) == ("NO_MATCH", "STEWARD")


def test_merge_pointer_cycle_has_no_end(spark):
    ids = spark.createDataFrame([("a",), ("c",)], "golden_id string")
    pointers = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "golden_id string, merged_into_id string")
    got = {r["golden_id"]: r["resolved_id"] for r in store.resolve_pointers(ids, pointers).collect()}
    assert got == {"a": None, "c": "d"}


def test_fill_required(spark):
    row = store.fill_required(spark.createDataFrame([("P1", None)], "full_name string, policy_count int").withColumns({c: F.lit("x") for c in ("person_id", "party_type", "full_name_normalized", "name_sorted_key", "name_phonetic_key", "name_parse_method")}), PERSON).first()
    assert row["policy_count"] == 0 and row["is_deceased"] is False and row["name_tokens"] == []
    with pytest.raises(ValueError, match="party_type"):
        store.fill_required(spark.createDataFrame([("x",)], "person_id string"), PERSON)


# -- governance, queue, streams


def test_roles():
    assert governance.may(["VIEWER"], "READ") and not governance.may(["VIEWER"], "UNMASK") and governance.may(["VIEWER", "ADMIN"], "ERASE")
    with pytest.raises(governance.AccessDenied):
        governance.authorize(["INGESTOR"], "EXPORT")


def test_erasure(spark):
    people = spark.createDataFrame([("a", "Ann", "ANN", "x@y.z", True), ("b", "Bob", "BOB", None, True), ("c", "Cy", "CY", "c@y.z", False)], "person_id string, full_name string, full_name_normalized string, email_address string, is_sanctioned boolean")
    edges = spark.createDataFrame([("a", "p1"), ("b", "p2")], "person_id string, policy_id string")
    policies = spark.createDataFrame([("p1", "INFORCE"), ("p2", "LAPSED")], "policy_id string, policy_status string")
    plan = governance.erasure_plan(people.where("person_id <> 'c'"), edges, policies)
    got = {r["person_id"]: tuple(r)[1:] for r in governance.erase(people, plan).collect()}
    assert got == {"a": ("Ann", "ANN", "[ERASED]", True), "b": ("[ERASED]", "[ERASED]", None, True), "c": ("Cy", "CY", "c@y.z", False)}


def test_consent(spark):
    told = spark.createDataFrame([("a", "MARKETING", "GRANTED", "2024-01-01"), ("a", "MARKETING", "WITHDRAWN", "2024-02-01"), ("b", "MARKETING", "GRANTED", "2024-01-01"), ("d", "MARKETING", "GRANTED", "2024-01-01")], "person_id string, purpose string, state string, stated_at string")
    people = spark.createDataFrame([("a", False), ("b", None), ("c", False), ("d", True)], "person_id string, do_not_contact boolean")
    got = {r["person_id"]: r["may_contact"] for r in governance.may_contact(people, governance.consent_history(told), "MARKETING").collect()}
    assert got == {"a": False, "b": True, "c": False, "d": False}


def test_queue(spark):
    jobs = spark.createDataFrame([(i, "q", None, "PENDING", i % 2, "2024-01-01 00:00:00", 0, 2, "2024-01-01 00:00:00") for i in range(4)], "job_id long, queue_name string, dedupe_key string, state string, priority int, v string, attempts int, max_attempts int, l string")
    jobs = jobs.withColumns({"visible_at": F.col("v").cast("timestamp"), "leased_until": F.col("l").cast("timestamp")}).drop("v", "l")
    taken = queue.claim(jobs, "q", "2024-01-02 00:00:00", 2)
    assert [r["job_id"] for r in taken.collect()] == [0, 2]
    once = queue.failed(taken, "2024-01-02 00:00:00").first()
    assert once["state"] == "PENDING" and str(once["visible_at"]) == "2024-01-02 00:00:02"
    assert queue.failed(taken.withColumn("attempts", F.lit(2)), "2024-01-02 00:00:00").first()["state"] == "DEAD"
    assert queue.reap(taken, "2025-01-01 00:00:00").first()["state"] == "PENDING"
    keyed = jobs.withColumn("dedupe_key", F.lit("k"))
    assert queue.enqueue(keyed, keyed).count() == 0 and queue.enqueue(keyed.limit(0), keyed).count() == 1


def test_models(spark):
    events = spark.createDataFrame([(1, "encoder", "m1", "d", "CANDIDATE", "1"), (2, "encoder", "m1", "d", "SHADOW", "2"), (3, "encoder", "m1", "d", "ACTIVE", "3"), (4, "encoder", "m2", "e", "ACTIVE", "4")], "event_id long, kind string, model string, digest string, state string, at string")
    assert [r["model"] for r in queue.active_models(events).collect()] == ["m2"]
    assert [r["event_id"] for r in queue.illegal_transitions(events).collect()] == [4]


def test_landing_stream_is_replayable(spark, raw, tmp_path):
    columns = [*MAPPING.source_columns, *MAPPING.optional_columns]
    raw.select(*columns).limit(50).write.option("header", True).csv(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        stream = ingest.delivered_files(spark, str(tmp_path / "in"), MAPPING)
        ingest.land_stream(stream, MAPPING, str(tmp_path / "landed"), str(tmp_path / "state"), lambda df, n: seen.append(df.count())).awaitTermination()
    assert len(seen) == 1 and 0 < seen[0] <= 50


def test_export(spark, raw):
    people = shred.collapse_parties(shred.shred_parties(raw, MAPPING)).select("person_id", "full_name", "name_tokens", "gender")
    hidden, shown = reads.export_entity(people, PERSON), reads.export_entity(people, PERSON, unmask=True)
    assert {d for _, d in hidden.dtypes} == {"string"} and {r[0] for r in hidden.select("full_name").distinct().collect()} <= {"***", ""}
    assert "|" in shown.where("size(split(full_name, ' ')) = 2").first()["name_tokens"]
    assert quality.prometheus({"a": 1, "b": None}) == "# TYPE goldleaf_a gauge\ngoldleaf_a 1\n"


# -- the ledger and jobs over the store


def test_ledger(spark, raw, first):
    from goldleaf.operators import ledger

    rows = stored(ledger.ledger_rows(first.pairs, "r1", "2024-01-01 00:00:00").unionByName(ledger.ledger_rows(first.pairs.limit(3), "r2", "2024-02-01 00:00:00")), "ledger")
    assert ledger.latest_run(rows).count() == 3
    one = first.pairs.where("zone = 'AUTO_MATCH'").first()
    assert "score" in ledger.considered(rows, one["left_id"]).columns
    said = ledger.steward_decision("b", "a", "MATCH", "me", "2024-01-01 00:00:00", rows).unionByName(ledger.steward_decision("a", "b", "NO_MATCH", "me", "2024-01-02 00:00:00", rows))
    assert [tuple(r) for r in ledger.latest_decisions(said).collect()] == [("a", "b", "NO_MATCH")]
    with pytest.raises(ValueError):
        ledger.steward_decision("a", "a", "MATCH", "me", "2024-01-01 00:00:00", rows)


def test_rebuild_and_mining(spark, raw, first):
    from goldleaf.plans import operations

    landed = stored(landing.landing_rows(raw, MAPPING, "b1", "2024-01-01 00:00:00"), "landed")
    result = operations.process_landed(landed, MAPPING, "2024-01-01 00:00:00", GoldenStore())
    person, known = stored(result.person.history, "person"), stored(result.known, "known")
    plan = operations.rebuild(landed, MAPPING, "2024-03-01 00:00:00", GoldenStore(person, None, known)).report.first()
    assert (plan["appear"], plan["vanish"], plan["differ"]) == (0, 0, 0) and plan["equal"] == person.count()
    assert operations.check(person, result.relationships, result.pairs).count() == 0
    mined = operations.mine(raw, MAPPING, 1)
    assert mined and all(r.state == "SHADOW" and r.regressions == 0 for r in mined)
    filled = operations.backfill_columns(person.withColumn("occupation", F.lit(None).cast("string")), person, "person_id", ["occupation"])
    assert filled.where("occupation IS NOT NULL").count() == person.where("occupation IS NOT NULL").count()


# -- models, keys, principals and the views of one party


def test_models_are_chosen_and_changed_ones_refused(tmp_path, monkeypatch):
    from goldleaf.operators import models

    file = tmp_path / "m.onnx"
    file.write_bytes(b"one")
    registered = {"path": str(file), "digest": models.digest(file)}
    assert models.choose("CROSS_ENCODER", "given", registered) == "given" and models.choose("CROSS_ENCODER", None, registered) == str(file)
    monkeypatch.setenv("GOLDLEAF_CROSS_ENCODER_MODEL", "from-env")
    assert models.choose("CROSS_ENCODER") == "from-env" and models.choose("STANDARDIZER") is None
    file.write_bytes(b"two")
    with pytest.raises(models.ModelRefused):
        models.choose("CROSS_ENCODER", None, registered)


def test_a_model_scores_only_the_grey_zone(first):
    from goldleaf.operators import models

    verdicts = models.model_scores(first.pairs, lambda m: m[:, 0] * 2, 0.7)
    assert verdicts.count() == first.pairs.where("zone = 'GREY'").count()
    both = models.with_verdicts(first.pairs, verdicts)
    assert both.count() == first.pairs.count() and both.where("zone <> 'GREY' AND ai_score IS NOT NULL").count() == 0


def test_identifiers_are_hashed_with_a_key(spark):
    from goldleaf.functions import identity

    a, b = identity.hash_identifier("ab-12 3", "SSN", b"k"), identity.hash_identifier("AB123", "SSN", b"k")
    assert a == b != identity.hash_identifier("AB123", "TIN", b"k") != identity.hash_identifier("AB123", "TIN", b"j")
    assert identity.hash_identifier(" - ", "SSN", b"k") is None
    with pytest.raises(Exception, match="GOLDLEAF_ID_KEY"):
        spark.range(1).select(identity.keyed_identifier_hash(F.lit("x"), F.lit("SSN"))).collect()


def test_principals():
    who, key = governance.create_principal("ann", ["STEWARD"])
    assert governance.authenticate({"ann": who}, "ann", key).may("MERGE") and not who.may("ERASE")
    for name, secret in (("ann", "wrong"), ("bob", key)):
        with pytest.raises(governance.AccessDenied):
            governance.authenticate({"ann": who}, name, secret)


def test_customer_360(spark, first):
    person, edges = stored(first.person.history, "p"), stored(first.relationships, "e")
    one = edges.where("edge_kind = 'PARTY_POLICY' AND role = 'OWNER'").first()["from_person_id"]
    crosswalk = first.known.withColumns({"source_system": F.lit("S"), "source_party_key": F.col("person_id")}).drop("person_id")
    mine = edges.where("edge_kind = 'PARTY_POLICY'").select(F.col("from_person_id").alias("person_id"), F.col("to_policy_id").alias("policy_id"), "role")
    relations = spark.createDataFrame([(one, "x", "CHILD_OF", False)], "person_id string, other_id string, association_type string, outgoing boolean")
    view = reads.customer_360(one, person, crosswalk, first.provenance, mine, first.policy.history.select("policy_id", "effective_date"), first.memberships, relations, first.pairs)
    assert view["record"].count() == 1 and view["policies"].count() >= 1 and view["sources"].count() >= 1 and view["versions"].count() == 1
    assert view["relations"].first()["label"] == "parent of"
    shaped = spark.createDataFrame([("r1", one, "delivered"), ("r2", None, "kept")], "id string, OwnerMdmId string, OwnerName string")
    named = {r["id"]: r["OwnerName"] for r in reads.with_golden_values(shaped, person, "OWNER", {"OwnerName": "full_name"}).collect()}
    assert named["r2"] == "kept" and len(named) == 2


def test_operational_snapshot(spark):
    jobs = spark.createDataFrame([("PENDING", "2024-01-01 10:00:00"), ("DEAD", "2024-01-01 00:00:00")], "state string, v string").withColumn("visible_at", F.col("v").cast("timestamp"))
    log = spark.createDataFrame([("DONE", "2024-01-01 09:00:00"), ("FAILED", "2023-12-01 00:00:00")], "state string, t string").withColumn("at", F.col("t").cast("timestamp"))
    assert tuple(queue.operational_snapshot(jobs, log, "2024-01-01 11:00:00").first()) == (1, 0, 1, 3600, 1, 0)


def test_blocks_of_any_size_pair_exactly(spark):
    """A block of 1,500 is left out with the cap, and paired whole without one."""
    rows = [(f"p{i:04}", "one@example.org", f"+4420{i // 3:07}") for i in range(1500)]
    people = spark.createDataFrame(rows, "person_id string, email_normalized string, phone_e164 string")
    capped = {tuple(r) for r in blocking.block_pairs(people).collect()}
    assert len(capped) == 1500 and {k for *_, k in capped} == {"phone"}
    whole = blocking.block_pairs(people, max_block=None)
    counted = {r["blocking_keys"]: r["count"] for r in whole.groupBy("blocking_keys").count().collect()}
    assert counted == {"email": 1500 * 1499 // 2 - 1500, "email+phone": 1500}
    assert whole.select("left_id", "right_id").distinct().count() == 1500 * 1499 // 2


def test_two_blocks_of_one_role_are_refused():
    block = '[[party]]\nrole = "OWNER"\nkey_field = "K"\nkey_kind = "X"\n[party.fields]\nfull_name = "N"\n'
    head = 'source_system = "S"\n[policy]\npolicy_number = "P"\n'
    with pytest.raises(MappingError, match="OWNER 1"):
        parse_mapping(head + block + block)
    assert len(parse_mapping(head + block + block.replace('key_kind', 'role_sequence = 2\nkey_kind')).parties) == 2


def test_duplicate_check_never_shuffles_pairs(spark):
    """Pairs are scored where they meet, those of far births don't meet, and the best of each probe are those of all pairs."""
    from goldleaf.operators.blocking import key_rows
    from goldleaf.operators.scoring import score_pairs
    from goldleaf.operators.shred import with_party_keys

    def people(n, step, mark):
        i = F.col("id")
        born = F.when(i % 7 != 0, F.date_add(F.lit("1969-06-01").cast("date"), (i * step % 900).cast("int")))
        phone = F.when(i % 5 != 0, F.concat(F.lit("0207900"), F.lpad((i % 40).cast("string"), 4, "0")))
        return spark.range(n).select(F.concat(F.lit(mark), i).alias("person_id"), F.when(i % 3 == 0, "Ann Smith").when(i % 3 == 1, "Ann Smyth").otherwise("Smith Trust").alias("full_name"), born.alias("date_of_birth"), phone.alias("phone_raw"), F.lit(None).cast("string").alias("email_address"), F.lit("F").alias("gender"))

    asked, there = people(40, 367, "p"), with_party_keys(people(200, 61, "r"), "44")
    found = reads.duplicate_check(asked.withColumnRenamed("person_id", "probe_id"), there, "44")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "WindowGroupLimit" in plan and "collect_list" not in plan
    keyed = with_party_keys(asked, "44")
    pairs = key_rows(keyed).withColumnRenamed("id", "left_id").join(key_rows(there).withColumnRenamed("id", "right_id"), ["kind", "key"]).select("left_id", "right_id").distinct()
    best = {}
    for r in score_pairs(pairs, keyed.unionByName(there)).where("zone <> 'AUTO_REJECT'").collect():
        best.setdefault(r["left_id"], []).append((r["score"], r["right_id"], r["zone"]))
    expected = sorted((p, i, s, z) for p, rows in best.items() for s, i, z in sorted(rows, reverse=True)[:10])
    assert len(expected) > 200 and sorted((r["probe_id"], r["person_id"], r["score"], r["zone"]) for r in found.collect()) == expected

"""Each registered query against a plain version on whole small tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from goldleaf.llm import queries

from . import brute


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def texts(docs):
    return [(i, t) for i, t, _, _ in docs]


def run(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


def test_near_duplicates(spark, sf_dir, texts):
    want = brute.near(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, sf_dir, "op1_minhash_near_dedup")}
    assert got == want


def test_chat(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = r"\### Assistant: </turn> ok"
    want = brute.chats(rows + [(-7, 0, "user", probe), (-7, 1, "assistant", probe)])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in run(spark, sf_dir, "op2_chat_formatting")}
    assert got == want


def test_lines(spark, sf_dir, texts):
    want = {i: (n, d, brute.sha(t)) for i, (n, d, t) in brute.lines(texts).items()}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in run(spark, sf_dir, "op3_line_dedup")}
    assert got == want


def test_language(spark, sf_dir, docs):
    got = {r["doc_id"]: r for r in run(spark, sf_dir, "op4_language_id")}
    assert len(got) == len(docs)
    out = [(lang, got[i]["lang_pred"]) for i, text, _, lang in docs if got[i]["held_out"] and lang and text]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in docs)
    assert sum(a == b for a, b in out) >= 0.97 * len(out)


def test_packing(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    rows = run(spark, sf_dir, "op5_best_fit_packing")
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, text in texts:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        at = 0
        for n, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            assert r["length"] == 1024 or n == 0
            at += r["length"]
        assert at == len(ids) and (len(by[i]) == 1) == (len(ids) <= 1024)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    # best-fit decreasing, one piece at a time
    gaps, opened = [0] * 1025, 0
    for size in sorted((r["length"] for r in rows), reverse=True):
        gap = next((g for g in range(size, 1025) if gaps[g]), None)
        if gap is None:
            opened, gap = opened + 1, 1024
        else:
            gaps[gap] -= 1
        gaps[gap - size] += 1
    assert len(sequences) == opened


def test_secrets(spark, sf_dir, texts):
    want = {i: brute.secrets(t) for i, t in texts}
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in run(spark, sf_dir, "op6_secret_scan")}
    assert got == want


def test_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    want = {r["page_id"]: (r["url"], brute.article(r["html"])) for r in rows}
    got = {r["page_id"]: (r["url"], r["text"]) for r in run(spark, sf_dir, "op7_html_extraction")}
    assert got == want


def test_exact(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in run(spark, sf_dir, "op8_exact_dedup")}
    assert got == brute.exact(texts)


def test_mixing(spark, sf_dir, docs):
    size = {i: len(brute.WORD.findall(t or "")) for i, t, _, _ in docs}
    source = {i: s for i, _, s, _ in docs}
    of = Counter()
    for i in size:
        of[source[i]] += size[i]
    want = brute.targets(of)
    got = run(spark, sf_dir, "op9_source_mixing")
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == of[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]], abs=1e-5)
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    largest = max(size.values())
    assert all(abs(taken[s] - want[s]) <= largest for s in want)


def test_media(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in run(spark, sf_dir, "op10_media_columns")}
    for i, text in texts:
        data, r = brute.padded(text), got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((text or "").encode()), len(data))
        assert r["payload_sha256"] == __import__("hashlib").sha256(data).hexdigest()
        assert r["tail_crc32"] == brute.crc(data[-32:])

"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldleaf.llm import chat, exact_dedup, html_text, language_id, line_dedup, media, minhash, mixing, packing, queries, secrets

from . import brute

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
LINE = "a line that is long enough to count"
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a"),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a"),  # a repeated row
    (2, "Alpha BETA gamma delta epsilon zeta eta theta iota kappa", "en", None),
    (3, None, "en", "b"),
    (4, "", None, "b"),
    (5, LONG, "en", "a"),
    (6, LONG + " tail", None, "a"),
    (7, f"{LINE}\n\n  {LINE.upper()}\t\nend", "fr", "b"),
    (8, LINE, "fr", "b"),
    (9, f"{LINE}\n{LINE}", "fr", "c"),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "fr", "c"),
    (None, None, None, None),
    (10, "   \t\n ", "de", "c"),
    (11, "1234 5678 !!", "de", "c"),
    (12, "un texte français élégant avec des accents où ça", "fr", "c"),
]
#: Names that operators use inside.
EXTRA = ("id", "digest", "n", "size", "part", "length", "hi", "lo", "keys", "kept", "position", "lang_pred", "score", "n_lines", "rep", "bands", "offset")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def test_near_duplicates(docs, none):
    got = {(r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, threshold=(85, 100)).collect()}
    want = brute.near([(i, t) for i, t, *_ in dict.fromkeys(ROWS) if i is not None])
    assert {(i, n, c, i == c) for i, (n, c) in want.items()} | {(None, 6, 1, False), (None, 0, None, True)} == got
    assert minhash.near_duplicates(none, threshold=(85, 100)).count() == 0


def test_large_buckets_are_compared_in_blocks(spark):
    """Variants of one base that aren't all linked to each other, in buckets of more than a block."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 420):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 6])):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    got = {r["id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), threshold=(85, 100)).collect()}
    assert got == {i: c for i, (_, c) in brute.near(rows).items()}


def test_large_buckets_of_several_components(spark, monkeypatch):
    """Families of near copies that meet in buckets: exact at the default threshold, with small blocks as well."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for family in range(5):
        words = list(base)
        for at in rng.sample(range(120), 4 * family):
            words[at] = f"f{family}_{at}"
        for i in range(60):
            own = list(words)
            for at in rng.sample(range(120), rng.choice([0, 1, 2])):
                own[at] = f"x{family}_{i}_{at}"
            rows.append((1000 * family + i, " ".join(own)))
    rows.append((9999, " ".join(f"long{i}" for i in range(30_000))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {i: c for i, (_, c) in brute.near(rows, part=80).items()}
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    monkeypatch.setattr(minhash, "CHAINS", 1)
    assert {r["id"]: r["component_id"] for r in minhash.near_duplicates(frame).collect()} == want


def test_rows_of_a_large_bucket_grow_with_its_documents(spark, monkeypatch):
    """A bucket of near copies of one text: no pair of blocks is left to compare once they are one component."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*base[: i % 400], f"x{i}", *base[i % 400 + 1 :]])) for i in range(1200)]
    sent = []
    compared = minhash._compared
    monkeypatch.setattr(minhash, "_compared", lambda groups, *rest: sent.append(groups.count()) or compared(groups, *rest))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), threshold=(85, 100)).collect()
    assert {r["component_id"] for r in found} == {0}
    assert sent[0] <= 1.2 * minhash.CHAINS * len(rows) and sent[1] == 0


def test_signatures_are_circulant():
    from goldleaf.llm import minhash_kernel as kernel

    shingles = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64))
    sig = kernel.signature(shingles, 64)
    placed = (kernel.mix64(shingles ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    for k in (0, 7, 63):
        x = placed + np.uint32(k)
        kernel._mix32_in_place(x, np.empty_like(x))
        assert sig[k] == x.min()


def test_chat_folds_events(spark):
    log = [
        (1, 1, 0, "message", "user", "hi <b>"), (1, 2, 1, "message", "assistant", "par"), (1, 3, 1, "delta", None, "tial"), (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", None, "ans"),
        (1, 6, 1, "delta", None, "wer </turn>"), (1, 7, 0, "edit", None, "hi \\ there"), (1, 8, 2, "message", "user", "gone"), (1, 9, 2, "delete", None, None), (2, 1, 0, "delta", "assistant", None), (None, 1, 0, "message", None, None),
    ]
    frame = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").withColumn("position", F.lit("clash")).repartition(5)
    rows = chat.format_log(frame).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        by.setdefault(r["conv_id"], []).append(r)
    assert [m for r in by[1] for m in chat.read_back(r["formatted"])] == [("user", "hi \\ there"), ("assistant", "answer </turn>")]
    assert [m for r in by[2] for m in chat.read_back(r["formatted"])] == [("assistant", "")]
    assert chat.unescape(by[1][1]["formatted"][by[1][1]["loss_start"] : by[1][1]["loss_end"]]) == "answer </turn>"
    assert [m for r in by[None] for m in chat.read_back(r["formatted"])] == [("", "")]
    assert chat.format_log(frame.where("conv_id = 99")).count() == 0
    with pytest.raises(ValueError, match="unknown kind"):
        list(chat.fold([(1, 0, "shout", "user", "x")]))


def test_chat_ties_and_control_strings(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 5, "<turn x>", r"\</turn>" + "\n<turn y>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_log(chat.as_log(frame))).collect()}
    assert got[1]["n_turns"] == 4 and got[2]["turns_sha256"] == brute.sha(rows[4][2] + "\n" + rows[4][3] + "\n")
    with pytest.raises(ValueError, match="not a formatted"):
        chat.read_back("plain text")


def test_lines(docs, none):
    unique = [(i, t) for i, t, *_ in ROWS]
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    held = brute.lines([(i or 0, t) for i, t in unique])
    # The first line stands in documents 1, 2 and one without an id, so only document 2 keeps it.
    want = sorted((i or 0, *(held[i] if i else (1, 1, "") if t else (1, 0, ""))) for i, t in unique)
    assert got == want
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_index_is_reversible(spark):
    rng = random.Random(3)
    lines = [f"this is the shared line number {i}" for i in range(60)]
    rows = [(i, "\n".join(rng.sample(lines, 12))) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    half = line_dedup.build_index(frame.where("doc_id < 40"))
    both = half.insert(frame.where("doc_id >= 40"))
    whole = line_dedup.build_index(frame)
    table = lambda index: {tuple(r) for r in index.counts().collect()}
    assert table(both) == table(whole)
    back = both.remove(frame.where("doc_id >= 40").select("doc_id"))
    assert table(back) == table(half)
    assert table(whole.remove(frame.select("doc_id"))) == set()


def test_filters_answer_for_new_lines(spark, monkeypatch):
    """Keys of a later batch that the filters don't know skip the exact tables; shards split as keys come."""
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 100)
    line = lambda i: f"this is the line with number {i} of the test"
    make = lambda numbers, start: spark.createDataFrame([(start + n, line(i)) for n, i in enumerate(numbers)], "doc_id long, text string")
    first = line_dedup.build_index(make(range(2000), 0))
    assert first.shards == 32 and first.counts().count() == 2000
    second = first.insert(make([*range(1900, 2000), *range(3000, 4900)], 10_000))  # 100 known keys and 1,900 new ones
    looked_up, spared = second.asked()
    assert looked_up + spared == 2000 and 100 <= looked_up < 200
    assert second.shards == 64 and second.counts().count() == 3900
    assert {r["refs"] for r in second.counts().where("keeper between 10000 and 10099").collect()} == {2}
    third = second.insert(make([*range(1900, 2000)], 20_000))
    assert third.asked()[0] == 100 and third.drops().count() == 200
    back = third.remove(make([*range(1900, 2000)], 20_000).select("doc_id"))
    assert {tuple(r) for r in back.counts().collect()} == {tuple(r) for r in second.counts().collect()}


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = rng.integers(-(1 << 62), 1 << 62, 20_000)
    f = line_dedup.CuckooFilter.for_keys(len(keys))
    assert f.insert(keys) and f.contains(keys).all()
    assert f.contains(rng.integers(-(1 << 62), 1 << 62, 50_000)).mean() < 0.01
    f.remove(keys[:5000])
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys[5000:]).all() and f.contains(keys[:5000]).mean() < 0.02


def test_language(docs, none):
    model = language_id.fit(docs, ~language_id.held_out(docs["doc_id"]))
    got = {(r["doc_id"], r["text"]): r for r in language_id.identify(docs, model).collect()}
    for (_, text), r in got.items():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= r["score"] <= 1
    assert language_id.identify(none, model).count() == 0
    empty = language_id.fit(none, F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_mixed_languages_have_mixed_proportions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, F.lit(True))
    sample = {r["lang"]: r["text"] for r in docs.where("length(text) > 3000").select("lang", "text").collect()}
    english, french = sample["en"][:3000], sample["fr"][:3000]
    active, share = model.mixture(language_id.trigram_counts(english + " " + french))
    assert {model.languages[i] for i in active} == {"en", "fr"} and 0.3 < share.max() < 0.7
    active, share = model.mixture(language_id.trigram_counts(english))
    assert [model.languages[i] for i in active] == ["en"] and share.max() == 1


def test_packing(docs, none):
    pieces = packing.tokenised_pieces(docs, queries.tokenizer_path(), keep_ids=True)
    packed = packing.pack(pieces).collect()
    assert len(packed) == pieces.count()
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.tokenised_pieces(none, queries.tokenizer_path())).count() == 0
    assert packing.cut(1024) == [(0, 1024)] and packing.cut(1025) == [(0, 1), (1, 1024)] and packing.cut(2048) == [(0, 1024), (1024, 1024)]


@pytest.mark.parametrize("text", ["", "a <|endoftext|> b", " " * 30_000 + "x", "é" * 25_000, "x" * 21_000 + " y", "I'm 12 years\n\n old —  ok", "​﻿   z"])
def test_both_tokenizers_agree(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    assert packing.token_ids(text, queries.tokenizer_path()).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_best_fit_plan_places_every_piece_once():
    rng = random.Random(7)
    for _ in range(20):
        counts = {size: rng.randint(1, 40) for size in rng.sample(range(1, 129), 30)}
        room = {}
        for size, first, end, sequence, each, offset in packing.best_fit_plan(counts, 128):
            for rank in range(first, end):
                place = (sequence + (rank - first) // each, offset + (rank - first) % each * size)
                room.setdefault(place[0], []).append((place[1], size))
                counts[size] -= 1
        assert not any(counts.values())
        for own in room.values():
            at = 0
            for offset, size in sorted(own):
                assert offset == at
                at += size
            assert at <= 128


def test_secrets(docs, none, spark):
    assert secrets.scan_table(docs).count() == len(ROWS) and secrets.scan_table(none).count() == 0 and secrets.find_secrets(none).count() == 0
    source = 'KEY = "aZ3$kd93Lq0xPw"\nother = KEY\nDB_PASSWORD = other\nname = "nothing here"\npaſsword=abcdef token=ab token=abcdef AKIA' + "A" * 16 + " " + "0a" * 12
    rows = {(r["kind"], source[r["start"] : r["end"]]) for r in secrets.find_secrets(spark.createDataFrame([(1, source)], "doc_id long, text string")).collect()}
    assert {("literal", "aZ3$kd93Lq0xPw"), ("assign", "token=abcdef"), ("access", "AKIA" + "A" * 16), ("hex", "0a" * 12)} <= rows
    assert ("assign", "token=ab") not in rows and not any("ſ" in text for _, text in rows)
    got = secrets.scan_table(spark.createDataFrame([(1, source)], "doc_id long, text string")).first()
    assert (got["n_assign"], got["n_access"], got["n_hex"], got["base_sha256"]) == brute.secrets(source)


def test_secrets_of_any_length():
    rng = random.Random(6)
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(10_000))
    long = "part_" * 18 + "passphrase"
    assert len(long) == 100
    for source in (f'privatekey = "{blob}"', f"KEY_BLOB = '{blob}'\ncredential = KEY_BLOB", f'{{"{long}": "{blob[:40]}"}}', f"--{long}={blob[:40]}", f'{long} = "{blob[:40]}"'):
        start = source.index(blob[:40])
        name = "credential" if "credential" in source else "privatekey" if "privatekey" in source else long
        assert [x[:4] for x in secrets.lexed_spans(source)] == [(start, start + (10_000 if blob in source else 40), "literal", name)]


@pytest.mark.parametrize("name", [*secrets.SENSITIVE, "session_cookie", "encryption_key", "signing_key", "ssh_key", "sshKey"])
def test_every_sensitive_name_takes_random_literals(name):
    for value in ("q9Xv7LmZ2pRt8KwYb4Nc6HsJ", "9233A8ECF7C5B09FE5949719B6B82BC4", "JBSWY3DPEHPK3PXPQ5Z7KMLA2RTUGN4C"):
        assert [x[:4] for x in secrets.lexed_spans(f'{name} = "{value}"')] == [(len(name) + 4, len(name) + 4 + len(value), "literal", name)]
    for value in ("primary", "customer_id", "two words", "changeme", "a1"):
        if secrets.SENSITIVE.get(name, 0) <= 0.8:
            assert not secrets.lexed_spans(f'{name} = "{value}"')


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="home"><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head&amp;line</h1><p>One<br>two &lt;x&gt;&nbsp;<b>bold</b><!-- gone --><p>Unclosed<div class="ad">Buy</div><ul><li>a<li>b</ul><form><input value=">">Send</form>
<section id="comments"><p>First!</p></section><script>var t="</p>";</script></article><aside>Side</aside><footer>Foot</footer>"""


def test_pages(spark):
    rows = [(1, "https://A.example/x", PAGE), (2, None, None), (3, "https://a.example/y", ""), (4, "nonsense", "plain & simple"), (5, "https://b.example", "<p>cut <b"), (5, "https://b.example", "<p>cut <b")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "low": F.lit("clash"), "text": F.lit("clash"), "page_host": F.lit("clash")})
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(frame).collect())
    assert got == [(1, "Head&line\n\nOne two <x> bold\n\nUnclosed\n\na\n\nb"), (2, ""), (3, ""), (4, "plain & simple"), (5, "cut"), (5, "cut")]
    assert html_text.extract(frame.where("page_id = 0")).count() == 0


def test_site_style_tree_drops_what_recurs(spark):
    page = lambda i: f'<body><div class="top"><p>Same slogan</p></div><div class="story"><p>Story {i} tells of {i * 7}</p></div></body>'
    frame = spark.createDataFrame([(i, "https://c.example/p", page(i)) for i in range(12)] + [(99, "https://rare.example/", page(99))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(frame).collect()}
    assert got[3] == "Story 3 tells of 21"
    assert got[99] == "Same slogan\n\nStory 99 tells of 693"  # one page is no evidence


def test_site_style_tree_drops_what_recurs_inside_articles(spark):
    story = lambda i: f'<body><main><article class="x"><h1>Head {i}</h1><p>Story {i} tells of {i * 7}</p><div class="box"><p>Follow us every day</p></div></article></main></body>'
    copy = '<body><article><h1>Again</h1><p>The same story</p><div class="box"><p>Follow us every day</p></div></article></body>'
    near = lambda i: copy.replace("</article>", f'<p class="small">Version {i}</p></article>')
    bare = "<body><article>Only text</article></body>"
    rows = [(i, "https://c.example/p", story(i)) for i in range(12)]
    rows += [(100 + i, "https://copies.example/p", copy) for i in range(12)]
    rows += [(200 + i, "https://near.example/p", near(i)) for i in range(12)]
    rows += [(300 + i, "https://bare.example/p", bare) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(12)] == [f"Head {i}\n\nStory {i} tells of {i * 7}" for i in range(12)]
    same = "Again\n\nThe same story\n\nFollow us every day"  # the article of every page of its host
    assert all(got[100 + i] == same and got[200 + i] == f"{same}\n\nVersion {i}" and got[300 + i] == "Only text" for i in range(12))


def test_names_alone_remove_no_article():
    probes = {
        '<div class="with-sidebar"><p>A text that stands</p></div>': "A text that stands",
        '<article><div class="comment-enabled post"><p>Good</p></div></article>': "Good",
        '<main><section id="related-work"><p>Earlier work</p></section></main>': "Earlier work",
        '<p>Good <span class="share">x</p>': "Good",
        "<p title=don't>one</p>": "one",
        '<p>text <a href="foo>lost': "text",
        '<div class="comments"><p>The page</p></div>': "The page",
        '<form action="/"><h1>T</h1><p>All of the page</p></form>': "T\n\nAll of the page",
        "<nav><a>Home</a></nav>": "",
        '<p>A text of some length</p><div class="share-buttons">Share</div><div class="relatedPosts">Other</div>': "A text of some length",
        '<header><h1>Site</h1></header><article><p>Inside</p></article><div>beside</div>': "Inside",
        '<a title="x>y">1 < 2</a> & </ 3>4': "1 < 2 & 4",
        "<p" + " a" * 200_000 + ">deep" + "<div>" * 50_000 + "x" + "</i><b>" * 50_000: "deep\n\nx",
    }
    assert {html: html_text.main_text(html) for html in probes} == probes


def test_importance_is_that_of_entropies_and_decides(spark):
    """The tree against its definition, without and with article; and the same pages with the tree switched off."""
    import math
    from collections import defaultdict

    rng = random.Random(12)
    plain = lambda i: f'<div class="a"><p>{rng.choice(["Slogan", "Motto"])}</p></div><div class="b"><p>Story {i}</p><p>More of {i}</p></div><div class="c">{rng.choice(["<b>x</b>", "<i>x</i>", "x"])}</div>'
    rows = [(i, "https://one.example/", f"<body>{plain(i)}</body>") for i in range(30)]
    rows += [(100 + i, "https://two.example/", f"<body><article><h1>Head {i}</h1>{plain(i)}</article></body>") for i in range(30)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {(r["host"], r["path"]): (r["pages"], r["importance"]) for r in html_text.style_tree(frame).collect()}
    pages, texts, styles = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for i, url, html in rows:
        host, page = url[8:19], html_text.Page(html)
        for node, pieces in page.blocks:
            pages[host, node.path].add(i)
            texts[host, node.path]["".join(t for _, t in pieces)].add(i)
        for node, style in page.styles():
            pages[host, node.path].add(i)
            styles[host, node.path][style].add(i)
    for key, held in pages.items():
        m = math.log(len(held))
        content = 1 - sum(math.log(len(n)) for n in texts[key].values()) / len(texts[key]) / m if texts[key] else None
        shown = sum(len(n) for n in styles[key].values())
        look = -sum(len(n) / shown * math.log(len(n) / shown) for n in styles[key].values()) / m if shown else 0.0
        want = 1.0 if content is None else 0.9 * content + 0.1 * look
        pages_got, importance = got[key]
        assert pages_got == len(held) and importance == pytest.approx(want)
    on = {r["page_id"]: r["text"] for r in html_text.extract(frame).collect()}
    off = {r["page_id"]: r["text"] for r in html_text.extract(frame, recurrent=0.0).collect()}
    for i in range(30):
        assert on[i] == f"Story {i}\n\nMore of {i}" and on[100 + i] == f"Head {i}\n\n{on[i]}"
        assert off[i].startswith(("Slogan", "Motto")) and on[i] in off[i] and off[100 + i] != on[100 + i]


def test_exact(docs, none):
    for keep, of in (("max", max), ("min", min)):
        got = sorted(((r["id"] or 0, r["keep_id"] or 0, r["group_size"]) for r in exact_dedup.exact_duplicates(docs, keep=keep).collect()))
        by = {}
        for i, t, *_ in ROWS:
            by.setdefault(t or "", []).append(i)
        want = sorted((i or 0, of([x for x in by[t or ""] if x is not None], default=0), len(by[t or ""])) for i, t, *_ in ROWS)
        assert got == want
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_hits_are_verified_byte_by_byte(docs):
    """With a digest that collides all the time the result stays the same."""
    weak = exact_dedup.exact_duplicates(docs, keep="max", digest=lambda t: F.substring(F.coalesce(t, F.lit("")), 1, 2))
    strong = exact_dedup.exact_duplicates(docs, keep="max")
    table = lambda df: sorted((str(r["id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in df.collect())
    assert table(weak) == table(strong)


def test_filters_decide_what_is_looked_up(spark):
    """Single texts reach neither a merge nor the exact lookup; with a full filter all would."""
    rows = [(i, f"text number {i}") for i in range(3000)] + [(5000 + i, f"text number {i}") for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, text string").repartition(8).select("id", exact_dedup.sha256(F.col("text")).alias("digest"), F.spark_partition_id().alias("memtable"))
    frame = exact_dedup.stored(frame, "test")
    index = exact_dedup.DigestIndex("max")
    index.flush(frame)
    assert index.entries.select("run").distinct().count() == exact_dedup.FAN_IN
    crossed = {r["maybe"]: r["count"] for r in index.crossed().groupBy("maybe").count().collect()}
    assert crossed[True] < 0.1 * crossed[False]
    index.compact()
    maybe, single = index.split(frame)
    assert 80 <= maybe.count() < 400 and maybe.count() + single.count() == len(rows)
    found = {r["id"]: (r["keep_id"], r["entries"]) for r in index.probe(frame).collect()}
    assert all(found[i] == found[5000 + i] == (5000 + i, 2) for i in range(40)) and all(found[i] == (None, None) for i in range(40, 3000))
    more = spark.createDataFrame([(9000 + i, f"text number {i}") for i in range(100, 110)], "id long, text string")
    index.flush(more.select("id", exact_dedup.sha256(F.col("text")).alias("digest"), F.lit(0).alias("memtable")))  # a later batch joins the level
    level = {r["keep_id"]: r["entries"] for r in index.compact().where("entries > 1").collect()}
    assert level == {5000 + i: 2 for i in range(40)} | {9000 + i: 2 for i in range(100, 110)}


def test_mixing(docs, none):
    rows = mixing.plan_mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["taken"] == r["size"] * r["copies"] and r["copies"] == len(r["positions"]) <= 3 for r in rows)
    assert all(0 <= p < 1 and list(r["positions"]) == sorted(r["positions"]) for r in rows for p in r["positions"])
    assert all(r["copies"] == 0 for r in rows if r["size"] == 0)
    again = mixing.plan_mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    stream = mixing.mixed_stream(mixing.plan_mix(docs)).collect()
    assert [r["position"] for r in stream] == sorted(r["position"] for r in stream)
    assert mixing.plan_mix(none).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10}, {"a": 5}, {"a": 0, "b": 0}, {"a": 1, "b": 1, "c": 10**9, None: 7}, {chr(97 + i): 10 ** (i % 5) for i in range(20)}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    want = brute.targets(sizes)
    assert got.keys() == sizes.keys() and all(got[s] == pytest.approx(want.get(s, 0)) for s in sizes)


def test_media(docs, none):
    made = media.to_media(docs)
    got = media.read_media(made).collect()
    for r in got:
        text = next(t for i, t, *_ in ROWS if i == r["doc_id"] and len((t or "").encode()) == r["n_bytes"])
        assert r["payload_sha256"] == hashlib.sha256(brute.padded(text)).hexdigest() and len(r["feature"]) == 16
    assert media.read_media(media.to_media(none)).count() == 0


def test_png_filters_and_checksums():
    import zlib

    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (7, 40)).astype(np.uint8)
    lines = bytearray()
    for y, kind in enumerate([0, 1, 2, 3, 4, 4, 3]):  # encode with every filter by the definition
        lines.append(kind)
        for x in range(40):
            a, b, c = (int(image[y, x - 1]) if x else 0), (int(image[y - 1, x]) if y else 0), (int(image[y - 1, x - 1]) if x and y else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines.append((int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
    header = (40).to_bytes(4, "big") + (7).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    packed = zlib.compress(bytes(lines))
    file = media.SIGNATURE + media._chunk(b"IHDR", header) + media._chunk(b"tEXt", b"k\0v") + media._chunk(b"IDAT", packed[:9]) + media._chunk(b"IDAT", packed[9:]) + media._chunk(b"IEND", b"")
    assert (media.decode_png(file) == image).all()
    for bad in (file[:-1], file[:40] + bytes([file[40] ^ 1]) + file[41:], b"GIF" + file[3:]):
        with pytest.raises(media.BadImage):
            media.decode_png(bad)

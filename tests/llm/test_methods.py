"""The dealt methods against plain versions of them: mixtures, schedules, logs, images, tokens."""

import json
import random
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from goldleaf.llm import chat, language_id, media, mixing, packing, queries, secrets

from . import brute


# -- language ID


def mixture(counts, likelihood, penalty=3.0):
    """Expectation-maximisation and backward selection with plain loops: {language index: share}."""
    seen = [(n, likelihood[b]) for b, n in enumerate(counts) if n]
    total = sum(n for n, _ in seen)

    def maximise(active, share):
        share = {a: s / sum(share.values()) for a, s in share.items()}
        if len(active) > 1:
            for _ in range(25):
                new = dict.fromkeys(active, 0.0)
                for n, row in seen:
                    whole = sum(share[a] * row[a] for a in active)
                    for a in active:
                        new[a] += n * share[a] * row[a] / whole / total
                new = {a: s / sum(new.values()) for a, s in new.items()}
                moved = max(abs(new[a] - share[a]) for a in active)
                share = new
                if moved < 1e-3:
                    break
        return share, sum(n * np.log(sum(share[a] * row[a] for a in active)) for n, row in seen)

    active = list(range(likelihood.shape[1]))
    share, fit = maximise(active, dict.fromkeys(active, 1.0))
    while len(active) > 1:
        least = min(share.values())
        out = max(a for a in active if share[a] == least)
        rest = [a for a in active if a != out]
        tried, other = maximise(rest, {a: max(share[a], 1e-3) for a in rest})
        if other + penalty * np.log(total + 1) < fit:
            break
        active, share, fit = rest, tried, other
    return share


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id.fit(docs, ~language_id.held_out(docs["doc_id"]))


def test_every_prediction_is_that_of_plain_loops(spark, sf_dir, model):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    known = model.known
    for r in queries.op4_language_id(spark, sf_dir).collect():
        text = docs[r["doc_id"]]
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            want = ("und", 0.0)
        else:
            counts = language_id.trigram_counts(text) * known
            share = mixture(counts, model.likelihood) if counts.any() else {0: 0.0}
            best = max(share, key=lambda a: (share[a], -a))
            want = (model.languages[best], share[best])
        assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1], abs=1e-6)


def test_letters_ties_and_no_evidence(spark):
    rows = [(i, "aaa bbb ccc", lang) for i, lang in enumerate(["zz", "mm", "aa"] * 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(frame, F.lit(True))
    assert model.languages == ("aa", "mm", "zz")
    assert model.predict("aaa bbb") == ("aa", 1.0)  # equal likelihoods: the first
    assert model.predict("a") == model.predict("qqq xxx") == ("aa", 0.0)  # nothing was seen
    for text in ("½", "² ³", "12 ٣", "_", "", None, "…"):
        assert model.predict(text) == ("und", 0.0)
    for text in ("é", "ª", "漢", "ǅ"):
        assert model.predict(text)[0] != "und"


def test_more_languages_than_are_learnt(spark):
    rows = [(i, f"text of kind {i % 300}", f"l{i % 300:03}") for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(frame, F.lit(True), max_languages=100)
    assert model.languages == tuple(f"l{i:03}" for i in range(100))  # those of three rows
    assert {r["lang_pred"] for r in language_id.identify(frame, model).collect()} <= set(model.languages)


# -- mixing


def test_repeated_ids_with_different_texts_agree_in_every_run(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(7), " ".join(["w"] * rng.randrange(1, 30)) + f" {n}", rng.choice(["a", "b", None])) for n in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(str, mixing.plan_mix(frame.repartition(n)).collect())) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]


def test_positions_follow_the_integrated_schedule(spark):
    """Each source's share of the stream up to time t is the integral of its schedule."""
    rows = [(i, "one two three four", "abc"[i % 3]) for i in range(1500)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    weight = {"a": 1, "b": 2, "c": 3}
    for source, w in weight.items():
        spots = sorted(p for r in plan if r["source"] == source for p in r["positions"])
        start, end = mixing.RAMPS[w]
        for t in (0.1, 0.35, 0.5, 0.8, 1.0):
            want = (start * t + (end - start) * t * t / 2) * len(spots)
            assert abs(sum(p < t for p in spots) - want) <= 2


def test_mixed_documents_are_whole_rows_in_stream_order(spark):
    rows = [(i % 40, f"text {i % 50} with some words", "ab"[i % 2], "x") for i in range(200)] + [(None, "no id", None, None)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, row string")
    stored = mixing.mixed_documents(frame).collect()
    plan = mixing.plan_mix(frame).collect()
    assert len(stored) == sum(r["copies"] for r in plan)
    got, want = Counter((r["doc_id"], r["source"]) for r in stored), Counter()
    for r in plan:
        want[r["id"], r["source"]] += r["copies"]
    assert got == +want and {(r["doc_id"], r["text"], r["source"], r["row"]) for r in stored} <= set(rows)


@pytest.mark.parametrize("count", [1, 2, 400])
def test_targets_of_many_sources(spark, count):
    rng = random.Random(count)
    sizes = {f"host{i:03}": rng.choice([0, 1, 10, 10**4, 10**6]) for i in range(count)}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)).collect()}
    want = brute.targets(sizes)
    assert got.keys() == sizes.keys() and all(got[s] == pytest.approx(want.get(s, 0)) for s in sizes)


# -- chat


def test_the_log_of_a_table_has_every_kind_of_event(spark, sf_dir):
    log = chat.as_log(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == set(chat.KINDS)


def test_a_long_conversation_is_spread_over_tasks(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"said {i} " + "long \\ <text> " * 30) for i in range(3000)] + [(2, 0, "user", "x" * 300_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        segments = chat.stored(chat.format_log(chat.as_log(frame)), "test")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert segments.where("conv_id = 1").select(F.input_file_name()).distinct().count() > 1
    assert [r["position"] for r in segments.where("conv_id = 1").orderBy("position").collect()] == list(range(3000))
    whole = "".join(r["formatted"] for r in segments.where("conv_id = 1").orderBy("position").collect())
    assert chat.read_back(whole) == [(r, t) for c, _, r, t in rows if c == 1]
    want = brute.chats(rows)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.conversation_digests(segments).collect()}
    assert got == want


# -- media


def cosine_bits(image, side=32, low=8):
    """The hash by the definition of the transform: block means, then sums of cosines one by one."""
    height, width = image.shape
    small = np.zeros((side, side))
    for y in range(side):
        top, bottom = y * height // side, (y + 1) * height // side
        for x in range(side):
            small[y, x] = image[min(top, height - 1) : max(bottom, min(top, height - 1) + 1), x * width // side : (x + 1) * width // side].mean()
    values = []
    for u in range(low):
        for v in range(low):
            total = sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / (2 * side)) * np.cos(np.pi * (2 * x + 1) * v / (2 * side)) for y in range(side) for x in range(side))
            values.append(round(total, 6))
    middle = sorted(values)
    middle = (middle[31] + middle[32]) / 2
    return f"{int(''.join('1' if v > middle else '0' for v in values), 2):016x}"


def test_features_and_stored_forms(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 25").collect()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    files = {r["doc_id"]: bytes(r["media"]) for r in media.to_media(docs).collect()}
    for r in media.read_media(media.to_media(docs)).collect():
        file = files[r["doc_id"]]
        image = np.frombuffer(brute.padded(texts[r["doc_id"]]), np.uint8).reshape(-1, 576)
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), __import__("hashlib").sha256(file).hexdigest())
        assert r["feature"] == cosine_bits(image)


# -- packing


def test_tokenizers_agree_on_any_text():
    """Ids of both libraries on random strings of every script, and on every code point of the lower planes."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path())
    rng = random.Random(11)
    alphabets = [
        "abc ABC'st \n\t.,", "éüßñçøÅ ", "漢字かなカナ한글 ", "абвгд ЖЗ ", "العربية ", "हिन्दी ", "0123456789٠١٢½² ", "🙂👩\u200d👧\ufe0f ", "\u00a0\u2003\u3000\u200b\ufeff\x1c\x85 \r\n",
        "".join(map(chr, range(1, 0x300))), "".join(chr(c) for c in range(0x2000, 0x2200)),
    ]
    texts = ["".join(rng.choices(rng.choice(alphabets) + rng.choice(alphabets), k=rng.randrange(1, 60))) for _ in range(6000)]
    texts += ["".join(f"a{chr(c)} {chr(c)}{chr(c)}1" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000) for start in range(0, 0x20000, 64)]
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert packing.token_ids(text, queries.tokenizer_path()).tolist() == want.ids


# -- secrets

RANDOM = "q9Xv7LmZ2pRt8KwYb4Nc6HsJ"


def found(source):
    return [(source[start:end], name) for start, end, _, name, _ in secrets.lexed_spans(source)]


@pytest.mark.parametrize(("source", "want"), [
    (f'passphrase = "aB3\\"x{RANDOM}"', [(f'aB3\\"x{RANDOM}', "passphrase")]),
    (f'KEY = "{RANDOM[:12]}" + "{RANDOM[12:]}"\nDB_PWD = KEY', [(RANDOM[:12], "DB_PWD"), (RANDOM[12:], "DB_PWD")]),
    (f'a = "{RANDOM}"\nb = a + "xyz"\npassphrase = ${{b}}', [(RANDOM, "passphrase"), ("xyz", "passphrase")]),
    (f"vault:\n  credentials:\n    value: {RANDOM}\nother: {RANDOM}", [(RANDOM, "value")]),
    (f"[credentials]\nvalue = {RANDOM}\n[paths]\nvalue = {RANDOM}", [(RANDOM, "value")]),
    (f'{{"vault": {{"passphrase_store": {{"value": "{RANDOM}"}}, "id": "{RANDOM}"}}}}', [(RANDOM, "value")]),
    (f"os.environ['SIGNING_KEY'] = '{RANDOM}'", [(RANDOM, "os.environ.SIGNING_KEY")]),
    (f"const signingKey: string = `{RANDOM}`;", [(RANDOM, "signingKey")]),
    (f'#define API_SALT "{RANDOM}"\nint cookie = API_SALT;', [(RANDOM, "API_SALT")]),
    (f'conf.set("auth.cookie", "{RANDOM}")', [(RANDOM, "auth.cookie")]),
    (f"run --passphrase {RANDOM} --other {RANDOM}", [(RANDOM, "passphrase")]),
    (f"<credential>{RANDOM}</credential><name>{RANDOM}</name>", [(RANDOM, "credential")]),
    (f'<add key="DbPwd" value="{RANDOM}"/>', [(RANDOM, "DbPwd")]),
    (f"Authorization: Bearer {RANDOM}", [(RANDOM, "Authorization")]),
    (f"it's a 'b', don't passphrase = '{RANDOM}'", [(RANDOM, "passphrase")]),
    (f'passphrase = """{RANDOM}"""', [(RANDOM, "passphrase")]),
    (f'dsn = "host=a;pwd={RANDOM};x=1"', [(RANDOM, "pwd")]),
    (f'f() {{ k = "{RANDOM}"; }}\npassphrase = k', []),  # the block's binding ended
    (f'k = "short1"\nf() {{ k = "{RANDOM}"; passphrase = k }}', [(RANDOM, "passphrase")]),
    (f'# k = "{RANDOM}"\npassphrase = k', []),  # a comment binds nothing
    (f'passphrase: str = input("{RANDOM}")', []),
    (f'checksum = "{RANDOM}"', []),
])
def test_pairs_that_no_base_pattern_matches(source, want):
    assert found(source) == want and not secrets.base_spans(source)


def test_json_against_its_parser():
    """Every literal of random documents, under the names that a JSON parser gives it."""
    rng = random.Random(13)
    names = ["passphrase", "user", "signing_key", "host", "credentials", "id", "cookie", "note", "sshKey", "port"]
    alphabet = "abcXYZ019+/_-é\"\\\t'{}=:"

    def tree(depth):
        return {rng.choice(names) + str(n): tree(depth - 1) if depth and rng.random() < 0.4 else "".join(rng.choices(alphabet, k=rng.randrange(0, 30))) for n in range(4)}

    def leaves(node, names):
        for name, value in node.items():
            if isinstance(value, dict):
                yield from leaves(value, [*names, name])
            else:
                weight = max(secrets.name_score(name), *(secrets.AROUND * secrets.name_score(n) for n in names), 0.0)
                raw = json.dumps(value, ensure_ascii=False)[1:-1]
                literal = secrets.literal_score(secrets._ESCAPE.sub(r"\1", raw))
                if weight * (0.4 + 0.6 * literal) >= secrets.THRESHOLD and literal:
                    yield raw, name

    total = 0
    for n in range(300):
        made = tree(3)
        source = json.dumps(made, ensure_ascii=False, indent=rng.choice([None, 2]))
        want = Counter(leaves(made, []))
        got = Counter(x for x in found(source) if x[1][:-1] in names)
        assert +(want - got) == Counter()
        total += sum(want.values())
    assert total > 300


def test_propagation_against_the_interpreter():
    """Straight-line programs: a sensitive name has the literals that running the program gives it."""
    rng = random.Random(14)
    for _ in range(200):
        lines, value = [], {}
        for n in range(12):
            name = rng.choice(["passphrase", "signing_key", "plain", "other", "thing"]) + str(n)
            known = [x for x in value if value[x]]
            parts = []
            for _ in range(rng.randrange(1, 3)):
                parts.append(rng.choice(known) if known and rng.random() < 0.5 else repr("".join(rng.choices("abcdefXYZ0123456789/+'\"", k=rng.randrange(4, 20)))))
            lines.append(f"{name} = {' + '.join(parts)}")
            value[name] = [y for x in parts for y in (value[x] if x in value else [x])]
        source, scope = "\n".join(lines), {}
        exec(source, {}, scope)  # the test's own program
        want = set()
        for name, literals in value.items():
            assert scope[name] == "".join(eval(x) for x in literals)  # noqa: S307
            literal = secrets.literal_score(scope[name])
            if literal and secrets.name_score(name) * (0.4 + 0.6 * literal) >= secrets.THRESHOLD:
                want |= {x[1:-1] for x in literals}
        assert want <= {text for text, _ in found(source)}


@pytest.mark.parametrize("part", ['a = "', "'", "x.", "{", 'a="b"+', "<a>", "`", "a: ", "\\", '("', "--a ", '"""', "x['", "  k:\n", 'a="""', "${a}"])
def test_the_lexer_is_linear(part):
    began = time.perf_counter()
    secrets.lexed_spans(part * 20_000)
    once = time.perf_counter() - began
    began = time.perf_counter()
    secrets.lexed_spans(part * 80_000)
    assert time.perf_counter() - began < 12 * once + 0.5

"""Secret scans: three base patterns, and an assignment-aware lexer on top of them.

The lexer reads a text as loose source, configuration or markup and finds its name-literal pairs:

- names: words with dots and hyphens, quoted keys, subscripts (``env["NAME"]``), declared with or
  without a type; operators ``=``, ``:``, ``:=``, ``=>``; also ``#define NAME "x"``,
  ``set("name", "x")``, ``--name x``, ``key="name" value="x"`` and ``<name>x</name>``;
- literals: strings with escapes, in one, three or back quotes; strings joined by ``+``, ``.``, ``..``
  or by standing side by side; bare values; ``Bearer`` and ``Basic`` credentials;
- a name belongs to the keys around it: to open braces (``{"vault": {"value": ...``), indented blocks
  (``vault:`` and deeper lines) and sections (``[vault]``).

Names bound to literals are constants; a name bound to names, or to names and strings joined, takes
over their literals (propagation, in text order, over any number of steps). A binding holds to the
end of its block in braces; comments and the insides of strings are read but bind nothing. Every
literal that reaches a name is scored by the name, or at ``AROUND`` of it by the keys around it, and by
the literal's own make-up; those at or over the threshold are reported as spans of kind ``literal``,
where the literals stand.

Defined results: a null text counts as empty; the base spans are always there, whatever the lexer
adds; names and literals may have any length, and very long texts are read whole, in linear time (but
for constants that grow by each other, which cost the sum of their lengths); strings that no quote
closes are none; offsets are code points, ends exclusive; rows that repeat an
id give their spans each; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex")

_STRING = r"""(?:\"{3}(?:[^"\\]++|\\.|"(?!""))*+"{3}|'{3}(?:[^'\\]++|\\.|'(?!''))*+'{3}|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`)"""
_NAME = r"[A-Za-z_$][A-Za-z0-9_.$\-]*+"
_SUBSCRIPTS = r"""(?:\[[ \t]*+(?:"[^"\n]*+"|'[^'\n]*+')[ \t]*+\])*+"""

#: One step of the lexer. A bare name is looked for at the start of its run only, and runs aren't
#: given back, so names and literals of any length take linear time.
STEP = re.compile(
    rf"""
      (?P<close>\}})
    | ^[ \t]*+\[(?P<section>[^\]\["'\n]++)\][ \t]*+$
    | (?:(?P<q>["'])(?P<quoted>[^"'\n:=]++)(?P=q) | (?<![A-Za-z0-9_.$\-])[0-9.\-]*+(?P<plain>{_NAME}{_SUBSCRIPTS}))
      [ \t]*+ (?: (?: :[ \t]*+[A-Za-z_][A-Za-z0-9_.<>|?]*+[ \t]*+ )? =(?!=)>? | := | : )
      [ \t]*+ (?: (?P<open>\{{) | [rbfuRBFU]{{0,2}}(?P<string>{_STRING}) | (?:[Bb]earer|[Bb]asic)[ ](?P<credential>[^\s"'`#;,(){{}}\[\]<>&]++)
               | (?P<bare>\$\{{[A-Za-z_][A-Za-z0-9_.]*+\}}|[^\s"'`#;,(){{}}\[\]<>&]++) | (?P<nest>$) )
    | \#define[ \t]++(?P<macro>{_NAME})[ \t]++(?P<expansion>{_STRING})
    | \([ \t]*+(?P<argument>{_STRING})[ \t]*+,[ \t]*+(?P<passed>{_STRING})
    | (?<!\S)--(?P<flag>[A-Za-z][A-Za-z0-9_.\-]*+)[ \t]++(?P<given>{_STRING}|[^\s"'`;\-][^\s"'`;]*+)
    | <(?P<element>[A-Za-z_][A-Za-z0-9_.:\-]*+)(?:[ \t][^<>]*+)?>(?P<content>[^<>\n]++)</(?P=element)
    | (?P<brace>\{{)
    """,
    re.ASCII | re.VERBOSE | re.MULTILINE | re.DOTALL,
)
#: What continues a value: a further string, or a name after a plus sign.
JOINED = re.compile(rf"[ \t]*+(?:(?:\+|\.\.?)\s*+)?(?P<string>{_STRING})|\s*+\+\s*+(?P<name>{_NAME})(?![ \t]*+[(\[=:])", re.ASCII | re.DOTALL)
#: In markup, a value attribute takes its name from the key attribute before it.
KEYED = re.compile(r"""[ \t]++value[ \t]*+=[ \t]*+(?P<string>"[^"\n]*+"|'[^'\n]*+')""", re.ASCII)
IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*\Z", re.ASCII)
REFERENCE = re.compile(r"\$\{?([A-Za-z_][A-Za-z0-9_.]*)\}?\Z", re.ASCII)
COMMENT = re.compile(r"\s*(?:#(?!define\b)|//|/\*|\*|--\s|;|<!--|%)")
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_SUBSCRIPT = re.compile(r"""["']([^"']*)["']""")

#: Score of a name by the parts that make it up; each is high enough for a random literal to pass the threshold.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.8,
    "authorization": 0.8, "bearer": 0.8, "signature": 0.8, "key": 0.8, "salt": 0.8, "cookie": 0.8,
}

#: Values that only stand for a secret.
PLACEHOLDERS = {"none", "null", "true", "false", "changeme", "example", "undefined", "redacted", "placeholder", "required", "optional"}
THRESHOLD = 0.7
#: What the keys around a name weigh against the name itself.
AROUND = 0.85
#: Hexadecimal digits of 128 bits and more: that so few characters occur says nothing against them.
DIGITS = re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}\Z", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]  # maximal runs, so the shorter ones are left out
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


@functools.lru_cache(1 << 14)
def name_score(name: str) -> float:
    """How sensitive a target name is, 0 to 1."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    parts = [p for p in re.split(r"[^A-Za-z]+", spaced.lower()) if p]  # token2 is a token
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((max(SENSITIVE.get(p, 0.0), 0.9 * SENSITIVE.get(p.removesuffix("s"), 0.0)) for p in parts + joined), default=0.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret, 0 to 1, by length, alphabet and entropy."""
    if len(value) < 6 or value.lower() in PLACEHOLDERS or len(set(value)) < 4 or " " in value.strip():
        return 0.0
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    alphabet = 1.0 if DIGITS.match(value) else 0.6 + 0.2 * (classes - 1)
    return min(1.0, 0.25 * entropy * min(1.0, len(value) / 12) * alphabet)


Value = tuple[str, tuple[tuple[int, int], ...]]  # a literal, and where its parts stand


class _Bindings:
    """Constants by name; those of a block in braces end with it."""

    def __init__(self) -> None:
        self.held: dict[str, list[tuple[int, Value]]] = {}
        self.blocks: list[list[str]] = [[]]

    def open(self) -> None:
        self.blocks.append([])

    def close(self) -> None:
        if len(self.blocks) > 1:
            for name in self.blocks.pop():
                self.held[name].pop()

    def bind(self, name: str, value: Value) -> None:
        depth, own = len(self.blocks), self.held.setdefault(name, [])
        if own and own[-1][0] == depth:
            own[-1] = (depth, value)
        else:
            own.append((depth, value))
            self.blocks[-1].append(name)

    def get(self, name: str) -> Value | None:
        own = self.held.get(name)
        return own[-1][1] if own else None


class _Around:
    """The keys around the place that the lexer is at, as the score of the most sensitive one."""

    def __init__(self) -> None:
        self.section = 0.0
        self.braces: list[float] = []
        self.indents: list[tuple[int, float]] = []

    def score(self, indent: int) -> float:
        while self.indents and self.indents[-1][0] >= indent:
            self.indents.pop()
        inner = self.indents[-1][1] if self.indents else 0.0
        return max(inner, self.braces[-1] if self.braces else 0.0, self.section)


def _content(text: str, start: int, end: int) -> tuple[int, int]:
    """A quoted string without its quotes."""
    width = 3 if end - start >= 6 and text[start] == text[start + 1] == text[start + 2] else 1
    return start + width, end - width


def _joined(text: str, at: int, edge: int, parts: list[Value], bound: _Bindings) -> tuple[list[Value], int, list[tuple[int, int]]]:
    """``parts`` with the strings and constants that are joined to them from ``at`` on, where they end, and the strings' places."""
    strings = []
    while (m := JOINED.match(text, at, edge)) is not None:
        if m["string"] is not None:
            span = _content(text, *m.span("string"))
            strings.append(span)
            parts.append((_ESCAPE.sub(r"\1", text[slice(*span)]), (span,)))
        elif (known := bound.get(m["name"])) is not None:
            parts.append(known)
        else:
            break
        at = m.end()
    return parts, at, strings


def lexed_spans(text: str) -> list[tuple[int, int, str, str, float]]:
    """(start, end, 'literal', name, score) of literals that reach a sensitive name."""
    best: dict[tuple[int, int], tuple[float, str]] = {}
    bound, around = _Bindings(), _Around()
    # Strings that were read as literals are searched for pairs as well, each up to its own edge.
    at, edge, resume, strings = 0, None, 0, []
    line, line_end, indent, comment = 0, -1, 0, False

    def reached(name: str, value: Value, outer: float) -> None:
        weight = max(name_score(name), AROUND * outer)
        if weight and (literal := literal_score(value[0])):
            score = weight * (0.4 + 0.6 * literal)
            if score >= THRESHOLD:
                for span in value[1]:
                    if score > best.get(span, (0.0, ""))[0]:
                        best[span] = (score, name)

    while True:
        m = STEP.search(text, at) if edge is None else STEP.search(text, at, edge)
        if m is None:
            if edge is None:
                break
            at, edge = strings.pop() if strings else (resume, None)
            continue
        kind, nested, limit = m.lastgroup, edge is not None, len(text) if edge is None else edge
        at = m.end()
        if nested and kind in ("close", "brace", "section", "open", "nest"):
            continue
        if kind == "close":
            bound.close()
            if around.braces:
                around.braces.pop()
            continue
        if kind == "brace":
            bound.open()
            around.braces.append(around.braces[-1] if around.braces else 0.0)
            continue
        if kind == "section":
            around.section = name_score(m["section"])
            continue
        if m.start() > line_end:  # another line
            line = text.rfind("\n", 0, m.start()) + 1
            line_end = text.find("\n", m.start())
            line_end = len(text) if line_end < 0 else line_end
            head = text[line : m.start()]
            indent = len(head) - len(head.lstrip(" \t-"))
            comment = COMMENT.match(text, line, line_end) is not None
        name = m["quoted"] or m["plain"] or m["macro"] or m["flag"] or m["element"] or ""
        if m["argument"] is not None:
            name = text[slice(*_content(text, *m.span("argument")))]
        if m["plain"] and "[" in name:
            head, _, rest = name.partition("[")
            name = ".".join([head, *_SUBSCRIPT.findall(rest)])
        outer = around.score(indent)
        if kind == "open":
            bound.open()
            around.braces.append(max(outer, name_score(name)))
            continue
        if kind == "nest":
            around.indents.append((indent, max(outer, name_score(name))))
            continue
        quoted = next((g for g in ("string", "expansion", "passed") if m[g] is not None), None)
        if quoted is None and m["given"] is not None and m["given"][0] in "\"'`":
            quoted = "given"
        if quoted is not None:
            span = _content(text, *m.span(quoted))
            parts, end, more = _joined(text, at, limit, [(_ESCAPE.sub(r"\1", text[slice(*span)]), (span,))], bound)
            more.insert(0, span)
            if name.lower() in ("key", "name") and (keyed := KEYED.match(text, at, limit)) is not None:
                name, span, end = parts[0][0], _content(text, *keyed.span("string")), keyed.end()
                parts, more = [(text[slice(*span)], (span,))], [span]
        else:
            group = next(g for g in ("credential", "bare", "given", "content") if m[g] is not None)
            start = m.start(group)
            value = m[group].rstrip(".:!?") if group in ("bare", "given") else m[group]
            of = REFERENCE.match(value)
            source = of[1] if of else value if IDENTIFIER.match(value) else None
            known = bound.get(source) if source is not None else None
            end, more = at, []
            if known is not None:
                parts, end, more = _joined(text, at, limit, [known], bound)
            elif source is not None and (of or not any(c.isdigit() for c in value)):
                parts = []  # an unbound name is no literal
            else:
                parts = [(value, ((start, start + len(value)),))]
        whole = ("".join(p[0] for p in parts), tuple(span for p in parts for span in p[1]))
        reached(name, whole, outer)
        if not nested:
            if not comment:
                bound.bind(name, whole)
            if more:
                (at, edge), strings, resume = more[0], more[:0:-1], end
            else:
                at = end
    return sorted((*span, "literal", name, score) for span, (score, name) in best.items())


def written(spans: list[tuple]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]
)
SCAN = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_literal", pa.int64())])


def scan_document(text: str | None) -> tuple[list, list]:
    text = text or ""
    return base_spans(text), lexed_spans(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each span: doc_id, kind, start, end, name and score (null for base spans)."""

    def convert(parts):
        for part in parts:

            def rows(part=part) -> Iterator[tuple]:
                for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    base, added = scan_document(text.as_py())
                    for start, end, kind in base:
                        yield i, kind, start, end, None, None
                    for start, end, kind, name, score in added:
                        yield i, kind, start, end, name, score

            yield from batches(rows(), FOUND)

    return _narrow(docs, id_col, text_col).mapInArrow(convert, "doc_id long, kind string, start long, end long, name string, score double")


def scan_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts of base spans, digest of them, and all spans written out."""

    def convert(parts):
        for part in parts:

            def rows(part=part) -> Iterator[tuple]:
                for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    base, added = scan_document(text.as_py())
                    order = {k: n for n, k in enumerate((*KINDS, "literal"))}
                    spans = sorted([*base, *added], key=lambda x: (x[0], order[x[2]], x[1]))
                    counts = Counter(kind for _, _, kind in base)
                    digest = hashlib.sha256(written(base).encode()).hexdigest()
                    yield i, *(counts[k] for k in KINDS), digest, written(spans), len(added)

            yield from batches(rows(), SCAN)

    return _narrow(docs, id_col, text_col).mapInArrow(
        convert, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"
    )


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

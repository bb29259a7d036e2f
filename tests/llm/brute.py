"""Plain single-machine versions of the operators' contracts, to hold results against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, width=5):
    w = WORD.findall(lower_ascii(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near(docs, part=85):
    """doc_id -> (n_shingles, component_id), linked at ``part`` in 100"""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    shared = Counter()
    for ids in by.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= part * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def chats(rows):
    """conv_id -> the digest columns but for formatted_chars"""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(said), sha(said))
    return out


def lines(docs, least=20, often=3):
    """doc_id -> (n_lines, n_dropped, kept text)"""
    def key(line):
        return lower_ascii(line.strip(BLANK))

    held = defaultdict(set)
    for i, text in docs:
        for x in (text or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    out = {}
    for i, text in docs:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if not (len(ids := held.get(key(x), ())) >= often and max(ids) != i)]
        out[i] = (len(all_), len(all_) - len(kept), "\n".join(kept))
    return out


ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    n = Counter(k for _, _, k, _ in found)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in found))


def exact(docs):
    by = defaultdict(list)
    for i, t in docs:
        by[t or ""].append(i)
    return {i: (max(ids), len(ids), i == max(ids), sha(t)) for t, ids in by.items() for i in ids}


def targets(sizes, cap=3):
    """source -> target by sharing the excess again and again"""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + n % 3 for n, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > cap * sizes[s]}
        if not over:
            target |= {s: weight[s] * unit for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


class Article(HTMLParser):
    """Text of h1 and p inside the article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in ("p", "h1"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def article(html):
    p = Article()
    p.feed(html or "")
    p.close()
    return "\n\n".join(t for b in p.blocks if (t := " ".join(b.split())))


def padded(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % 576 if raw else 576)


def crc(data):
    return zlib.crc32(data)

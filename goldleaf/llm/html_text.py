"""Main text of web pages by site style trees.

Pages of a host are merged into one style tree: a node for each path of tags and classes, with the
pages that have it, the child sequences (styles) it shows and the texts that stand in it. A node
whose texts recur from page to page has a low content importance, by their entropy; one that always
looks alike has a low presentation importance; nodes of fewer than ``MIN_PAGES`` pages give no
evidence. A repeated article is still the article: inside articles a path, text or style counts once
for all pages of the same article, known by its h1 or, without one, by its whole text.

Each element of a page then has a noise score, the sum of
- what its host's tree says against it: 1 less its importance, from ``RECURRENT`` on;
- what its name says: 2 for the tags and roles of navigation, headers, footers, asides and buttons, 1
  for forms and for classes and ids of these and of adverts, notices or comments, a half where such a
  word is one part of a longer class or id with other words;
- 1 for a branch that stands beside the page's article or main elements;
- less the share of the page's text that it holds, where any of this is against it.

A branch whose score reaches ``NOISE`` goes. So an element that holds the page's text stays whatever
its classes say, a telling class alone removes smaller branches, a telling part of a class none, and a
branch that recurs on its host goes without any telling name. Scripts, styles, heads and other raw
elements always go. An outermost article or main element has no score, and what holds all h1s of the
article, or of a page without one, has none but for its recurrence. Where all text of an article
would go, its text stands.

The tree is kept as counts by (host, path, text digest, article), summed before the shuffle, so a
host with most of the pages is spread over many tasks; each page then meets its host's noisy paths.

Defined results: a null or empty page has no text; tags are read as HTML reads them, so stray quotes
in a tag belong to it; unclosed tags, quotes and comments end with the page; a very long page is read
whole; repeated rows have the same text each, and are one page of their host each; an unknown or null
url makes a host of its own without evidence; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_columns

#: A comment, a declaration, a tag, or one of these cut off by the end of the page. In a tag a quote
#: opens a value only after the equals sign; runs aren't given back, so any text takes linear time.
_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?)*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?")
_TOKEN = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
ALWAYS = RAW | frozenset("head audio video dialog".split())
NOISE_TAGS = frozenset("nav header footer aside form button menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent "
    "notice popup modal newsletter subscribe subscription share sharing social comment comments disqus respond reply replies related recommended widget toolbar pagination pager login signup copyright".split()
)
#: Words that say nothing beside a telling one: a class made of both is telling.
PLAIN_WORDS = frozenset(
    "area bar block body bottom box btn button buttons col column container content div form group header holder inner item items left link links list main nav outer page panel post posts right row "
    "section side site slot thread title top unit wrap wrapper".split()
)
MAIN_TAGS = ("article", "main")

MIN_PAGES, CONTENT_SHARE = 8, 0.9
#: Importance under which a node's recurrence counts, and the score from which a branch goes.
RECURRENT, NOISE = 0.25, 0.5
TAG, WORD, PART, OUTSIDE = 2.0, 1.0, 0.5, 1.0


def _named(tag: str, attributes: str) -> tuple[float, str]:
    """How much tag, role, class or id say that it isn't the article; and the node's own name for its path."""
    classes, tokens, role = "", [], ""
    if attributes and "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
            if name == "class":
                classes = ".".join(sorted(value.lower().split()))
                tokens += value.split()
            elif name == "id":
                tokens += value.split()
            elif name == "role":
                role = value.strip().lower()
    own = f"{tag}.{classes}" if classes else tag
    if tag in NOISE_TAGS or role in NOISE_ROLES:
        return WORD if tag == "form" or role in ("form", "search") else TAG, own
    if tag in ("html", "body") or role == "main":
        return 0.0, own
    return max((_told(token) for token in tokens), default=0.0), own


@functools.lru_cache(4096)
def _told(token: str) -> float:
    """How telling a class or id is: wholly made of telling and plain words, or with a telling word in it."""
    words = [w for w in _TOKEN.findall(_HUMP.sub(" ", token).lower()) if not w.isdigit()]
    telling = [w for w in words if w in NOISE_WORDS]
    if not telling:
        return 0.0
    return WORD if all(w in NOISE_WORDS or w in PLAIN_WORDS for w in words) else PART


class _Node:
    """An element. Its path is a digest of its own name and its parent's path."""

    __slots__ = ("beside", "block", "children", "inside", "main", "name", "named", "noisy", "own", "path", "size", "tag", "titled", "up")

    def __init__(self, tag: str, name: str, named: float, up: _Node | None):
        self.tag, self.name, self.named, self.up = tag, name, named, up
        self.path = path_digest(name if up is None else f"{up.path}/{name}")
        self.noisy = named >= WORD or (up is not None and up.noisy)
        self.inside = up is not None and up.inside
        self.block = self if up is None or tag not in INLINE else up.block
        self.children, self.own, self.size, self.titled, self.main, self.beside = [], 0, 0, int(tag == "h1"), False, False


class Page:
    """A page's elements, parents first, and its blocks (element, pieces of text and the elements that they stand in)."""

    def __init__(self, html: str | None):
        self.root = _Node("", "", 0.0, None)
        self.nodes: list[_Node] = []
        self.blocks: list[tuple[_Node, list[tuple[_Node, str]]]] = []
        self.has_article = False
        self._read(html or "")
        for _, pieces in self.blocks:
            for node, text in pieces:
                node.own += len(text)
        for node in (self.root, *self.nodes):
            node.size = node.own
        for node in reversed(self.nodes):
            node.up.size += node.size
            node.up.titled += node.titled
            node.up.beside |= node.beside or node.main  # it holds an article

    def _read(self, html: str) -> None:
        stack, at, held = [self.root], 0, []
        open_: Counter[str] = Counter()

        def flush() -> None:
            if held:
                if any(not text.isspace() for _, text in held):
                    self.blocks.append((stack[-1].block, list(held)))
                held.clear()

        def close(depth: int) -> None:
            for node in stack[depth:]:
                open_[node.tag] -= 1
            del stack[depth:]

        def close_implied(names, scope) -> None:
            if any(open_[n] for n in names):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in names:
                        close(depth)
                        return
                    if stack[depth].tag in scope:
                        return

        while True:
            m = _TAG.search(html, at)
            if m is None:
                held.append((stack[-1], html[at:]))
                break
            if m.start() > at:
                held.append((stack[-1], html[at : m.start()]))
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:  # an end tag closes the nearest open element of its name
                if open_[tag]:
                    depth = next(d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag)
                    if any(n.tag not in INLINE for n in stack[depth:]):
                        flush()
                    close(depth)
                continue
            if tag == "br":
                held.append((stack[-1], " "))
                continue
            if tag not in INLINE:
                flush()
                if tag in CLOSES_P:
                    close_implied(("p",), ("article", "body", "td", "th", "li", "div", "section", "main", "blockquote"))
                if tag in CLOSED_BY:
                    names, scope = CLOSED_BY[tag]
                    close_implied(names.split(), scope)
            named, name = _named(tag, m[3])
            parent = stack[-1]
            if not parent.children or parent.children[-1] != name:
                parent.children.append(name)
            if tag in VOID or m[3].endswith("/"):
                continue
            if tag in ALWAYS:  # its text is not the page's, and in most not markup
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
                continue
            node = _Node(tag, name, named, parent)
            if tag in MAIN_TAGS and not node.inside and not parent.noisy:
                node.inside = node.main = self.has_article = True
            self.nodes.append(node)
            stack.append(node)
            open_[tag] += 1
        flush()

    def styles(self) -> Iterator[tuple[_Node, str]]:
        """Every element that isn't inline, and its child sequence."""
        return ((node, ",".join(node.children)) for node in self.nodes if node.tag not in INLINE)

    def text(self, noise: dict[int, float] | None = None) -> str:
        """The blocks that are left; ``noise`` has the importance of its host's recurrent paths by digest."""
        gone = set()
        for node in self.nodes:
            if node.up in gone or self._score(node, noise or {}) >= NOISE:
                gone.add(node)
        size = max(self.root.size, 1)
        # Text that stands in an element around the article is beside it as well.
        loose = {n for n in (self.root, *self.nodes) if n.beside and OUTSIDE - n.own / size >= NOISE}
        kept = list(self._rendered(lambda node: node not in gone and node not in loose))
        if not kept and self.has_article:
            kept = list(self._rendered(lambda node: node.inside))
        return "\n\n".join(kept)

    def _rendered(self, stands) -> Iterator[str]:
        for _, pieces in self.blocks:
            text = " ".join(unescape("".join(text for node, text in pieces if stands(node))).split())
            if text:
                yield text

    def _score(self, node: _Node, noise: dict[int, float]) -> float:
        if node.main or node.tag in ("html", "body"):
            return 0.0
        against = 1 - noise.get(node.path, 1.0) if noise else 0.0
        if self.root.titled and node.titled == self.root.titled and (node.inside or not self.has_article):
            return against
        outside = OUTSIDE if node.up.beside and not node.beside and not node.inside else 0.0
        if not (against or node.named or outside):
            return 0.0
        return against + node.named + outside - node.size / max(self.root.size, 1)


def main_text(html: str | None, noise: dict[int, float] | None = None) -> str:
    """The page's article; ``noise`` has the importance of the recurrent paths of its host by their digests."""
    return Page(html).text(noise)


def _article_digest(page: Page) -> int:
    """What names a page's article: its first h1 or, without one, its whole text."""
    inside = [(node, " ".join(unescape("".join(t for _, t in pieces)).split())) for node, pieces in page.blocks if node.inside]
    head = next((text for node, text in inside if node.tag == "h1"), None)
    return path_digest("\n\n".join(text for _, text in inside) if head is None else head)


def path_digest(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path.encode("utf-8", "surrogatepass")) - (1 << 63)


def host_of(url):
    """The host of a url column; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path (digest), pages, importance of each node of each host's tree."""

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for host, html in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                page = Page(html.as_py())
                article = _article_digest(page)
                rows = {(n.path, 1, path_digest(" ".join("".join(t for _, t in pieces).split())), article if n.inside else None) for n, pieces in page.blocks}
                rows |= {(n.path, 2, path_digest(s), article if n.inside else None) for n, s in page.styles()}
                rows |= {(path, 0, 0, within) for path, _, _, within in rows}
                for row in rows:
                    for column, value in zip(columns, (host, *row), strict=True):
                        column.append(value)
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "path", "kind", "feature", "article"])

    narrow = pages.select(host_of(pages[url_col]).alias("host"), pages[html_col].cast("string").alias("html")).where("host is not null")
    seen = narrow.mapInArrow(features, "host string, path long, kind int, feature long, article long")
    # Outside of articles every page counts, inside every article.
    each = seen.groupBy("host", "path", "kind", "feature", "article").agg(F.count(F.lit(1)).alias("n"))
    counted = each.groupBy("host", "path", "kind", "feature").agg(F.sum(F.when(F.col("article").isNull(), F.col("n")).otherwise(1)).alias("n"))
    # Per node: sums over features that need no second look at the number of pages.
    log_n, n = F.log("n"), F.col("n")
    node = counted.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, n)).alias("pages"),
        F.avg(F.when(F.col("kind") == 1, log_n)).alias("content"),
        F.sum(F.when(F.col("kind") == 2, n)).alias("shown"),
        F.sum(F.when(F.col("kind") == 2, n * log_n)).alias("shown_log"),
    )
    base = F.log("pages")
    content = F.when(F.col("content").isNull(), F.lit(None)).otherwise(1 - F.col("content") / base)
    look = F.when(F.col("shown") > 0, (F.log("shown") - F.col("shown_log") / F.col("shown")) / base)
    share = F.lit(CONTENT_SHARE)
    both = share * content + (1 - share) * F.coalesce(look, F.lit(0.0))
    importance = F.when(F.col("pages") > 1, F.coalesce(both, F.lit(1.0))).otherwise(F.lit(1.0))
    return node.select("host", "path", "pages", importance.alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", recurrent: float = RECURRENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url and text of each page."""
    tree = style_tree(pages, url_col, html_col).where((F.col("pages") >= min_pages) & (F.col("importance") < recurrent))
    # Stored, so that Spark can split the pages of a large host at the join. A host's list has the
    # recurrent ones of its paths, each on min_pages pages at least.
    noise = stored(tree.groupBy("host").agg(F.collect_list(F.struct("path", "importance")).alias("low")), "noise")
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), host_of(pages[url_col]).alias("page_host"), pages[html_col].cast("string").alias("html"))

    joined = rows.join(noise, rows["page_host"] == noise["host"], "left")
    paired = joined.select("page_id", "url", "html", "low")
    read = with_columns(paired, ["html", "low"], lambda html, low: (main_text(html, {x["path"]: x["importance"] for x in low or ()}),), "text string")
    return read.select("page_id", "url", "text")

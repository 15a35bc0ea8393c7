"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged into one tree of styles: a node is a path of tags and classes from the root. Over
the pages that have a node, the entropy of its presentation (the tags and classes of its children, in order) and that of
its content (its own text) say how much it matters; a branch's importance is the mean of its nodes', the farther below,
the less they count. Branches of low importance are removed. What HTML itself calls furniture (nav, footer, form, ...)
goes anyway; a class or id that names furniture counts only where the rest of the page has a text of its own.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import materialise, read, small_batches

#: A branch that at least PAGES distinct pages of a host have is removed below this importance (0 to 1), unless it stands
#: within an article; text elements whose class or id names furniture are removed below SUPPORT.
PAGES, IMPORTANCE, SUPPORT = 5, 0.2, 0.5
#: Entropies are taken to the base of the number of pages, but of BASE at most, so that a node's variety doesn't sink as
#: its host grows. A node counts DECAY times its weight for each level above it, and not beyond REACH levels.
BASE, DECAY, REACH = 16, 0.9, 32
#: Branches (24 bytes each) that a broadcast may hold.
BRANCHES = 500_000

#: Elements of HTML by their kind.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
FURNITURE = {"aside", "audio", "button", "canvas", "datalist", "dialog", "fieldset", "footer", "form", "head", "iframe", "input", "map", "menu", "nav", "noscript", "object", "option", "script", "select", "style", "svg", "template", "textarea", "title", "video"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "menu", "menubar", "navigation", "search"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus",
    "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "related", "reply",
    "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words of a class or id that turn its meaning around or say what else the element is beside.
TURNS = {"no", "not", "has", "with", "without", "is", "show", "hide", "non"}
MAIN = {"article", "main"}
#: Elements that hold text rather than parts of a page.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "dt", "td", "th", "tr", "figcaption", "caption", "address"}
#: Elements that an opening tag of the same kind, or for p of any block, ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "table", "dl", "article", "main", "section", "div", "body", "blockquote", "td", "th"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _named(text: str) -> bool:
    """Whether a class or id names furniture: its first or last word does, and no word turns that around."""
    for token in text.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", token) if x]
        if parts and (parts[0] in NAMES or parts[-1] in NAMES) and not TURNS.intersection(parts):
            return True
    return False


@functools.lru_cache(20_000)
def _style(tag: str, text: str, inside: bool) -> tuple[str, bool, bool, bool]:
    """The node's style; whether HTML calls it furniture (tag, role, hidden); whether its class or id does; whether it is main."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(text)} if text.strip(" /\n\t\r") else {}
    kind = tag + "".join(f".{x}" for x in sorted(set(found.get("class", "").lower().split())))
    role = found.get("role", "").lower()
    furniture = tag in FURNITURE or tag == "header" and not inside
    furniture |= role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
    named = tag not in ("body", "html", *MAIN) and _named(f"{found.get('class', '')} {found.get('id', '')}".lower())
    return kind, furniture, named, tag in MAIN or role == "main"


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(200_000)
def _child(parent: int, kind: str) -> int:
    """The path of a child in the style tree."""
    return _hash(f"{parent}/{kind}")


@dataclass(slots=True)
class Element:
    tag: str
    path: int
    up: tuple[int, ...]  # paths from the root, its own last
    furniture: bool
    named: bool
    main: bool  # is, or stands in, an article or main element
    parent: Element | None
    children: list[str]  # styles of its children and # for text, in order


@dataclass(slots=True)
class Block:
    element: Element
    furniture: bool
    text: str


def parse(html: str | None) -> tuple[list[Element], list[Block]]:
    """The page's elements but for inline ones, and its blocks of text with single blanks, both in page order."""
    html, at = html or "", 0
    root = Element("", 0, (), False, False, False, None, [])
    elements, out = [root], []
    stack: list[tuple[str, Element, bool]] = []  # tag, the element it is or stands in, furniture
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                own = stack[-1][1] if stack else root
                own.children.append("#")
                out.append(Block(own, any(x[2] for x in stack), text))

    while m := TAG.search(html, at):
        if m.start() > at:
            run.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if m[1] or m[4]:
            if any(x[0] == tag for x in stack):
                if tag in INLINE:
                    # An inline element that a block has cut off ends where its block does.
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            if stack[k][2]:
                                flush()
                            del stack[k]
                            break
                        if stack[k][0] not in INLINE:
                            break
                else:
                    while stack.pop()[0] != tag:
                        pass
            continue
        if tag in VOID:
            continue
        ends = ENDS.get(tag, set()) | (set() if tag in INLINE else {"p"})
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ends:
                del stack[k:]
                break
            if stack[k][0] in SCOPES:
                break
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            at = end.start() if end else len(html)
            close = html.find(">", at)
            at = len(html) if close < 0 else close + 1
            continue
        attributes = m[3] if m[2] else m[6]
        above = stack[-1][1] if stack else root
        kind, furniture, named, main = _style(tag, attributes, above.main)
        if tag in INLINE:
            if furniture:
                flush()
            stack.append((tag, above, furniture))
        elif not attributes.rstrip().endswith("/") or tag not in ("path", "use", "circle", "rect"):
            above.children.append(kind)
            path = _child(above.path, kind)
            own = Element(tag, path, (*above.up, path)[-REACH - 1 :], furniture, named, main or above.main, above, [])
            elements.append(own)
            stack.append((tag, own, furniture))
    run.append(unescape(html[at:]))
    flush()
    return elements, out


def _page(html: str | None) -> list[tuple[int, tuple[int, ...], int, int | None, int | None]]:
    """path, up, page, look, content of each node of the page's style tree; furniture included.

    A page is told by its main content: its articles' text or else that of its longest node, so copies of one text under
    different ads or menus are one page. look is null without element children, content without text.
    """
    elements, found = parse(html)
    looks: dict[int, list[str]] = {}
    texts: dict[int, list[str]] = {}
    ups = {}
    for x in elements[1:]:
        ups[x.path] = x.up
        looks.setdefault(x.path, []).append(" ".join(x.children))
    for b in found:
        texts.setdefault(b.element.path, []).append(b.text)
    articles = [b.text for b in found if b.element.main and not b.furniture]
    plain = {b.element.path for b in found if not b.furniture}
    longest = max(("\n".join(texts[p]) for p in plain), key=lambda x: (len(x), x), default="")
    page = _hash("\n".join(articles) or longest)
    return [(path, up, page, _hash("\n".join(looks[path])) if any(x.strip("# ") for x in looks[path]) else None, _hash("\n".join(texts[path])) if path in texts else None) for path, up in ups.items()]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            rows = [(host, *x) for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True) for x in _page(html)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "up", "page", "look", "content"])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, n (distinct pages), look, content, importance of every branch of the hosts' style trees.

    look and content are entropies over the pages that have the node, to the base of their number (BASE at most), 1 for
    one page; null where the node has no element children, or no text. A node's own importance is their mean; a
    branch's that of all its nodes, weighted by their pages and by DECAY for each level.
    """
    small_batches(pages.sparkSession)
    nodes = pages.select("host", "html").mapInArrow(_nodes, "host string, path long, up array<long>, page long, look long, content long")
    nodes = materialise(nodes.groupBy("host", "path", "page", "look", "content").agg(F.any_value("up").alias("up")), "nodes")
    node = ["host", "path"]

    def entropy(of: str) -> DataFrame:
        each = nodes.where(F.col(of).isNotNull()).groupBy(*node, of).agg(F.count("*").cast("double").alias("k"))
        total = each.groupBy(*node).agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.log("k")).alias("s"))
        h = (F.log("m") - F.col("s") / F.col("m")) / F.log(F.least("m", F.lit(float(BASE))))
        return total.select(*node, F.when(F.col("m") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), h))).otherwise(1.0).alias(of))

    n = nodes.groupBy(*node, "page").agg(F.count("*").alias("rows"), F.any_value("up").alias("up")).groupBy(*node).agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.any_value("up").alias("up"))
    own = n.join(entropy("look"), node, "left").join(entropy("content"), node, "left")
    mean = F.when(F.col("look").isNull(), F.col("content")).when(F.col("content").isNull(), F.col("look")).otherwise((F.col("look") + F.col("content")) / 2)
    own = materialise(own.withColumn("own", mean), "tree")
    # Each node's weight goes to the branches that hold it; the nearest is the last of `up`.
    spread = own.where(F.col("own").isNotNull()).select("host", "own", "rows", F.size("up").alias("depth"), F.posexplode("up").alias("at", "path"))
    weight = F.col("rows") * F.pow(F.lit(DECAY), F.col("depth") - 1 - F.col("at"))
    branch = spread.groupBy(*node).agg((F.sum(weight * F.col("own")) / F.sum(weight)).alias("importance"))
    return own.join(branch, node).select(*node, "n", "look", "content", "importance")


def main_text(html: str | None, low: set[int], weak: set[int] = frozenset()) -> str:
    """The page's blocks without furniture and, outside articles, branches in low, joined by a blank.

    Branches whose class or id names furniture go where any other text is left; of elements that hold text, only those
    in weak. If articles hold half of what is left, or more, only they are kept.
    """
    kept, elsewhere = [], []
    drops: dict[int, tuple[bool, bool]] = {}

    def of(x: Element | None) -> tuple[bool, bool]:
        """Whether the element goes for its importance, and whether a name says so."""
        if x is None:
            return False, False
        if (known := drops.get(id(x))) is None:
            above = of(x.parent)
            here = x.named and (x.tag not in TEXTUAL or x.path in weak)
            known = drops[id(x)] = above[0] or x.path in low and not x.main, above[1] or here
        return known

    elements, blocks = parse(html)
    for x in elements:  # parents first, so that deep pages need no deep recursion
        of(x)
    for b in blocks:
        gone, named = of(b.element)
        if not b.furniture and not gone:
            (elsewhere if named else kept).append(b)
    if not kept:
        kept = elsewhere
    within = [b for b in kept if b.element.main]
    if 2 * sum(len(b.text) for b in within) >= sum(len(b.text) for b in kept):
        kept = within or kept
    return " ".join(b.text for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """pages with text: the main text of html, empty if there is none.

    Pages without a host (null or odd urls) count as one host. Null and empty html give an empty text; repeated pages
    count once in the style tree and get the same text; very long and deep pages are read whole; an empty table gives an
    empty one. A column named text is replaced; names that begin with two underscores are not for pages.
    """
    small_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    kept = [c for c in pages.columns if c != "text"]
    own = pages.select(*kept, host.alias("__host"))
    tree = style_tree(own.select(F.col("__host").alias("host"), "html"))
    few = materialise(tree.where((F.col("n") >= PAGES) & (F.col("importance") < SUPPORT)).select(F.col("host").alias("__host"), "path", (F.col("importance") < IMPORTANCE).alias("low")), "low")
    sets = few.groupBy("__host").agg(F.collect_list(F.when(F.col("low"), F.col("path"))).alias("__low"), F.collect_list("path").alias("__weak"))
    joined = own.join(F.broadcast(sets) if few.limit(BRANCHES + 1).count() <= BRANCHES else sets, "__host", "left")

    @F.pandas_udf("string")
    def text(html: pd.Series, low: pd.Series, weak: pd.Series) -> pd.Series:
        given = lambda x: frozenset() if x is None else frozenset(x.tolist())
        return pd.Series([main_text(h, given(x), given(y)) for h, x, y in zip(html, low, weak, strict=True)], dtype=object)

    return joined.withColumn("text", text("html", "__low", "__weak")).select(*kept, "text")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))

"""Main-text extraction with a site style tree.

The DOM trees of a host's pages are merged: elements with the same path of tags
and classes are one node of the tree. The entropy of a node's child
presentations over the host's pages says how much its layout varies; the
entropy of a block of text at a node says how widely it is repeated. On a page,
the importance of a block is one less that entropy, and the importance of an
element is composed of its node's layout entropy and of the importance of its
children. From the top down, branches of low importance are removed, inside an
article as well, where the bound is lower.

Elements whose tag, class or role names them as page furniture are presentation
nodes of importance 0 from the start: menus, adverts and comments whose text
differs from page to page are no repetition, so no entropy can tell them.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, cut_counting, emit, in_arrow, limited, small

# Element names and words of classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
FURNITURE = frozenset("nav footer aside form button select input menu dialog head fieldset datalist".split())
CLOSED_BY = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside blockquote body dd div dl fieldset footer form header html li main nav ol section table td th ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog".split())
WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager topbar toolbar skip
    footer colophon copyright sidebar aside widget widgets related recommended recommendations trending popular
    cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription paywall
    comment comments commentlist disqus respond reply replies discussion login signup register search form
    share sharing social follow""".split()
)
OUTER_WORDS = frozenset("header masthead".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
READ = frozenset("class id role hidden aria-hidden".split())
WORD = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Params:
    #: Branches of at most this importance are removed; inside an article, of at most the second.
    importance: float = 0.3
    inside: float = 0.15
    attenuation: float = 0.9
    #: Pages that a host is taken to have beside those seen.
    unseen: int = 2
    #: Pages with repeated blocks whose lists are broadcast at most; more are joined by shuffle.
    broadcast_pages: int = 50_000
    #: And rows of a broadcast table of values at most (24 bytes each).
    broadcast_rows: int = 300_000


@dataclass(slots=True)
class Element:
    tag: str
    path: int
    parent: int
    main: bool
    dropped: bool
    style: int = 0
    texts: int = 0  # code points of text in it
    children: int = 0  # elements and blocks in it that hold text
    sum: float = 0.0  # of their importance


def parse(html: str) -> tuple[list[Element], list[tuple[int, str]]]:
    """Elements of a page and its blocks of text, each with the element that holds it."""
    elements = [Element("", 0, -1, False, False)]
    # open elements, those of them that aren't inline, how many of each name, and those that a main element or an article makes part of the article
    stack, outer, count, named_open, forms_open = [0], [0], Counter(), [], []
    blocks, buffer, end_of = [], [], {}

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                blocks.append((outer[-1], text))
            buffer.clear()

    def close(depth: int) -> None:
        for i in reversed(stack[depth:]):
            count[elements[i].tag] -= 1
            for kept in (outer, named_open, forms_open):
                if kept and kept[-1] == i:
                    kept.pop()
        del stack[depth:]

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                buffer.append(piece)
            continue
        tag = tag.lower()
        if m[1]:
            if count[tag]:
                depth = len(stack) - 1
                while elements[stack[depth]].tag != tag:
                    depth -= 1
                if outer[-1] >= stack[depth]:
                    flush()
                close(depth)
            continue
        if tag in RAW:
            ending = end_of.get(tag) or end_of.setdefault(tag, re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I))
            if not m[3].rstrip().endswith("/"):
                found = ending.search(html, at)
                at = found.end() if found else n
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        ends = CLOSED_BY.get(tag, set()) | (set() if tag in INLINE else {"p"})
        if any(count[x] for x in ends):
            for i in reversed(outer):
                have = elements[i].tag
                if have in ends:
                    close(bisect_left(stack, i))
                    break
                if have not in CLOSED_BY or have in SCOPE:
                    break
        words, named, hidden = set(), "", False
        if tag in ("main", "article"):
            # what holds the main element isn't dropped for its name, nor a form that holds an article
            for held in (forms_open, named_open) if tag == "main" else (forms_open,):
                for i in held:
                    elements[i].dropped = False
                held.clear()
        for name, value in ATTRIBUTE.findall(m[3]) if m[3] else ():
            name = name.lower()
            if name not in READ:
                continue
            value = value.strip("\"'").lower()
            if name == "role":
                hidden |= value in ROLES
            elif name == "hidden" or name == "aria-hidden":
                hidden |= name == "hidden" or value == "true"
            else:
                words.update(WORD.findall(value))
                named += f".{value}" if name == "class" else ""
        up = elements[stack[-1]]
        always = hidden or tag in FURNITURE and tag != "form"
        furniture = always or tag == "form" or not words.isdisjoint(WORDS) or (not up.main and (tag == "header" or not words.isdisjoint(OUTER_WORDS)))
        label = f"{tag}{named}"
        up.style = xxhash.xxh64_intdigest(label, up.style)
        main = up.main or tag in ("article", "main") or "itemprop" in m[3] and "articleBody" in m[3]
        # body and html hold the article, whatever their class says
        dropped = (always if tag == "main" else furniture) and tag not in ("html", "body")
        i = len(elements)
        elements.append(Element(tag, xxhash.xxh64_intdigest(label, up.path), stack[-1], main, dropped))
        if m[3].endswith("/") and tag not in INLINE and tag not in SCOPE:
            continue
        stack.append(i)
        count[tag] += 1
        if tag not in INLINE:
            outer.append(i)
        if dropped and not always:
            (forms_open if tag == "form" else named_open).append(i)
    flush()
    return elements, blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@dataclass(slots=True)
class Page:
    """A page's elements and blocks outside its furniture."""

    elements: list[Element]
    blocks: list[tuple[int, str]]
    keys: list[int]  # of each block, by its host, node and text
    sign: int  # the page by its blocks: copies of a page have the same


def node_key(host: str, node: int) -> int:
    return _signed(xxhash.xxh64_intdigest(f"{host}\x00{node}"))


def read(html: str, host: str) -> Page:
    elements, blocks = parse(html)
    for e in elements[1:]:
        e.dropped |= elements[e.parent].dropped
    blocks = [(at, t) for at, t in blocks if not elements[at].dropped]
    keys = [_signed(xxhash.xxh64_intdigest(f"{host}\x00{elements[at].path}\x00{t}")) for at, t in blocks]
    for at, t in blocks:
        elements[at].texts += len(t)
        elements[at].children += 1
    for e in reversed(elements[1:]):
        if e.texts:
            elements[e.parent].texts += e.texts
            elements[e.parent].children += 1
    return Page(elements, blocks, keys, _signed(xxhash.xxh64_intdigest(" ".join(map(str, sorted(xxhash.xxh64_intdigest(t) for _, t in blocks))))))


def main_text(html: str, low: dict[int, tuple[float, float]], host: str, p: Params = Params()) -> str:
    """Blocks that stand in no furniture and no branch of low importance; if any stand in an article or main element, those alone.

    ``low`` has the importance of repeated blocks, as (importance, 0), and of
    nodes with several layouts, as (layout entropy, weight of the layout).
    """
    page = read(html, host)
    elements, gone = page.elements, [False] * len(page.elements)
    value = [low.get(k, (1.0, 0.0))[0] for k in page.keys]
    if any(v < 1 for v in value):
        for (at, _), v in zip(page.blocks, value, strict=True):
            elements[at].sum += v
        importance = [1.0] * len(elements)
        for i in range(len(elements) - 1, 0, -1):  # children come after their parents
            e = elements[i]
            if e.texts:
                spread, weight = low.get(node_key(host, e.path), (0.0, 0.0))
                importance[i] = weight * spread + (1 - weight) * e.sum / e.children
                elements[e.parent].sum += importance[i]
        bound = lambda e: p.inside if e.main else p.importance
        for i, e in enumerate(elements[1:], 1):
            # a branch with most of the page's text is judged by its children
            gone[i] = gone[e.parent] or 0 < e.texts <= elements[0].texts / 2 and importance[i] <= bound(e)
    kept = [(at, t) for (at, t), v in zip(page.blocks, value, strict=True) if not gone[at] and (v == 1 or v > bound(elements[at]))]
    kept = kept or page.blocks  # a page isn't furniture alone
    inside = [t for at, t in kept if elements[at].main]
    return "\n\n".join(inside or [t for _, t in kept])


NODES = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("node", pa.int64()), ("feature", pa.int64()), ("style", pa.int64()), ("sign", pa.int64())])
NODES_DDL = "p1 long, p2 long, node long, feature long, style long, sign long"
TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's elements with text (node and style), and its blocks (node and feature; style null)."""
    for b in small(batches, "html"):
        rows: list[tuple] = []
        for p1, p2, host, html in zip(*(b.column(c).to_pylist() for c in ("p1", "p2", "host", "html")), strict=True):
            page = read(html or "", host)
            nodes = {(node_key(host, e.path), None, _signed(e.style)) for e in page.elements[1:] if e.texts}
            nodes |= {(node_key(host, page.elements[at].path), k, None) for (at, _), k in zip(page.blocks, page.keys, strict=True)}
            rows += [(p1, p2, *x, page.sign) for x in nodes]
        if rows:
            yield from emit(NODES, dict(zip(NODES.names, zip(*rows, strict=True), strict=True)))


def _extract(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    for b in small(batches, "html"):
        text = []
        for html, low, host in zip(*(b.column(c).to_pylist() for c in ("html", "low", "host")), strict=True):
            text.append(main_text(html or "", {x["key"]: (x["value"], x["weight"]) for x in low or ()}, host, p))
        yield from emit(TEXT, {"page_id": b.column("page_id"), "url": b.column("url"), "text": text, "n_chars": [len(t) for t in text]})


def low_values(nodes: DataFrame, p: Params = Params()) -> DataFrame:
    """key, value, weight: importance of each block that is repeated over its host, and layout entropy of nodes with several layouts.

    Pages with the same blocks are one page. All are summed on the key before
    they meet, so a hot host is no hot task.
    """
    styles = nodes.where("style is not null").select("node", "style", "sign").distinct().groupBy("node", "style").agg(F.count("*").alias("n"))
    known = styles.groupBy("node").agg(F.sum("n").alias("pages"), F.count("*").alias("styles"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    spread = F.log("pages") - F.col("nlogn") / F.col("pages")
    layouts = known.where("styles > 1").select(F.col("node").alias("key"), (spread / F.log("pages")).alias("value"), (1 - F.pow(F.lit(p.attenuation), F.col("styles"))).alias("weight"))
    often = nodes.where("feature is not null").select("node", "feature", "sign").distinct().groupBy("node", "feature").agg(F.count("*").alias("n")).where("n > 1")
    seen = F.log(F.col("pages") + p.unseen)
    blocks = often.join(known.select("node", "pages"), "node").select(F.col("feature").alias("key"), F.greatest(1 - F.log("n") / seen, F.lit(0.0)).alias("value"), F.lit(0.0).alias("weight"))
    return blocks.unionByName(layouts)


def extract(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """page_id, url, text, n_chars of each row (columns page_id, url and html; others are ignored).

    A null or empty html gives an empty text; a null url counts as a host of
    its own kind, the empty one. Pages with the same blocks are one page to the
    site's statistics, so that copies of an article don't make it furniture;
    each row, repeated or not, gets its text. Text that is cut off or badly
    nested is read as far as it goes, in time that grows with its length alone,
    however deep or long it is; an importance equal to the bound is low. An
    empty table gives an empty result. A page gets back the values of its own
    blocks and elements only, and none if no block of it is repeated widely.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"\A[^:/?#]*://([^/?#]*)", 1)), F.lit(""))
    keyed = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("p1"), F.xxhash64(F.lit(7), "html", "url", "page_id").alias("p2"))
    nodes = cut(in_arrow(keyed.select("p1", "p2", "host", "html"), _nodes, NODES_DDL))
    low, n = cut_counting(low_values(nodes, p))
    low = limited(low, n, p.broadcast_rows)
    named = nodes.select("p1", "p2", F.coalesce("feature", "node").alias("key")).distinct()
    value = F.struct("key", "value", "weight")
    found = named.join(low, "key").groupBy("p1", "p2").agg(F.collect_list(value).alias("low"), F.min(F.when(F.col("weight") == 0, F.col("value"))).alias("least")).where(F.col("least") <= p.importance).drop("least")
    found, n = cut_counting(found)
    return in_arrow(keyed.join(limited(found, n, p.broadcast_pages), ["p1", "p2"], "left").select("page_id", "url", "html", "host", "low"), lambda it: _extract(it, p), "page_id long, url string, text string, n_chars long")

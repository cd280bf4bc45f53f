"""Main text of web pages by removal of site templates.

Every element's subtree is hashed. Spark counts on how many pages of a host each hash occurs;
subtrees that recur across many of them are the site's own furniture and are deleted before the
visible text is taken.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut
from .reputation import host

#: A subtree is template if it is on at least this many pages of its host ...
MIN_PAGES = 4
#: ... and on this share of them; 0, as a page's text must not depend on how many other pages its host has.
MIN_SHARE = 0
#: Templates are sent to all executors up to this many rows; beyond, each page is joined to its own.
BROADCAST_ROWS = 100_000
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>?", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg"))
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_HIDDEN = frozenset("script style noscript template iframe svg title head".split())
_BLOCK = frozenset("address article aside blockquote br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul".split())
_ENDS_P = _BLOCK - {"br"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ROOTS = frozenset(("html", "head", "body"))
_WHITE = re.compile(r"\s+")
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")


def elements(page: str) -> list[tuple[str, int, int, int]]:
    """Tag, start, end and subtree hash of each element, in the order of their ends.

    The tree is that of the source with the usual implied ends: blocks end an open p, list items,
    cells and rows end their like, a closing tag ends whatever is open inside its element, and the
    end of the text ends everything. Closing tags without an opening one are ignored. A hash is that
    of the element's own tags and text (white space made single) and of its children's hashes, each in
    its place, so that a page takes time in proportion to its length however deep it nests.
    """
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[str, int, list[str]]] = []
    open_: Counter[str] = Counter()
    at, find = 0, _TOKEN.search

    def text(upto: int) -> None:
        if stack and upto > at:
            stack[-1][2].append(_WHITE.sub(" ", page[at:upto]))

    def end(stop: int, tag: str = "") -> str:
        name, start, parts = stack.pop()
        open_[name] -= 1
        h = xxhash.xxh3_64_intdigest("\0".join(parts) + tag) - 2**63
        out.append((name, start, stop, h))
        if stack:
            stack[-1][2].append(f"\1{h}")
        return name

    while m := find(page, at):
        text(m.start())
        at, tag = m.end(), m[2]
        if not tag:
            if stack:
                stack[-1][2].append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if open_[tag]:
                while stack[-1][0] != tag:
                    end(m.start())
                end(at, _WHITE.sub(" ", m[0]))
            elif stack:
                stack[-1][2].append(m[0])
            continue
        if tag in _ENDS_P and open_["p"]:
            while end(m.start()) != "p":
                pass
        if tag in _SIBLING:
            while stack and stack[-1][0] in _SIBLING[tag]:
                end(m.start())
        shown = _WHITE.sub(" ", m[0])
        if tag in _VOID or m[0].endswith("/>"):
            if stack:
                stack[-1][2].append(shown)
            continue
        stack.append((tag, m.start(), [shown]))
        open_[tag] += 1
        if tag in _RAW:
            e = _RAW_END[tag].search(page, at)
            begin, at = at, e.end() if e else len(page)
            stack[-1][2].append(_WHITE.sub(" ", page[begin:at]))
            end(at)
    text(len(page))
    while stack:
        end(len(page))
    return out


def subtree_hashes(page: str) -> list[tuple[int, int, int]]:
    """Hash, start and end of each element but html, head and body."""
    return [(h, s, e) for t, s, e, h in elements(page) if t not in _ROOTS and e > s]


def visible_text(page: str, removed: list[tuple[int, int]] = ()) -> str:
    """Text outside the removed spans and of no hidden element; one line for each block, none blank."""
    out, at, skip, k = [], 0, -1, 0
    spans = sorted(removed)
    merged: list[list[int]] = []
    for s, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e])
    pieces, begin = [], 0
    for s, e in merged:
        pieces.append(page[begin:s])
        begin = e
    pieces.append(page[begin:])
    page = "\n<br>\n".join(pieces) if merged else page
    hidden = 0
    while m := _TOKEN.search(page, at):
        if not hidden:
            out.append(page[at : m.start()].replace("\n", " "))
        at, tag = m.end(), (m[2] or "").lower()
        if tag in _BLOCK:
            out.append("\n")
        if tag == "head":
            hidden = 0 if m[1] else 1
        elif tag == "body":
            hidden = 0
        elif tag in _HIDDEN and not m[1] and not m[0].endswith("/>") and tag in _RAW:
            e = _RAW_END[tag].search(page, at)
            at = e.end() if e else len(page)
    if not hidden:
        out.append(page[at:].replace("\n", " "))
    text = entities.unescape("".join(out))
    lines = (_SPACES.sub(" ", x).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            rows, values = [], []
            for i, page in enumerate(part.column(2).to_pylist()):
                own = {h for h, _, _ in subtree_hashes(page)} if page else set()
                rows += [i] * len(own)
                values += own
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(values, pa.int64())], ["host", "page", "hash"])


def _page_key() -> Column:
    return F.xxhash64("url", "html")


def page_subtrees(pages: DataFrame) -> DataFrame:
    """``host, page, hash``: each subtree of each page once; copies of a page may repeat."""
    own = pages.select(host(F.col("url").cast("string")).alias("host"), _page_key().alias("page"), F.col("html").cast("string").alias("html")).where("html is not null")
    return own.mapInArrow(_hash_batches, "host string, page long, hash long")


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, hash, n``: the subtrees on at least ``min_pages`` pages and ``min_share`` of the pages of a host.

    A page is a distinct url and source; copies of one row count once. Pages without a host share ''.
    """
    n = page_subtrees(pages).distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    if not min_share:
        return n
    own = pages.where("html is not null").select(host(F.col("url").cast("string")).alias("host"), _page_key().alias("page"))
    total = own.groupBy("host").agg(F.count_distinct("page").alias("total"))
    return n.join(total, "host").where(F.col("n") >= F.ceil(F.col("total") * min_share)).select("host", "hash", "n")


def _strip(frame: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    for b in frame:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            texts, gone = [], []
            given = part.column(3).to_pylist() if shared is None else [shared.get(h, ()) for h in part.column(1).to_pylist()]
            for page, own in zip(part.column(2).to_pylist(), given, strict=True):
                if page is None:
                    texts.append(None)
                    gone.append(0)
                    continue
                own = own if shared is not None else set(own or ())
                spans = [(s, e) for h, s, e in subtree_hashes(page) if h in own] if own else []
                texts.append(visible_text(page, spans))
                gone.append(len(spans))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(np.array(gone, np.int32))], ["page_id", "host", "text", "n_removed"])


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id, host, text, n_removed`` for every row of ``pages`` (page_id, url, html).

    Null html gives a null text, an empty or wholly templated page ''. Repeated rows each give a
    row. Broken markup never fails: an unended tag or comment runs to the end. Very long and deeply
    nested pages are parsed whole. Other columns are ignored; an empty table gives an empty one.

    Up to ``broadcast_rows`` templates go to all executors. More are joined with the subtrees of the
    pages, so that a page is sent the templates it has and not those of its host.
    """
    found = cut(site_templates(pages, min_pages, min_share))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"), _page_key().alias("page"))
    out = "page_id long, host string, text string, n_removed int"
    if found.count() <= broadcast_rows:
        sets: dict[str, set[int]] = {}
        for r in found.select("host", "hash").toLocalIterator():
            sets.setdefault(r[0], set()).add(r[1])
        shared = pages.sparkSession.sparkContext.broadcast(sets)
        return own.drop("page").mapInArrow(lambda batches: _strip(batches, shared.value), out)
    has = page_subtrees(pages).join(found.select("host", "hash"), ["host", "hash"], "left_semi")
    per_page = has.groupBy("page").agg(F.collect_set("hash").alias("hashes"))
    joined = own.join(per_page, "page", "left").select("page_id", "host", "html", "hashes")
    return joined.mapInArrow(lambda batches: _strip(batches, None), out)

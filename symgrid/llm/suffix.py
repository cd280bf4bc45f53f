"""Passages that repeat across documents, by suffix arrays of shards.

Equal passages must meet in one shard wherever their documents lie. Every document is winnowed:
of the hashes of its 12-word grams the least of every 39 consecutive ones is an anchor, so any two
copies of a passage of 50 words have an anchor in common, and with it at least 19 words to its left
or to its right. Anchors that share neither with another document are dropped; around the others, all
stretches of 50 words whose least gram is the anchor go to the anchor's shard.
A shard's text is sorted by external induced sorting (``esais``), its common prefixes of 50 words or
more give the repeats, and what the shards found in a document is merged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, shared_dir, written
from .esais import Scratch, suffix_array

MIN_WORDS = 50
GRAM = 12
#: Queue entries a task holds in memory. Text, pass outputs and range minima of a shard are in files beyond
#: four times that; its other arrays stay in memory and grow with the shard (README, known limits).
ENTRIES = 1 << 20
_WORD = re.compile(r"\w+")


def word_hashes(text: str) -> np.ndarray:
    """32-bit hashes of the lower-cased words."""
    return np.fromiter(map(xxhash.xxh32_intdigest, _WORD.findall(text.lower())), np.uint32)


def _grams(words: np.ndarray, at: np.ndarray | None, n: int) -> np.ndarray:
    """64-bit hashes of the ``n`` words from each place of ``at``, or from every place."""
    h = np.zeros(len(words) - n + 1 if at is None else len(at), np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (words[k : k + len(h)] if at is None else words[at + k]).astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


_PLACE = np.uint64((1 << 24) - 1)


def anchors(words: np.ndarray, min_words: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Hashes and places of the anchors, hashes of what lies to their left and right, and their reach.

    Every ``min_words`` consecutive words hold an anchor whole. Of such a stretch at least half of
    what is not the anchor is on one side of it; the other hashes are those of the anchor with that
    much to its left and right, 0 where the text ends before. The reach tells which stretches have the
    anchor as their least gram: how far before it the first begins, and (times 1 << 15) how many follow.
    """
    n, span = len(words) - gram + 1, min_words - gram + 1
    if len(words) < min_words:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    h = _grams(words, None, gram)
    found, step = [], 1 << 22
    for s in range(0, n - span + 1, step):
        own = h[s : s + step + span - 1]
        low, width = own & ~_PLACE | np.arange(len(own), dtype=np.uint64), 1
        size = len(own) - span + 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:size], low[span - width : span - width + size])
        found.append(((low & _PLACE) + np.uint64(s)).astype(np.int64))
    least = found[0] if len(found) == 1 else np.concatenate(found)  # of each stretch; it never moves back
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    place, many = least[first], np.diff(np.append(first, len(least))) - 1
    # a run of one word has one gram throughout; one anchor for each stretch is enough there, with all that hold it
    if len(place) > 2:
        same = (np.diff(place) == 1) & (h[place[1:]] == h[place[:-1]])
        start, last = np.append(True, ~same), np.append(~same, True)
        run = ~(start & last)
        first = np.where(run, np.maximum(place - span + 1, 0), first)
        many = np.where(run, np.minimum(place, len(words) - min_words) - first, many)
        begin = np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))
        on = ((np.arange(len(place)) - begin) % span == 0) | last
        place, first, many = place[on], first[on], many[on]
    half = (min_words - gram + 1) // 2
    left, right = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
    on = place >= half
    left[on] = _grams(words, place[on] - half, half + gram) | np.uint64(1)
    on = place + gram + half <= len(words)
    right[on] = _grams(words, place[on], half + gram) | np.uint64(1)
    return h[place].view(np.int64), place, left.view(np.int64), right.view(np.int64), place - first | many << 15


def _anchor_batches(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                rows, ns = [], []
                found = [anchors(np.zeros(0, np.uint32))]
                for i, t in enumerate(part.column(2).to_pylist()):
                    w = word_hashes(t)
                    found.append(anchors(w, min_words))
                    rows += [i] * len(found[-1][0])
                    ns += [len(w)] * len(found[-1][0])
                take = pa.array(rows, pa.int32())
                h, p, x, y, r = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(h), part.column(0).take(take), part.column(1).take(take), pa.array(p.astype(np.int32)), pa.array(ns, pa.int32()), pa.array(x), pa.array(y), pa.array(r.astype(np.int32))], ["hash", "id", "xk", "place", "n", "l", "r", "reach"])

    return run


def _side_shared(h: np.ndarray, side: np.ndarray, xk: np.ndarray, place: np.ndarray, within: bool) -> np.ndarray:
    """Rows whose gram on one side is in more than one text, or with ``within`` at more than one place."""
    if not within:
        order = np.lexsort((side, h))
        hs, ss, xs = h[order], side[order], xk[order]
        begin = np.append(0, np.flatnonzero((hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])) + 1)
        shared = np.minimum.reduceat(xs, begin) != np.maximum.reduceat(xs, begin)
    else:
        order = np.lexsort((place, xk, side, h))
        hs, ss, xs, ps = h[order], side[order], xk[order], place[order]
        same = (hs[1:] == hs[:-1]) & (ss[1:] == ss[:-1])
        begin = np.append(0, np.flatnonzero(~same) + 1)
        other = np.append(False, same & ((xs[1:] != xs[:-1]) | (ps[1:] != ps[:-1])))
        shared = np.logical_or.reduceat(other, begin)
    out = np.empty(len(h), bool)
    out[order] = np.repeat(shared, np.diff(np.append(begin, len(h))))
    return out & (side != 0)


def _shared_batches(within: bool):
    """Rows sorted by hash; those stay that share the gram on one side at least with another text (or place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if rest and (last or rest[-1][0][-1] != cols[0][0]):  # else one hash goes on through the batch
                yield from work([np.concatenate(z) for z in zip(*rest, [c[:last] for c in cols], strict=True)])
                rest = []
            elif last:
                yield from work([c[:last] for c in cols])
            rest.append([c[last:].copy() for c in cols])
        if rest:
            yield from work([np.concatenate(z) for z in zip(*rest, strict=True)])

    def work(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, xk, place, x, y, reach = cols
        left, right = _side_shared(h, x, xk, place, within), _side_shared(h, y, xk, place, within)
        on = left | right
        if on.any():
            sides = left.astype(np.int32) + 2 * right.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h[on]), pa.array(xk[on]), pa.array(place[on]), pa.array(sides[on]), pa.array(reach[on])], ["hash", "xk", "place", "sides", "reach"])

    return run


def _segment_batches(shards: int, min_words: int):
    """Of each document, the stretches around its shared anchors, by the shard of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                shard, node, start, ends, words = [], [], [], [0], [np.zeros(0, np.uint32)]
                for i in range(part.num_rows):
                    w = word_hashes(part.column(1)[i].as_py())
                    h, p, sides, reach = (part.column(k)[i].values.to_numpy() for k in (2, 3, 4, 5))
                    own = h % shards
                    # only stretches that reach as far as what is shared on a side
                    half = (min_words - GRAM + 1) // 2
                    far = lambda on: np.where(on, min_words - GRAM, half - 1)
                    p = p.astype(np.int64)
                    first = p - (reach & 0x7FFF)
                    a, z = np.maximum(p - far(sides & 1), first), np.minimum(p + GRAM + far(sides & 2), first + (reach >> 15) + min_words)
                    on = z - a >= min_words
                    order = np.flatnonzero(on)[np.lexsort((a[on], own[on]))]
                    if not len(order):
                        continue
                    own, p, a, z = own[order], p[order], a[order], z[order]
                    top = np.maximum.accumulate(z + own * (1 << 40)) - own * (1 << 40)
                    new = np.append(True, (own[1:] != own[:-1]) | (a[1:] > top[:-1]))
                    at = np.flatnonzero(new)
                    for x, y in zip(at, np.append(at[1:], len(p)) - 1):
                        shard.append(int(own[x]))
                        low = int(a[x : y + 1].min())
                        start.append(low)
                        words.append(w[low : top[y]])
                        ends.append(ends[-1] + len(words[-1]))
                    node += [i] * len(at)
                values = pa.array(np.concatenate(words).view(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), part.column(0).take(pa.array(node, pa.int32())), pa.array(start, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["shard", "node", "start", "words"])

    return run


def shard_repeats(text: np.ndarray, begin: np.ndarray, node: np.ndarray, start: np.ndarray, folder: str, entries: int, min_words: int = MIN_WORDS, within: bool = False) -> tuple[np.ndarray, ...]:
    """Repeats across the documents of one shard (or also within one): node, first word, end, least node with the passage.

    Segment ``k`` is ``text[begin[k]:begin[k+1]]``, words ``start[k]`` and on of document ``node[k]``.
    """
    m = len(begin) - 1
    scratch = Scratch(folder, entries)
    try:
        chunk = 1 << 20
        kinds = np.zeros(0, text.dtype)
        for s in range(0, len(text), chunk):
            kinds = np.union1d(kinds, text[s : s + chunk])
        # each segment ends with a symbol of its own, all below the words; the last is the least
        t = scratch.array(len(text) + m, np.int32)
        shift = np.arange(m)
        ends = begin[1:] + shift
        t[ends] = shift[::-1]
        for s in range(0, len(text), chunk):
            e = min(s + chunk, len(text))
            at = np.arange(s, e) + np.searchsorted(begin, np.arange(s, e), "right") - 1
            t[at] = np.searchsorted(kinds, text[s:e]) + m
        sa, lcp = suffix_array(t, scratch, cap=min_words)
        long = lcp >= min_words
        edge = np.flatnonzero(long & ~np.append(False, long[:-1])) - 1  # first of each group
        stop = np.flatnonzero(long & ~np.append(long[1:], False)) + 1
        empty = np.zeros(0, np.int64)
        if not len(edge):
            return empty, empty, empty, empty
        size = stop - edge
        row = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edge, size)
        place = sa[row]
        seg = np.searchsorted(ends, place)
        own = node[seg]
        word = start[seg] + place - np.where(seg > 0, ends[np.maximum(seg, 1) - 1] + 1, 0)
        groups = np.cumsum(size) - size
        low, high = np.minimum.reduceat(own, groups), np.maximum.reduceat(own, groups)
        on = np.repeat((low != high) | within, size)
        own, word, first = own[on], word[on], np.repeat(low, size)[on]
        if not len(own):
            return empty, empty, empty, empty
        order = np.lexsort((word, own))
        own, word, first = own[order], word[order], first[order]
        new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (word[1:] > word[:-1] + min_words)))
        last = np.append(new[1:], len(own)) - 1
        return own[new], word[new], word[last] + min_words, np.minimum.reduceat(first, new)
    finally:
        scratch.close()


def _shard_batches(folder: str, entries: int, min_words: int, within: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spool = None, None
        for b in batches:
            own = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if now != int(own[s]):
                    if spool is not None:
                        yield from finish(spool)
                    now, spool = int(own[s]), Spool(folder, entries)
                spool.add(b.slice(s, e - s))
        if spool is not None:
            yield from finish(spool)

    def finish(spool: Spool) -> Iterator[pa.RecordBatch]:
        try:
            found = shard_repeats(*spool.arrays(), folder, entries, min_words, within)
        finally:
            spool.close()
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "start", "stop", "first"])

    return run


class Spool:
    """A shard's segments as they come: in memory up to a size, then in a file."""

    def __init__(self, folder: str, entries: int):
        self.scratch, self.entries, self.held, self.file = Scratch(folder, entries), entries * 4, 0, None
        self.words: list[np.ndarray] = []
        self.length: list[np.ndarray] = []
        self.node: list[np.ndarray] = []
        self.start: list[np.ndarray] = []

    def add(self, b: pa.RecordBatch) -> None:
        lists = b.column(3)
        self.words.append(lists.flatten().to_numpy().copy())
        self.length.append(np.diff(lists.offsets.to_numpy()))
        self.node.append(b.column(1).to_numpy().copy())
        self.start.append(b.column(2).to_numpy().astype(np.int64))
        self.held += len(self.words[-1])
        if self.held > self.entries:
            self.file = self.file or self.scratch.path()
            with open(self.file, "ab") as f:
                for w in self.words:
                    w.tofile(f)
            self.words, self.held = [], 0

    def arrays(self) -> tuple[np.ndarray, ...]:
        if self.file:
            with open(self.file, "ab") as f:
                for w in self.words:
                    w.tofile(f)
            text = np.memmap(self.file, np.int32, "r")
        else:
            text = np.concatenate(self.words)
        return text, np.append(0, np.cumsum(np.concatenate(self.length))), np.concatenate(self.node), np.concatenate(self.start)

    def close(self) -> None:
        self.scratch.close()


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, entries: int = ENTRIES, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """``doc_id, start_word, n_words, first_doc_id``: each stretch of a document that other documents have, too.

    Every stretch is a union of passages of at least ``min_words`` words, each of which occurs in
    another document; ``first_doc_id`` is the least id that has one of them, and where it is the
    document itself the stretch is a first occurrence. With ``within``, passages count as well that
    occur twice in one document, at places that may overlap. Words are runs of letters, digits and
    underscores, compared in lower case, counted from 0. Texts that are equal as a whole are one
    for the sorting, and each of theirs is reported from its first to its last word. Texts of fewer
    words, null and empty texts and rows without an id give nothing; repeated rows of one id and text
    are one document. Very long texts are searched whole. Two texts under one id are one document, whose
    stretches are reported together. Other columns are ignored; an empty table gives no rows.

    There are as many shards as keep the text of each within what a task sorts in memory, unless one
    passage alone is longer; ``spark.checkpoint.dir`` must be a folder that executors can open as files.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if not GRAM < min_words < 1 << 15:
        raise ValueError(f"passages have more than {GRAM} and under {1 << 15} words, not {min_words}")
    folder = re.sub(r"^file:/*", "/", shared_dir(spark))
    if "://" in folder:
        raise ValueError(f"suffix arrays need a shared folder that is mounted, not {folder}")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("xk"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    found = written(own.mapInArrow(_anchor_batches(min_words), "hash long, id long, xk long, place int, n int, l long, r long, reach int"), "anchors")
    texts = cut(found.groupBy("xk").agg(F.min("id").alias("rep"), F.max("id").alias("most"), F.max("n").alias("n")))
    shared = found.select("hash", "xk", "place", "l", "r", "reach").repartition(parts, "hash").sortWithinPartitions("hash").mapInArrow(_shared_batches(within), "hash long, xk long, place int, sides int, reach int")
    shared = written(shared.distinct(), "shared")
    shards = shards or max(parts, -(-shared.count() * min_words // entries))
    per_text = shared.groupBy("xk").agg(F.collect_list(F.struct("hash", "place", "sides", "reach")).alias("a"))
    wanted = per_text.join(texts, "xk").select(F.col("rep").alias("id"), "xk", F.col("a.hash").alias("hashes"), F.col("a.place").alias("places"), F.col("a.sides").alias("sides"), F.col("a.reach").alias("reach"))
    held = own.join(wanted, ["id", "xk"]).select("id", "text", "hashes", "places", "sides", "reach")
    segments = held.mapInArrow(_segment_batches(shards, min_words), "shard int, node long, start int, words array<int>")
    placed = segments.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    spans = placed.mapInArrow(_shard_batches(folder, entries, min_words, within), "node long, start long, stop long, first long")
    copies = texts.where("rep <> most")
    whole = copies.select(F.col("rep").alias("node"), F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("stop"), F.col("rep").alias("first"))
    w = Window.partitionBy("node").orderBy("start", "stop")
    spans = spans.unionByName(whole).withColumn("reach", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("part", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w))
    merged = spans.groupBy("node", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("first").alias("first"))
    of_reps = merged.select(F.col("node").alias("doc_id"), F.col("start").alias("start_word"), (F.col("stop") - F.col("start")).alias("n_words"), F.col("first").alias("first_doc_id"))
    of_copies = found.select("id", "xk", "n").distinct().join(copies.select("xk", "rep"), "xk").where("id <> rep").select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start_word"), F.col("n").cast("long").alias("n_words"), F.col("rep").alias("first_doc_id"))
    return of_reps.unionByName(of_copies)

"""Documents compared by digests of their improbable features.

A feature is a window of 64 bytes. Its entropy is measured in thousandths of the greatest possible
and ranked by how rare that value is in the corpus; in every 64 consecutive windows the leftmost of
the rarest rank gains a point, and windows with enough points are selected. Selected features set
five bits each in a chain of Bloom filters of 2048 bits, 160 features to a filter. Two digests are
compared filter by filter: bits in common, from what chance would give to what is possible at most,
scaled to 0..100, best partner for each filter of the smaller digest, averaged by features. A partner
with fewer features than the filter counts in proportion.

A score of S thus needs about S % of the smaller digest's features in common. For filters of n and more
features, s of them in common, the expected share of the room above chance is (e^cs - 1) / (e^cn - 1)
with c = HASHES / FILTER_BITS, at most s / n; what is left of it above CUTOFF, q, is less. Each feature
of the smaller digest is in one of its filters, so the s add up to at least the sum of q * n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, cut, written
from .simhash import _spread

WINDOW = 64
LEVELS = 1001
POPULAR = 16
FILTER_BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Share of the room above chance that counts as nothing in common.
CUTOFF = 0.3
#: Pairs are reported from this score on. Of copies of sf0.1's texts with words replaced, those of
#: word-3-gram Jaccard 0.8 to 0.9 reach it in 97 % of cases, of 119,997 pairs without a common feature none.
MIN_SCORE = 20
#: Of the share that its score would need, a pair has this part at least, but for chance, as bits scatter. The search leaves nothing out by it.
SLACK = 0.75
#: Texts of a feature that are compared at once; filters in a block.
GROUP, TILE = 2048, 512
_CHUNK = 1 << 18
_G = np.array([0, *(round(c * np.log2(c) * 65536) for c in range(1, 66))], np.int32)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of the window at each place, in 0..1000 of six bits. Fewer than 64 bytes have none."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    out = np.empty(n, np.int16)
    for at in range(0, n, _CHUNK):
        out[at : at + _CHUNK] = _entropies(data[at : at + _CHUNK + WINDOW - 1])
    return out


def _entropies(b: np.ndarray) -> np.ndarray:
    n = len(b) - WINDOW + 1
    before, after = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8)
    for k in range(1, WINDOW):  # how often a byte occurs in the 63 places on either side
        same = (b[k:] == b[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    first = int(_G[np.bincount(b[:WINDOW], minlength=256)].sum())
    gain = _G[1:] - _G[:-1]
    total = np.empty(n, np.int64)
    total[0] = first
    if n > 1:
        step = gain[before[WINDOW:]] - gain[after[: n - 1]]
        np.cumsum(step, out=total[1:])
        total[1:] += first
    bits = 6.0 - total / (65536.0 * WINDOW)
    return np.clip(np.rint(bits * (1000 / 6)), 0, 1000).astype(np.int16)


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy level: 0 for the rarest that occurs; low entropy (level < 100) comes last."""
    order = np.lexsort((np.arange(LEVELS), counts))
    rank = np.empty(LEVELS, np.int64)
    rank[order] = np.arange(LEVELS)
    rank[:100] = LEVELS
    return rank


def select(data: bytes, rank: np.ndarray) -> list[int]:
    """Hashes of the selected features in order. Texts of under 64 bytes have none."""
    b = np.frombuffer(data, np.uint8)
    e = entropies(b)
    if not len(e):
        return []
    r = rank[e]
    key = r << 40 | np.arange(len(r))
    span = min(WINDOW, len(key))
    low, width = key, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(key) - span + 1], low[span - width :])
    points = np.bincount(low & ((1 << 40) - 1), minlength=len(r))
    least = POPULAR if len(low) >= POPULAR else 1
    at = np.flatnonzero((points >= least) & (r < LEVELS))
    return list(dict.fromkeys(xxhash.xxh3_64_intdigest(data[i : i + WINDOW]) for i in at.tolist()))


def filters(features: np.ndarray) -> np.ndarray:
    """The chained Bloom filters of a document's features, as (k, 256) bytes."""
    k = max(1, -(-len(features) // PER_FILTER))
    bits = np.zeros((k, FILTER_BITS), bool)
    u = features.view(np.uint64)
    for h in range(HASHES):
        bits[np.arange(len(u)) // PER_FILTER, ((u >> np.uint64(11 * h)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def compare(x: np.ndarray, y: np.ndarray) -> float:
    """Score 0..100 of two chains of filters, in either order; 0 where either has no bit set."""
    nx, ny = _sizes(x), _sizes(y)
    if (nx.sum(), x.tobytes()) > (ny.sum(), y.tobytes()):
        x, y, nx, ny = y, x, ny, nx
    if not nx.sum():
        return 0.0
    common = np.bitwise_count(x[:, None, :].view(np.uint64) & y[None, :, :].view(np.uint64)).sum(-1).astype(float)
    a, b = np.bitwise_count(x.view(np.uint64)).sum(-1).astype(float)[:, None], np.bitwise_count(y.view(np.uint64)).sum(-1).astype(float)[None, :]
    chance, most = a * b / FILTER_BITS, np.minimum(a, b)
    floor = CUTOFF * (most - chance) + chance
    score = np.where(most > floor, (common - floor) / np.maximum(most - floor, 1e-9), 0)
    held = np.clip(score, 0, 1) * np.minimum(nx[:, None], ny[None, :])
    return float(100 * (held.max(axis=1).sum() / nx.sum()))


def _sizes(x: np.ndarray) -> np.ndarray:
    """How many features each filter has, as its bits tell; only proportions count."""
    bits = np.bitwise_count(x.view(np.uint64)).sum(-1).astype(float)
    return -np.log1p(-np.minimum(bits, FILTER_BITS - 1) / FILTER_BITS)


def _level_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(LEVELS, np.int64)
    for b in batches:
        for t in b.column(0):
            total += np.bincount(entropies(np.frombuffer(t.as_buffer() or b"", np.uint8)), minlength=LEVELS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS, dtype=np.int32)), pa.array(total)], ["level", "n"])


def rank_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks of the entropy levels from all windows of all texts; 1001 numbers come to the driver."""
    found = docs.select(F.col(text_col).cast("string").cast("binary").alias("t")).where("t is not null").mapInArrow(_level_batches, "level int, n long")
    counts = np.zeros(LEVELS, np.int64)
    for r in found.groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[r["level"]] = r["n"]
    return rarity_ranks(counts)


def feature_table(docs: DataFrame, rank: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, xk, features, digest``: of every row; ``xk`` is the hash of the exact text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                own = [np.array(select(t.as_py(), rank), np.uint64) if t.is_valid else np.zeros(0, np.uint64) for t in part.column(2)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                values = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
                digests = pa.array([filters(x.view(np.int64)).tobytes() if len(x) else b"" for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), digests], ["id", "xk", "features", "digest"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("xk"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return own.mapInArrow(run, "id long, xk long, features array<long>, digest binary")


def _tile(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bits, first filter of each digest, bits set and features of each filter."""
    starts = np.cumsum([0, *(len(x) // (FILTER_BITS // 8) for x in digests[:-1])])
    packed = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, FILTER_BITS // 8)
    return np.unpackbits(packed, axis=1).astype(np.float32), starts, np.bitwise_count(packed.view(np.uint64)).sum(-1).astype(float), _sizes(packed)


def _tile_scores(x: tuple, y: tuple, first: np.ndarray) -> np.ndarray:
    """Scores as of ``compare`` of each digest of ``x`` with each of ``y``; ``first`` tells which pairs have the smaller one in ``x``."""
    (bx, sx, a, nx), (by, sy, b, ny) = x, y
    common, a, b = (bx @ by.T).astype(float), a[:, None], b[None, :]
    chance, most = a * b / FILTER_BITS, np.minimum(a, b)
    floor = CUTOFF * (most - chance) + chance
    share = np.where(most > floor, (common - floor) / np.maximum(most - floor, 1e-9), 0)
    held = np.clip(share, 0, 1) * np.minimum(nx[:, None], ny[None, :])
    own = np.add.reduceat(np.maximum.reduceat(held, sy, axis=1), sx, axis=0) / np.add.reduceat(nx, sx)[:, None]
    other = np.add.reduceat(np.maximum.reduceat(held, sx, axis=0), sy, axis=1) / np.add.reduceat(ny, sy)[None, :]
    return 100 * np.where(first, own, other)


def _meet(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray | bool:
    """Which of the sets ``x`` have a member in common with which of ``y``."""
    u, v = (np.concatenate(z) for z in (x, y))
    both = np.intersect1d(u, v)
    if not len(both):
        return False
    out = []
    for z, values in ((x, u), (y, v)):
        m = np.zeros((len(z), len(both)), np.float32)
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        held = both[at] == values
        m[np.repeat(np.arange(len(z)), [len(q) for q in z])[held], at[held]] = 1
        out.append(m)
    return out[0] @ out[1].T > 0


def _matches(cell: np.ndarray, split: np.ndarray, part: np.ndarray, digests: list[bytes], early: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell that score ``least`` and have no earlier group in common; in a cell of two parts, those of a row of each."""
    size = FILTER_BITS // 8
    sums = [float(_sizes(np.frombuffer(x, np.uint8).reshape(-1, size)).sum()) for x in digests]
    rank = np.empty(len(digests), np.int64)
    rank[sorted(range(len(digests)), key=lambda i: (sums[i], digests[i]))] = np.arange(len(digests))
    ends, held = [0], 0
    for i, x in enumerate(digests):  # tiles of so many filters
        held += len(x) // size
        if held >= TILE or i == len(digests) - 1:
            ends.append(i + 1)
            held = 0
    out = []
    for k, (u, v) in enumerate(zip(ends, ends[1:])):
        x = _tile(digests[u:v])
        for s, t in zip(ends[: k + 1], ends[1:]):
            if cell[t - 1] != cell[u] and s != u:
                continue  # rows are in the order of cells
            y = x if s == u else _tile(digests[s:t])
            scores = _tile_scores(x, y, rank[u:v, None] < rank[None, s:t])
            may = (cell[u:v, None] == cell[None, s:t]) & (~split[u:v, None] | (part[u:v, None] != part[None, s:t])) & (np.arange(u, v)[:, None] > np.arange(s, t)[None, :])
            i, j = np.nonzero(may & (scores >= least - 1e-6) & ~np.asarray(_meet(early[u:v], early[s:t])))
            sure = scores[i, j] >= least + 1e-6
            for q in np.flatnonzero(~sure):  # sums of another order may differ in the last digit
                sure[q] = compare(*(np.frombuffer(z, np.uint8).reshape(-1, size) for z in (digests[u + i[q]], digests[s + j[q]]))) >= least
            out.append((u + i[sure], s + j[sure]))
    return tuple(np.concatenate(z) for z in zip(*out))


def _match_batches(least: float):
    """Reads rows in the order of cells; whole cells are compared, small ones together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.select(["g", "lo", "hi"])
            g, lo, hi = (c.to_numpy() for c in key.columns)
            other = np.flatnonzero((g != g[-1]) | (lo != lo[-1]) | (hi != hi[-1]))
            at = int(other[-1]) + 1 if len(other) else 0  # where the last cell begins
            before = rest[-1].slice(rest[-1].num_rows - 1).select(["g", "lo", "hi"]).to_pylist() if rest else None
            if before and at == 0 and before != key.slice(0, 1).to_pylist():
                yield from work(rest)
                rest = []
            if at:
                yield from work([*rest, b.slice(0, at)])
                rest = []
            rest.append(b.slice(at))
        if rest:
            yield from work(rest)

    def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        g, lo, hi, part, node = (t.column(k).to_numpy() for k in ("g", "lo", "hi", "part", "node"))
        new = np.flatnonzero((np.diff(g) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
        cell = np.zeros(len(g), np.int64)
        cell[new] = 1
        cell = np.cumsum(cell)
        begin = 0
        for end in [*new.tolist(), len(g)]:
            if end - begin < TILE // 2 and end < len(g):
                continue
            own = slice(begin, end)
            digests, early = (t.column(k).slice(begin, end - begin).to_pylist() for k in ("digest", "early"))
            i, j = _matches(cell[own], (lo != hi)[own], part[own], digests, [np.array(x, np.int64) for x in early], least)
            ids, row = np.unique(node[own], return_inverse=True)
            n = np.bincount(row[i], minlength=len(ids)) + np.bincount(row[j], minlength=len(ids))
            root = _spread(np.arange(len(ids)), row[i], row[j])
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]]), pa.array(n[at])], ["node", "root", "n"])
            begin = end

    return run


def similar_documents(docs: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links``: every document that has a copy or a similar document, and its class.

    Two texts are linked if they have a feature in common and their digests score at least
    ``min_score`` (a digest of one or two features can score by chance alone); classes are the connected
    components of all links, named by their least id. Texts that are equal are in one class, also
    those of under 64 bytes, which have no feature and no other link. ``n_links`` is the number of
    other texts linked with this one, all of them; 0 means exact copies only.
    Null, empty and blank texts and null ids are left out; repeated rows of one id and text are one;
    of two texts under one id each has its class, so that the id may have two rows (one, with the
    larger number, if both are in one class). Other columns are ignored; an empty table gives no rows.

    All texts of a feature are compared with each other, by digests in blocks. Features of a single
    text drop out, and of features that the same texts have one is taken, as the pairs are the same.
    A pair counts in the first of its groups, so that no pairs are written, only numbers and forests of
    links. A group of more than GROUP texts is cut into parts, each compared with itself and each other.
    """
    # rows of one text are one node; nodes are numbered as written, which makes their numbers short
    own = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~F.col(text_col).cast("string").rlike(r"^\s*$"))
    found = feature_table(own, rank_table(own, text_col), id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    rows = written(found, "features")
    texts = cut(rows.groupBy("xk").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies")))
    again = rows.select("row", "xk").join(texts.where("copies > 1"), "xk").where("row <> node").select("row")
    n = F.size("features")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    single = rows.select("row", "features").where(n > 0).join(again, "row", "left_anti").select(F.col("row").alias("node"), F.explode("features").alias("f")).repartition(parts, "f")
    per = single.groupBy("f").agg(F.count("node").alias("df"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("t")).where("df > 1")
    shared = cut(single.join(per, "f").select("node", "df", "s", "t").distinct())  # texts and groups, a group for features of the same texts
    one = cut(shared.select("df", "s", "t").distinct().withColumns({"g": F.monotonically_increasing_id(), "cells": F.ceil(F.col("df") / GROUP).cast("int")}))
    owned = shared.join(one, ["df", "s", "t"]).groupBy("node").agg(F.collect_list(F.struct("g", "cells")).alias("own"))
    placed = owned.join(rows.select(F.col("row").alias("node"), "digest"), "node").select("*", F.explode("own").alias("at")).select("node", "digest", "own", "at.*")
    placed = placed.withColumns({"early": F.filter("own.g", lambda x: x < F.col("g")), "part": F.pmod(F.xxhash64("node", F.lit(2)), F.col("cells")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("cells") - 1))})
    placed = placed.select("g", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "digest", "early")
    placed = placed.repartition(parts, "g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")
    links = cut(placed.mapInArrow(_match_batches(min_score), "node long, root long, n long"))
    final = components(links, "node", "root")
    degree = links.groupBy("node").agg(F.sum("n").alias("n_links"))
    classed = texts.join(final, "node", "left").where("label is not null or copies > 1").join(degree, "node", "left")
    classed = classed.select("xk", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    member = cut(rows.select("id", "xk").distinct().join(classed, "xk").select("id", "label", "n_links"))
    least = member.groupBy("label").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return member.join(least, "label").groupBy(F.col("id").alias("doc_id"), "class_id").agg(F.max("n_links").alias("n_links"))

"""SimHash near-duplicate search through fuzzy keys of the binary Golay code.

A document's 161-bit SimHash is cut into seven 23-bit segments. The perfect (23,12,7) Golay code
maps any 23-bit word to exactly one codeword within three bits, so the codeword's 12-bit index is a
fuzzy name of the segment. Each segment is decoded as it is and with every single bit flipped; that
gives one key (the word lies within two bits of a codeword) or six (it lies at three). Two segments
that differ in at most two bits have a word within one bit of both and therefore share a key. By the
pigeonhole principle two fingerprints at most ``3 * 7 - 1 = 20`` bits apart have such a segment, so
up to there the search is exact. Beyond, up to ``MAX_DISTANCE``, a pair is found if it has a segment
that errs little by luck, which most have; it is verified like any other, so none is wrong.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, cut, fresh

SEGMENTS = 7
BITS = 23 * SEGMENTS
MAX_DISTANCE = 28
#: Token counts set no limit (natural logarithm of the factor they may differ by); brute force in tests reads it.
LENGTH_SLACK = np.inf
_POLY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_WORD = re.compile(r"\w+")


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= _POLY << (i - 11)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each value of each byte; error pattern of each syndrome."""
    one = [_remainder(1 << i) for i in range(23)]
    synd = np.zeros((3, 256), np.int32)
    for byte in range(3):
        for x in range(256):
            for k in range(8):
                if x >> k & 1 and byte * 8 + k < 23:
                    synd[byte, x] ^= one[byte * 8 + k]
    leader = np.zeros(2048, np.int32)
    for i in range(23):
        leader[one[i]] = 1 << i
        for j in range(i):
            leader[one[i] ^ one[j]] = 1 << i | 1 << j
            for k in range(j):
                leader[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k
    return synd, leader


_SYNDROME, _LEADER = _tables()


def golay_index(v: np.ndarray) -> np.ndarray:
    """12-bit index of the one codeword within three bits of each 23-bit word."""
    s = _SYNDROME[0][v & 255] ^ _SYNDROME[1][v >> 8 & 255] ^ _SYNDROME[2][v >> 16]
    return (v ^ _LEADER[s]) >> 11


_FLIPS = np.array([0, *(1 << i for i in range(23))], np.int32)


def golay_keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of each word: sorted indices (n, 24) and a mask of the distinct ones."""
    keys = np.sort(golay_index(v.astype(np.int32)[:, None] ^ _FLIPS), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, new


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Three 64-bit words of fingerprint and the number of tokens of each text.

    Features are all lower-cased words, weighted by 1 + ln(count). A text without a word has 0 tokens.
    """
    n, digests, weights, ends = np.zeros(len(texts), np.int32), [], [], []
    total = 0
    for i, t in enumerate(texts):
        words = _WORD.findall(t.lower()) if t else []
        n[i] = len(words)
        counts = Counter(words)
        for w in counts:
            digests.append(xxhash.xxh3_128_digest(w) + xxhash.xxh3_64_digest(w, seed=7))
        weights.extend(counts.values())
        total += len(counts)
        ends.append(total)
    out = np.zeros((len(texts), 24), np.uint8)
    if total:
        raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 24)
        w = 1 + np.log(np.array(weights, np.float32))
        begin = 0
        for i, end in enumerate(ends):
            if end > begin:
                own, mine = w[begin:end], raw[begin:end]
                votes = own @ np.unpackbits(mine, axis=1)[:, :BITS].astype(np.float32)
                out[i, : (BITS + 7) // 8] = np.packbits(votes * 2 > own.sum())
            begin = end
    return out.view(np.int64), n


def segments(words: np.ndarray) -> np.ndarray:
    """The fingerprints' segments as (n, SEGMENTS) 23-bit numbers."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), 24), axis=1)[:, :BITS].reshape(len(words), SEGMENTS, 23)
    return bits.astype(np.int32) @ (1 << np.arange(22, -1, -1, dtype=np.int32))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            words, n = fingerprints(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(words[:, k]) for k in range(3)), pa.array(n)], ["id", "xk", "f0", "f1", "f2", "n"])


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            words = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in range(1, 4)], axis=1)
            segs = segments(words)
            rows, keys = [], []
            for s in range(SEGMENTS):
                k, new = golay_keys(segs[:, s])
                r, c = np.nonzero(new)
                key = k[r, c].astype(np.int64) << 3 | s
                rows.append(r)
                keys.append(key)
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), *(part.column(k).take(take) for k in range(4))], ["key", "node", "f0", "f1", "f2"])


def _close(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1) <= limit


def _star(node: np.ndarray, words: np.ndarray, size: np.ndarray | None, limit: int, block: tuple[int, int] = (64, 4096)) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is close among the rows of one bucket, all pairs compared once; ``size`` sets no limit."""
    high, wide = min(block[0], len(node)), min(block[1], len(node))
    x, a, b = (np.empty(high * wide, t) for t in (np.uint64, np.uint8, np.uint8))
    first, second, third = np.ascontiguousarray(words.T).view(np.uint64)
    label, left, right, held = np.arange(len(node)), [], [], 0
    for u in range(0, len(node), high):
        v = min(u + high, len(node))
        for s in range(0, v, wide):
            t = min(s + wide, v)
            shape = (v - u, t - s)
            xs, near, more = (z[: shape[0] * shape[1]].reshape(shape) for z in (x, a, b))
            np.bitwise_count(np.bitwise_xor(first[u:v, None], first[None, s:t], out=xs), out=near)
            np.bitwise_count(np.bitwise_xor(second[u:v, None], second[None, s:t], out=xs), out=more)
            near += more  # 128 bits; few pairs need the rest
            if t <= u and near.min() > limit:
                continue
            i, j = np.divmod(np.flatnonzero(near.ravel() <= limit), t - s)
            keep = j + s < i + u
            i, j = i[keep], j[keep]
            keep = near[i, j] + np.bitwise_count(third[i + u] ^ third[j + s]) <= limit
            left.append(i[keep] + u)
            right.append(j[keep] + s)
            held += len(left[-1])
            if held > 2_000_000:
                label = _spread(label, np.concatenate(left), np.concatenate(right))
                left, right, held = [np.arange(len(node))], [label], 0
    label = _spread(label, np.concatenate(left), np.concatenate(right))
    moved = label != np.arange(len(node))
    return node[moved], node[label[moved]]


def _spread(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = label.copy()
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _verify_batches(limit: int):
    """Reads rows sorted by key, compares all within a key, emits links between close rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []  # of one key, which may go over many batches
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if rest and (last or rest[0][0][0] != cols[0][0]):
                yield from work([np.concatenate(x) for x in zip(*rest, [c[:last] for c in cols], strict=True)])
                rest = []
            elif last:
                yield from work([c[:last] for c in cols])
            rest.append([c[last:].copy() for c in cols])
        if rest:
            yield from work([np.concatenate(x) for x in zip(*rest, strict=True)])

    def work(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, node, f0, f1, f2 = cols
        words = np.stack([f0, f1, f2], axis=1).view(np.uint64)
        cutpoints = np.flatnonzero(np.diff(key)) + 1
        begin, end = np.concatenate([[0], cutpoints]), np.concatenate([cutpoints, [len(key)]])
        length, left, right = end - begin, [], []
        # short runs, all at once: each row against the one `step` below it
        for step in range(1, 16):
            i = np.arange(len(key) - step)
            own = np.repeat(length, length)[: len(i)]
            i = i[(key[: len(key) - step] == key[step:]) & (own <= 16)]
            if not len(i):
                break
            hit = i[_close(words[i], words[i + step], limit)]
            left.append(node[hit + step])
            right.append(node[hit])
        for s in np.flatnonzero(length > 16):
            u, v = _star(node[begin[s] : end[s]], words[begin[s] : end[s]], None, limit)
            left.append(u)
            right.append(v)
        if left:
            u, v = np.concatenate(left), np.concatenate(right)
            e = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
            e = e[e[:, 0] != e[:, 1]]
            if len(e):
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return run


def simhash_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, xk, f0, f1, f2, n``: a row for each row of ``docs``; ``xk`` is the hash of the exact text."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("xk"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(_fingerprint_batches, "id long, xk long, f0 long, f1 long, f2 long, n int")


def near_duplicate_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``id, xk, n, label`` for every row that has a token; equal ``label`` means one group.

    Rows of equal fingerprint are one node, so groups of thousands of exact copies
    cost one node; the links found in a bucket are a forest, never all pairs of it.
    """
    prints = cut(simhash_table(docs, id_col, text_col).where("n > 0"))
    nodes = prints.groupBy("f0", "f1", "f2").agg(F.min("xk").alias("node"))
    nodes = cut(nodes.select("node", "f0", "f1", "f2"))
    keys = nodes.mapInArrow(_key_batches, "key int, node long, f0 long, f1 long, f2 long")
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    links = keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_verify_batches(max_distance), "a long, b long")
    labels = components(links, "a", "b")
    named = nodes.join(labels, "node", "left").select("f0", "f1", "f2", F.coalesce("label", "node").alias("label"))
    return prints.join(named, ["f0", "f1", "f2"]).select("id", "xk", "n", "label")


def near_duplicate_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id, kept_doc_id``: each document of a group with the one of it that stays (the least id).

    Null or token-less texts belong to no group; very long texts count whole. Null ids never stay
    while another id is in the group, and are not reported. Repeated rows of one id and text are one
    document; of two texts under one id each is in its own group, so that the id may have two rows.
    Other columns are ignored; an empty table gives no rows.
    """
    own = cut(near_duplicate_members(docs, id_col, text_col, max_distance).select("id", "label"))
    kept = own.groupBy("label").agg(F.min("id").alias("kept_doc_id"))
    return own.join(kept, "label").where("id <> kept_doc_id").select(F.col("id").alias("doc_id"), "kept_doc_id").distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the least id (nulls last).

    Rows whose text is null or has no word all stay. Of two texts under one id each is judged by its
    own group. All columns are returned unchanged; an empty table gives an empty one.
    """
    members = cut(near_duplicate_members(docs, id_col, text_col, max_distance).select("id", "xk", "label"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "xk"))
    best = members.groupBy("label").agg(first.alias("best"))
    grown = members.join(best, "label")
    lost = grown.where(~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("xk") == F.col("best.xk")))).select("id", "xk").distinct()
    a, b, r = fresh(docs, "_id", "_xk", "_rank")
    none = F.lit(-(2**63)).cast("long")
    lost = lost.select(F.coalesce("id", none).alias(a), F.col("xk").alias(b))
    keyed = docs.withColumns({a: F.coalesce(F.col(id_col).cast("long"), none), b: F.xxhash64(text_col)})
    from pyspark.sql import Window

    left = keyed.join(lost, [a, b], "left_anti")
    ranked = left.withColumn(r, F.row_number().over(Window.partitionBy(a, b).orderBy(F.lit(1))))
    wordless = F.col(text_col).isNull() | ~F.col(text_col).rlike(r"(?U)\w")
    return ranked.where((F.col(r) == 1) | wordless).select(*[F.col(f"`{c}`") for c in docs.columns])

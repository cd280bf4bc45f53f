"""Byte-pair encoding and decoding with forced boundaries.

A pair of bytes that never occurs inside any token of the vocabulary can never be covered by one
token, so every such place is a certain cut: what lies on either side is merged on its own and the
results are put one after the other. A text is first split into the pieces of the pre-tokenizing
pattern, and each piece is cut at all its forced pairs; without a pattern the text is one piece.

Pieces repeat often. The text is therefore split in two steps: fragments at those forced pairs that
the pattern cuts as well whatever stands around them (a change of character class after an ASCII
character other than white space), found for all bytes at once, then pieces and forced cuts within
a fragment. Each worker keeps the ids of the short fragments it has seen. The outcome equals encoding
the whole text at once.
"""

from __future__ import annotations

import base64
import heapq
import re
import string
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizing pattern that goes with it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_WIDE_SPACE = re.compile(b"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SPACE = b"\t\n\x0b\x0c\r "
_NONE = 1 << 60


def read_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file of base64 lines."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x.strip())}


def forced_pairs(tokens: Iterator[bytes]) -> np.ndarray:
    """(256, 256): whether no token holds the two bytes side by side."""
    free = np.ones((256, 256), bool)
    for t in tokens:
        for a, b in zip(t, t[1:]):
            free[a, b] = False
    return free


def pattern_pairs(after_wide: bool) -> np.ndarray:
    """(256, 256): pairs between which the pattern always cuts, whatever is around them.

    ``after_wide``: also where white space follows a byte of a character outside ASCII, which holds
    in texts without white space outside ASCII.
    """
    kind = np.array([0 if i in _SPACE else 1 if chr(i) in string.ascii_letters else 2 if chr(i) in string.digits else 3 if i < 128 else 4 for i in range(256)])
    safe = (kind[:, None] != kind[None, :]) & (kind[:, None] != 0) & (kind[:, None] != 4) & (kind[None, :] != 4)
    if after_wide:
        safe |= (kind[:, None] == 4) & (kind[None, :] == 0)
    return safe


class ForcedBoundaryBPE:
    """Encoder and decoder for one vocabulary. ``pattern`` None: merges may cross anything."""

    #: Short fragments whose ids a worker keeps: so many of late, and as many from before.
    KEEP, SHORT = 400_000, 48

    def __init__(self, vocabulary: bytes, pattern: str | None = PATTERN):
        self.ranks = read_ranks(vocabulary)
        self.pattern = regex.compile(pattern) if pattern else None
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.tokens[i] = t
        free = forced_pairs(iter(self.ranks))
        self.free = free.astype(np.uint8).tobytes()
        self.cuts = [(free & pattern_pairs(wide) if pattern else free).ravel() for wide in (False, True)]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def fragments(self, text: bytes) -> list[bytes]:
        if len(text) < 2:
            return [text] if text else []
        b = np.frombuffer(text, np.uint8)
        table = self.cuts[self.pattern is None or _WIDE_SPACE.search(text) is None]
        at = (np.flatnonzero(table[b[:-1].astype(np.uint16) << 8 | b[1:]]) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)])]

    def pieces(self, fragment: bytes) -> list[bytes]:
        """What the pattern makes of a fragment. Bytes that are not UTF-8 pass through it as characters of no class."""
        if self.pattern is None or (fragment[1:] if fragment[0] == 32 else fragment).isalpha():  # ASCII letters
            return [fragment]
        return [p.encode("utf-8", "surrogateescape") for p in self.pattern.findall(fragment.decode("utf-8", "surrogateescape"))]

    def parts(self, piece: bytes) -> list[bytes]:
        """A piece cut at all its forced pairs."""
        free = self.free
        at = [i + 1 for i, (a, b) in enumerate(zip(piece, piece[1:])) if free[a << 8 | b]]
        return [piece[i:j] for i, j in zip([0, *at], [*at, len(piece)])] if at else [piece]

    def merge(self, part: bytes) -> list[int]:
        """Ids of a part: of all adjacent tokens the pair of least rank merges first, of equal ones the leftmost."""
        ranks = self.ranks
        if len(part) == 1:
            return [ranks[part]]
        if len(part) > 64:
            return self._merge_long(part)
        own = [part[i : i + 1] for i in range(len(part))]
        rank = [ranks.get(part[i : i + 2], _NONE) for i in range(len(part) - 1)]
        while rank:
            least = min(rank)
            if least == _NONE:
                break
            i = rank.index(least)
            own[i : i + 2] = [own[i] + own[i + 1]]
            del rank[i]
            if i < len(rank):
                rank[i] = ranks.get(own[i] + own[i + 1], _NONE)
            if i:
                rank[i - 1] = ranks.get(own[i - 1] + own[i], _NONE)
        return [ranks[x] for x in own]

    def _merge_long(self, part: bytes) -> list[int]:
        """The same by a heap of pairs over a linked list."""
        ranks, n = self.ranks, len(part)
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # a token begins at i and ends at end[i]; 0 once it is merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(part[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j == n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(part[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := prev[i]) >= 0 and (r := ranks.get(part[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i : end[i]]])
            i = end[i]
        return out

    def _ids(self, fragment: bytes) -> bytes:
        out = self.older.get(fragment)
        if out is None:
            ids: list[int] = []
            for piece in self.pieces(fragment):
                whole = self.ranks.get(piece) if self.pattern is not None else None
                if whole is not None:
                    ids.append(whole)
                else:
                    for part in self.parts(piece):
                        ids += self.merge(part)
            out = struct.pack(f"<{len(ids)}i", *ids)
        if len(fragment) <= self.SHORT:
            if len(self.known) >= self.KEEP:
                self.known, self.older = {}, self.known
            self.known[fragment] = out
        return out

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        ids, own = self._ids, self.fragments(text)
        return b"".join([x or ids(f) for f, x in zip(own, map(self.known.get, own))])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODERS: dict[tuple, ForcedBoundaryBPE] = {}


def coder(vocabulary: bytes, pattern: str | None) -> ForcedBoundaryBPE:
    """One coder for each vocabulary and pattern in a process."""
    key = (hash(vocabulary), len(vocabulary), pattern)
    if key not in _CODERS:
        _CODERS[key] = ForcedBoundaryBPE(vocabulary, pattern)
    return _CODERS[key]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens, exact``: a row for each row; ``exact`` says that the ids decode to the text.

    A null text has null ids, n_tokens and exact; an empty one no ids and exact true. Null and
    repeated ids are passed on, and equal rows give equal rows. Very long texts are encoded whole; a
    part without a forced pair takes n log n steps. Of pairs of equal rank the leftmost merges first.
    Other columns are ignored; an empty table gives an empty one. The driver reads the vocabulary file
    (its size is fixed; VOCABULARY is only the default) and broadcasts it, so executors need no copy.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                packed, exact, ends = [], [], [0]
                for t in part.column(1).to_pylist():
                    x = None if t is None else own.encode(t)
                    if x is not None:
                        packed.append(x)
                    exact.append(None if x is None else own.decode(np.frombuffer(x, "<i4").tolist()) == t)
                    ends.append(ends[-1] + (len(x) // 4 if x else 0))
                values = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
                gone = pa.array([e is None for e in exact], pa.bool_())
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=gone)
                n = pa.array([None if e is None else k - i for e, i, k in zip(exact, ends, ends[1:])], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, n, pa.array(exact, pa.bool_())], ["doc_id", "ids", "n_tokens", "exact"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, exact boolean")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids. Null ids give a null text. Ids outside the vocabulary raise."""
    with open(vocabulary, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value, PATTERN)
        for b in batches:
            text = [None if x is None else own.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")

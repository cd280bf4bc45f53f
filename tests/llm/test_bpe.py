import random

import numpy as np
import pytest
import tiktoken

from symgrid.llm import bpe as B

from .fixtures import DOCS, EDGE_DOCS, documents

PUBLIC = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARIES = ["/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"]


def load(path, pattern=B.PATTERN):
    with open(path, "rb") as f:
        return B.ForcedBoundaryBPE(f.read(), pattern)


def ids(coder, text):
    return np.frombuffer(coder.encode(text.encode()), "<i4").tolist()


def random_text(rng):
    alphabet = ["the", "The", "'s", "'ll", "''s", "'", " ", "  ", "\n", "\n\n", "\t", "1", "23", "a1b", "_", "__", "é", "né le", "ß", "日本", " ", "　", " ", "!", "...", "$$$", "re", "'re", "\r\n", "🙂", "x" * 70]
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("path", VOCABULARIES)
def test_equals_encoding_the_whole(path):
    own = load(path)
    whole = tiktoken.Encoding("whole", pat_str=PUBLIC, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(0)
    for _ in range(4000):
        t = random_text(rng)
        got = ids(own, t)
        assert got == whole.encode_ordinary(t), t
        assert own.decode(got) == t.encode()
    assert sum(map(len, map(own.fragments, [b"one two, three"]))) >= 4


def merges(ranks, piece):
    """Byte-pair merging by its definition."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_without_a_pattern_every_forced_pair_cuts():
    own = load(VOCABULARIES[0], None)
    rng = random.Random(1)
    for _ in range(400):
        t = random_text(rng).encode()
        assert np.frombuffer(own.encode(t), "<i4").tolist() == merges(own.ranks, t), t
    free = B.forced_pairs(iter(own.ranks))
    assert all(free[f[-1], g[0]] for f, g in zip(own.fragments(b"some text, 12 of it"), own.fragments(b"some text, 12 of it")[1:]))


@pytest.mark.parametrize("path", VOCABULARIES)
def test_forced_pairs_cut_inside_pieces(path):
    own = load(path)
    inside = [p for word in ["xqzjk", "Qx9", "日本語テキスト", "#!/usr", "ħgŧ", "zzqj vvxq"] for f in own.fragments(word.encode()) for piece in own.pieces(f) for p in own.parts(piece)[1:]]
    assert len(inside) >= 3  # cuts that the pattern does not make
    assert all(piece == b"".join(own.parts(piece)) for piece in (b"xqzjk", b" a", b"x"))


def test_long_parts_merge_like_short_ones():
    own = load(VOCABULARIES[0])
    rng = random.Random(5)
    for n in (65, 200, 1500):
        for letters in ("ab", "etaoinshr", "a"):
            t = "".join(rng.choice(letters) for _ in range(n)).encode()
            assert own.merge(t) == merges(own.ranks, t)
    t = b"ab" * 100_000
    assert own.decode(own.merge(t)) == t


def test_ties_and_repeated_rows(spark):
    docs = documents(spark, [(1, "aaaa aaa"), (1, "aaaa aaa"), (2, "aaaa aaa")])
    assert len({tuple(r["ids"]) for r in B.encode_documents(docs).collect()}) == 1 and B.encode_documents(docs).count() == 3


def test_round_trip_of_the_table(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    enc = B.encode_documents(docs)
    got = {r["doc_id"]: r for r in enc.collect()}
    whole = tiktoken.Encoding("whole", pat_str=PUBLIC, mergeable_ranks=load(VOCABULARIES[0]).ranks, special_tokens={})
    for r in docs.collect():
        g = got[r["doc_id"]]
        assert g["exact"] and g["ids"] == whole.encode_ordinary(r["text"]) and g["n_tokens"] == len(g["ids"])
    assert {r["doc_id"]: r["text"] for r in B.decode_documents(enc).collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_edge_cases(spark):
    got = B.encode_documents(EDGE_DOCS(spark))
    assert got.columns == ["doc_id", "ids", "n_tokens", "exact"] and got.count() == 10
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["ids"] is None and by[1]["n_tokens"] is None and by[1]["exact"] is None
    assert by[2]["ids"] == [] and by[2]["exact"] and by[5]["n_tokens"] > 30_000 and by[5]["exact"] and None in by
    assert B.encode_documents(documents(spark, [])).count() == 0
    bad = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    assert B.encode_documents(bad).first()["exact"]

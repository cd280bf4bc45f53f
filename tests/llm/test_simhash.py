import random

import numpy as np
import pyarrow as pa
import pytest

from symgrid.llm import simhash as S

from .fixtures import DOCS, EDGE_DOCS, documents, prose, rows


def test_golay_code_is_perfect():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 5000).astype(np.int32)
    i = S.golay_index(v)
    for flips in ((3,), (0, 22), (1, 9, 17)):  # the codeword of a word is that of all words within three bits
        code = i << 11
        s = S._SYNDROME[0][code & 255] ^ S._SYNDROME[1][code >> 8 & 255] ^ S._SYNDROME[2][code >> 16]
        codeword = code ^ s  # the remainder makes it a multiple of the generator
        e = sum(1 << f for f in flips)
        assert (S.golay_index(codeword ^ e) == i).all()
        assert (np.bitwise_count(codeword ^ v) <= 3).all()


def test_two_bits_apart_share_a_key():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 2000).astype(np.int32)
    keys, new = S.golay_keys(v)
    assert set(new.sum(axis=1)) <= {1, 6}
    for a, b in ((0, 1), (5, 22), (7, 7)):
        other, _ = S.golay_keys(v ^ (1 << a | 1 << b))
        assert all(set(x) & set(y) for x, y in zip(keys, other))


def brute(texts, limit=S.MAX_DISTANCE):
    f, n = S.fingerprints(texts)
    f = f.view(np.uint64)
    return {(i, j) for i in range(len(texts)) for j in range(i) if n[i] and n[j] and np.bitwise_count(f[i] ^ f[j]).sum() <= limit and abs(np.log(n[i]) - np.log(n[j])) <= S.LENGTH_SLACK}


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in list(root)}


def test_recall_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for k in range(80):
        base = prose(rng, rng.choice([30, 80, 300]))
        texts.append(base)
        for _ in range(rng.choice([0, 1, 3])):
            w = base.split()
            for _ in range(max(1, len(w) * rng.choice([1, 3, 6]) // 100)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append(" ".join(w))
    want = groups(brute(texts))
    got = groups({(a, b) for a, b in rows(S.near_duplicate_pairs(documents(spark, list(enumerate(texts)))))})
    assert sum(got.get(x) == r for x, r in want.items()) >= 0.95 * len(want)
    assert all(x in want for x in got)
    near = {p for p in brute(texts, 3 * S.SEGMENTS - 1)}
    assert all(got[a] == got[b] for a, b in near)  # the pigeonhole guarantee


def test_large_bucket_is_compared_in_full():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**63, (600, 3)).astype(np.uint64)
    words[300:] = words[:300] ^ np.uint64(5)
    a, b = S._star(np.arange(600), words, np.zeros(600), 6)
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == {(i, i + 300) for i in range(300)}


def test_edge_cases(spark):
    docs = EDGE_DOCS(spark)
    assert rows(S.near_duplicate_pairs(docs)) == [(4, 3), (8, 3)]
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert [i for n, i in ids if not n] == [1, 2, 3, 5, 6, 7]
    assert sum(n for n, _ in ids) == 1


@pytest.mark.parametrize("n", [0])
def test_empty(spark, n):
    docs = documents(spark, [])
    assert rows(S.near_duplicate_pairs(docs)) == []
    assert S.drop_near_duplicates(docs).count() == 0


def test_finds_copies_of_the_table(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").select("text").collect()]
    want, got = groups(brute(texts)), groups(rows(S.near_duplicate_pairs(docs)))
    assert sum(got.get(x) == r for x, r in want.items()) >= 0.95 * len(want) and all(x in want for x in got)


def test_length_sets_no_limit(spark):
    rng = random.Random(21)
    texts = []
    for n in (60, 200, 900):
        base = prose(rng, n)
        texts += [base, f"{base} {base}", f"{base}\n{base[: len(base) // 8]}"]  # repeated whole, and in part
    f, n = S.fingerprints(texts)
    f = f.view(np.uint64)
    want = {(i, j) for i in range(len(texts)) for j in range(i) if np.bitwise_count(f[i] ^ f[j]).sum() <= 3 * S.SEGMENTS - 1}
    assert any(max(n[i], n[j]) >= 1.9 * min(n[i], n[j]) for i, j in want)
    assert groups(rows(S.near_duplicate_pairs(documents(spark, list(enumerate(texts)))))) == groups(want)


def test_two_texts_under_one_id(spark):
    rng = random.Random(3)
    a, b = prose(rng, 90), prose(rng, 90)
    docs = documents(spark, [(5, a), (5, b), (6, a), (4, b)])
    assert rows(S.near_duplicate_pairs(docs)) == [(5, 4), (6, 5)]
    assert sorted((r["doc_id"], r["text"]) for r in S.drop_near_duplicates(docs).collect()) == sorted([(5, a), (4, b)])


def test_numbers_and_short_words_count():
    f, _ = S.fingerprints(["the cat sat on it 12 34 long words here", "the cat sat on it 12 99 long words here", "a dog ran by me 12 34 long words here"])
    d = lambda i, j: int(np.bitwise_count((f[i] ^ f[j]).view(np.uint64)).sum())
    assert 0 < d(0, 1) < d(0, 2)


def test_pairs_of_a_bucket_are_compared_once(monkeypatch):
    rng, seen, count = np.random.default_rng(6), [], np.bitwise_count
    n = 9000
    words = rng.integers(0, 2**63, (n, 3)).astype(np.uint64)
    words[n // 2 :] = words[: n // 2] ^ np.array([5, 1 << 60, 3], np.uint64)  # five bits, in all words
    want = {(i, i + n // 2) for i in range(n // 2)}

    def counted(x, *args, **kw):
        seen.append(np.size(x))
        return count(x, *args, **kw)

    monkeypatch.setattr(np, "bitwise_count", counted)
    a, b = S._star(np.arange(n), words, None, 5)
    assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == want
    assert not len(S._star(np.arange(n), words, None, 4)[0])
    assert sum(seen) <= 2 * 2.1 * n * (n - 1) / 2  # two words of a pair, once, for each of the two calls


def test_keys_over_many_batches():
    rng = np.random.default_rng(7)
    key = np.sort(np.concatenate([np.full(90, 1), np.full(3, 2), np.full(40, 5), rng.integers(6, 30, 60)])).astype(np.int32)
    words = rng.integers(0, 2**63, (len(key), 3))
    words[1::2] = words[0:-1:2] ^ 9
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(len(key))), *(pa.array(words[:, k]) for k in range(3))], ["key", "node", "f0", "f1", "f2"])

    def links(size):
        parts = [whole.slice(at, size) for at in range(0, len(key), size)]
        return {p for b in S._verify_batches(6)(iter([whole.slice(0, 0), *parts])) for p in zip(*(c.to_pylist() for c in b.columns))}

    want = links(len(key))
    assert len(want) > 60 and all(links(size) == want for size in (1, 3, 10, 45, 90, 93))

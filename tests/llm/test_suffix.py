import random
from collections import defaultdict

import numpy as np
import pytest

from symgrid.llm import suffix as X
from symgrid.llm.esais import Scratch, suffix_array

from .fixtures import DOCS, EDGE_DOCS, documents, prose, rows


def brute_array(t, cap):
    t = t.tolist()
    sa, lcp = sorted(range(len(t)), key=lambda i: t[i:]), [0]
    for a, b in zip(sa, sa[1:]):
        k = 0
        while k < cap and a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(k)
    return sa, lcp


@pytest.mark.parametrize("entries", [4, 16, 1 << 20])
def test_suffix_array_in_memory_and_on_disk(tmp_path, entries):
    rng, spilled = np.random.default_rng(entries), 0
    for it in range(150):
        k = int(rng.integers(1, 12))
        t = rng.integers(1, k + 1, int(rng.integers(1, 90)))
        if it % 3 == 0:
            t = np.concatenate([np.tile(rng.integers(1, k + 1, 5), int(rng.integers(1, 8))), t])
        _, t = np.unique(np.append(t, 0), return_inverse=True)
        s = Scratch(str(tmp_path), entries)
        sa, lcp = suffix_array(t, s, 200)
        s.close()
        assert (sa.tolist(), lcp.tolist()) == brute_array(t, 200)
        spilled += s.spilled
    assert (spilled > 0) == (entries < 100)


def brute_cover(texts, n, within=False):
    """Word places of each document that lie in a passage of n words another document has (or another place)."""
    words = {i: X._WORD.findall(t.lower()) for i, t in texts if t}
    where = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].add((i, k) if within else i)
    out = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            if len(where[tuple(w[k : k + n])]) > 1:
                out[i] |= set(range(k, k + n))
    return dict(out)


def cover(found):
    out = defaultdict(set)
    for i, s, n, _ in found:
        out[i] |= set(range(s, s + n))
    return dict(out)


@pytest.mark.parametrize("shards,entries", [(1, 64), (5, 1 << 20)])
def test_against_brute_force(spark, shards, entries):
    rng = random.Random(shards)
    passages = [prose(rng, n) for n in (49, 50, 51, 70, 200)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages), prose(rng, rng.randint(0, 60))]
        if i % 10 == 0:
            parts.append("for " * 150)
        texts.append((i, " ".join(parts)))
    texts += [(100, texts[3][1]), (101, texts[3][1])]
    got = rows(X.repeated_passages(documents(spark, texts), shards=shards, entries=entries))
    assert cover(got) == brute_cover(texts, 50)
    assert all(f <= i for i, _, _, f in got)


def test_on_the_table(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert cover(rows(X.repeated_passages(docs))) == brute_cover(texts, 50)


def test_anchors_meet_in_equal_passages():
    rng = random.Random(9)
    for _ in range(50):
        p = prose(rng, 50)
        a, b = (X.word_hashes(f"{prose(rng, rng.randint(0, 80))} {p} {prose(rng, rng.randint(0, 80))}") for _ in range(2))
        assert set(X.anchors(a)[0]) & set(X.anchors(b)[0])


def test_edge_cases(spark):
    assert rows(X.repeated_passages(EDGE_DOCS(spark)))[:2] == [(3, 0, 120, 3), (4, 0, 120, 3)]
    assert rows(X.repeated_passages(documents(spark, []))) == []


@pytest.mark.parametrize("n", [255, 256, 300, 700])
def test_long_passages(spark, n):
    rng = random.Random(n)
    p = prose(rng, 800)
    texts = [(1, f"{prose(rng, 40)} {p}"), (2, f"{p} {prose(rng, 90)}"), (3, prose(rng, 900))]
    got = cover(rows(X.repeated_passages(documents(spark, texts), min_words=n)))
    assert got == brute_cover(texts, n) and set(got) == {1, 2}
    with pytest.raises(ValueError):
        suffix_array(np.array([2, 1, 0]), Scratch("", 4), 1 << 16)


def test_repeats_within_a_document(spark):
    rng = random.Random(4)
    p, q = prose(rng, 80), prose(rng, 60)
    texts = [(1, f"{p} {prose(rng, 30)} {p}"), (2, f"{q} {prose(rng, 100)}"), (3, f"{prose(rng, 9)} {q}"), (4, "so " * 120), (5, prose(rng, 300))]
    docs = documents(spark, texts)
    assert cover(rows(X.repeated_passages(docs, within=True))) == brute_cover(texts, 50, within=True)
    assert set(cover(rows(X.repeated_passages(docs)))) == {2, 3}


def test_remote_folders_are_refused(spark, monkeypatch):
    monkeypatch.setattr(X, "shared_dir", lambda s: "hdfs://there/folder")
    with pytest.raises(ValueError):
        X.repeated_passages(documents(spark, [(1, "a")]))

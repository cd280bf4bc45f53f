import math
import random
from collections import Counter

import numpy as np

from symgrid.llm import digest as D

from .fixtures import DOCS, EDGE_DOCS, documents, prose, rows


def test_entropy_against_definition():
    data = prose(random.Random(0), 300).encode() + b"a" * 200
    got = D.entropies(np.frombuffer(data, np.uint8))
    for i in range(0, len(got), 17):
        c = Counter(data[i : i + 64]).values()
        h = -sum(x / 64 * math.log2(x / 64) for x in c)
        assert abs(got[i] - h / 6 * 1000) < 0.6
    assert len(D.entropies(np.zeros(63, np.uint8))) == 0


def test_chunks_do_not_matter(monkeypatch):
    data = np.frombuffer(prose(random.Random(1), 500).encode(), np.uint8)
    whole = D.entropies(data)
    monkeypatch.setattr(D, "_CHUNK", 100)
    assert (D.entropies(data) == whole).all()


def test_selection_by_popularity():
    data = prose(random.Random(2), 400).encode()
    rank = D.rarity_ranks(np.bincount(D.entropies(np.frombuffer(data, np.uint8)), minlength=D.LEVELS))
    r = rank[D.entropies(np.frombuffer(data, np.uint8))]
    points = Counter(min(range(i, i + 64), key=lambda k: (r[k], k)) for i in range(len(r) - 63))
    want = [i for i in sorted(points) if points[i] >= D.POPULAR]
    assert len(D.select(data, rank)) == len({data[i : i + 64] for i in want})


def test_scores():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 2**63, 400).astype(np.int64)
    assert D.compare(D.filters(f), D.filters(f)) == 100
    assert D.compare(D.filters(f), D.filters(rng.integers(0, 2**63, 400))) < 5
    assert D.compare(D.filters(f[:160]), D.filters(f)) == 100
    assert 40 < D.compare(D.filters(f[:150]), D.filters(np.concatenate([f[:100], rng.integers(0, 2**63, 50)]))) < 80


def brute(docs, min_score=D.MIN_SCORE):
    """Least id of the class of each document, from all pairs of digests."""
    rank, least, ids = D.rank_table(docs), {}, {}
    for r in docs.where("doc_id is not null and trim(text) <> ''").orderBy("doc_id").collect():
        least.setdefault(r["text"], r["doc_id"])
        ids.setdefault(r["text"], []).append(r["doc_id"])
    f = {t: np.array(D.select(t.encode(), rank), np.uint64).view(np.int64) for t in least}
    sets = {t: set(x.tolist()) for t, x in f.items() if len(x)}
    f = {t: D.filters(f[t]) for t in sets}
    names = sorted(f)
    links = {(s, t) for i, s in enumerate(names) for t in names[:i] if D.compare(f[s], f[t]) >= min_score and sets[s] & sets[t]}
    root = {i: i for own in ids.values() for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for own in ids.values():
        for i in own:
            root[max(find(i), find(own[0]))] = min(find(i), find(own[0]))
    for s, t in links:
        x, y = find(least[s]), find(least[t])
        root[max(x, y)] = min(x, y)
    out = {i: find(i) for i in root}
    many = Counter(out.values())
    return {(i, c) for i, c in out.items() if many[c] > 1}, links


def found(df):
    return {(a, c) for a, c, _ in rows(df)}


def test_classes_of_the_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    want, _ = brute(docs)
    got = found(D.similar_documents(docs))
    assert want and len(want & got) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_classes_of_edited_copies_against_all_pairs(spark):
    rng = random.Random(3)
    texts = []
    hot = prose(rng, 60)
    for _ in range(40):
        w = prose(rng, rng.choice([40, 150, 600])).split()
        for _ in range(3):
            texts.append(" ".join([*w, *hot.split()] if rng.random() < 0.5 else w))
            w[rng.randrange(len(w))] = prose(rng, 1)
    docs = documents(spark, list(enumerate(texts)))
    for least in (5, 20, 60):
        assert found(D.similar_documents(docs, min_score=least)) == brute(docs, least)[0]


def test_edge_cases(spark):
    got = rows(D.similar_documents(EDGE_DOCS(spark)))
    assert got == [(3, 3, 0), (4, 3, 0)]
    assert rows(D.similar_documents(documents(spark, []))) == []


def test_two_texts_under_one_id(spark):
    rng = random.Random(8)
    a, b = prose(rng, 200).split(), prose(rng, 200).split()
    near = lambda w: " ".join([*w[:100], "zzz", *w[101:]])
    docs = documents(spark, [(5, " ".join(a)), (5, " ".join(b)), (6, near(a)), (7, near(b)), (5, " ".join(a)), (8, "short"), (9, "short"), (9, "short")])
    # 5 is in both classes, whose least id it is; equal texts without a feature are copies
    assert rows(D.similar_documents(docs)) == [(5, 5, 1), (6, 5, 1), (7, 5, 1), (8, 8, 0), (9, 8, 0)]


def test_links_count_other_texts(spark):
    w = prose(random.Random(4), 300).split()
    docs = documents(spark, [(1, " ".join(w)), (2, " ".join(w)), (3, " ".join([*w[:150], "x", *w[150:]]))])
    assert rows(D.similar_documents(docs)) == [(1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_score_needs_its_share():
    rng = np.random.default_rng(4)
    f = rng.integers(0, 2**63, 1000).astype(np.int64)
    for x, y in ((f[:160], np.concatenate([f[200:360], f[:24]])), (f[:184], np.concatenate([f[400:720], f[160:184]])), (f[:500], np.concatenate([f[600:760], f[100:140]]))):
        for a, b in ((x, y), (y, x)):
            share = len(np.intersect1d(x, y)) / min(len(x), len(y))
            assert D.compare(D.filters(a), D.filters(b)) / 100 * D.SLACK <= share < 0.5


def test_long_documents_against_all_pairs(spark):
    rng = random.Random(9)
    passage, texts = prose(rng, 140), []
    for n in (700, 800, 1500, 1600, 2600):  # several filters; the passage is in the last one
        texts += [f"{prose(rng, n)} {passage}", f"{prose(rng, n + 100)} {passage}"]
    texts += [passage, f"{passage} {prose(rng, 60)}"]
    docs = documents(spark, list(enumerate(texts)))
    for least in (10, 20, 50):
        want, _ = brute(docs, least)
        assert want and found(D.similar_documents(docs, min_score=least)) == want


def jaccard(a, b):
    x, y = (set(zip(w, w[1:], w[2:])) for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_recall_of_near_copies_by_their_words(spark):
    rng = random.Random(12)
    texts, near = [], set()
    for k in range(60):
        w = prose(rng, rng.choice([80, 200, 600])).split()
        texts.append(" ".join(w))
        for _ in range(len(w) // 20):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
        if 0.7 <= jaccard(texts[-2], texts[-1]) < 0.9:
            near.add((2 * k + 1, 2 * k))
    got = found(D.similar_documents(documents(spark, list(enumerate(texts)))))
    assert len(near) >= 30 and len(near & got) >= 0.9 * len(near)
    assert all(i - c <= 1 and c % 2 == 0 for i, c in got)  # unrelated texts do not meet


def counts(links):
    return Counter(t for pair in links for t in pair)


def test_every_link_is_counted(spark, monkeypatch):
    rng, texts = random.Random(17), []
    for n in (60, 200, 900):
        w = prose(rng, n).split()
        for _ in range(14):  # each copy departs from the others
            v = list(w)
            for _ in range(n // 25):
                v[rng.randrange(n)] = prose(rng, 1)
            texts.append(" ".join(v))
    docs = documents(spark, list(enumerate(texts)))
    classes, links = brute(docs)
    degree = counts(links)
    assert len(links) >= 200
    for group in (D.GROUP, 5):  # whole, and cut into parts
        monkeypatch.setattr(D, "GROUP", group)
        got = rows(D.similar_documents(docs))
        assert {(i, c) for i, c, _ in got} == classes and {i: n for i, _, n in got} == {i: degree[t] for i, t in enumerate(texts) if degree[t]}


def test_links_of_little_in_common(spark):
    rng, passage = random.Random(20), prose(random.Random(21), 22)
    texts = [f"{prose(rng, rng.choice([40, 50, 60]))} {passage}" for _ in range(150)] + [f"{prose(rng, 1050)} {passage}" for _ in range(60)]
    docs = documents(spark, list(enumerate(texts)))
    classes, links = brute(docs)
    rank = D.rank_table(docs)
    f = {t: set(D.select(t.encode(), rank)) for t in texts}
    little = [(s, t) for s, t in links if len(f[s] & f[t]) < D.SLACK * D.MIN_SCORE / 100 * min(len(f[s]), len(f[t]))]
    assert little  # the bits of other features meet, too
    got = rows(D.similar_documents(docs))
    assert {(i, c) for i, c, _ in got} == classes and {i: n for i, _, n in got} == {i: counts(links)[t] for i, t in enumerate(texts) if counts(links)[t]}

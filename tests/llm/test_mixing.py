import hashlib
import random
from collections import Counter

from symgrid.llm import mixing as M

from .fixtures import EDGE_DOCS, documents, prose


def brute(rows, rates, seed=0):
    """Copies of each row (doc_id, source): one running sum for each source."""
    out, upto = Counter(), {}
    for i, s in rows:
        r = rates[s]
        u = upto.setdefault(s, int(hashlib.md5(f"{seed}:{s or ''}".encode()).hexdigest()[:12], 16) % M.UNIT)
        out[i] += (u + r) // M.UNIT - u // M.UNIT
        upto[s] = u + r
    return +out


def corpus(spark, seed=0):
    rng = random.Random(seed)
    data = [(i * 7, prose(rng, rng.randint(1, 60)), "en", rng.choice(["hot"] * 8 + ["b", "c", None]), 1) for i in range(3000)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long"), data


def test_against_one_running_sum(spark):
    df, data = corpus(spark)
    rates = {r["source"]: r["rate"] for r in M.rates(df).collect()}
    got = Counter(r["doc_id"] for r in M.mix(df).collect())
    assert got == brute(((d[0], d[3]) for d in data), rates)


def test_reaches_the_weights(spark):
    df, data = corpus(spark, 1)
    weights = {"hot": 1, "b": 2, "c": 1}
    size = Counter()
    for r in M.mix(df, weights, seed=3, other=0).collect():
        size[r["source"]] += len(r["text"])
    total = sum(size.values())
    assert None not in size
    for k, w in weights.items():
        assert abs(size[k] / total - w / 4) < 0.02
    again = M.mix(df.repartition(7), weights, seed=3, other=0)
    assert Counter(r["doc_id"] for r in again.collect()) == Counter(r["doc_id"] for r in M.mix(df, weights, seed=3, other=0).collect())


def test_any_run_has_its_expected_copies(spark):
    df, data = corpus(spark, 2)
    rate = {r["source"]: r["rate"] for r in M.rates(df).collect()}["hot"] / M.UNIT
    got = Counter(r["doc_id"] for r in M.mix(df).where("source = 'hot'").collect())
    own = [d[0] for d in data if d[3] == "hot"]
    for s in range(0, len(own) - 200, 37):
        assert abs(sum(got[i] for i in own[s : s + 200]) - 200 * rate) <= 1


def test_numbers_copies(spark):
    docs = documents(spark, [(1, "a")], source="x").unionByName(documents(spark, [(i, "long text " * 50) for i in range(2, 40)], source="y"))
    got = [r["copy"] for r in M.mix(docs, copy_col="copy").collect() if r["doc_id"] == 1]
    assert len(got) in (9500, 9501) and sorted(got) == list(range(1, len(got) + 1))  # half of 19,001 characters
    clash = M.mix(docs.selectExpr("*", "'x' as copy"), copy_col="copy")
    assert clash.columns[-2:] == ["copy", "copy_"]


def test_scattered_ids(spark, monkeypatch):
    monkeypatch.setattr(M, "FEW", 3)  # so that the sums take all levels
    rng = random.Random(6)
    ids = sorted({rng.randrange(-(2**63), 2**63) for _ in range(900)} | set(range(300)) | {2**63 - 1, -(2**63)})
    data = [(i, prose(rng, rng.randint(1, 30)), "en", rng.choice("aaab"), 1) for i in ids]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    rates = {r["source"]: r["rate"] for r in M.rates(df).collect()}
    assert Counter(r["doc_id"] for r in M.mix(df).collect()) == brute(((d[0], d[3]) for d in data), rates)


def test_edge_cases(spark):
    docs = EDGE_DOCS(spark)
    got = M.mix(docs)
    assert got.columns == docs.columns and got.count() == docs.count()  # one source of weight one
    assert M.mix(documents(spark, [])).count() == 0
    assert M.mix(documents(spark, [(1, None), (1, ""), (None, None)], source=None)).count() == 3  # no characters at all: once each


def test_pipeline_keeps_skewed_shares(spark):
    import corpus_pipeline

    rng = random.Random(4)
    sources = ["src0"] * 3600 + [f"src{k}" for k in range(1, 20) for _ in range(21)]
    data = [(i, prose(rng, 20), "en", s, 1) for i, s in enumerate(sources)] + [(9999, "tiny", "en", "one", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    size = Counter()
    for r in corpus_pipeline.source_mixing(spark, df, "").collect():
        size[r["source"]] += len(r["text"])
    total = sum(size.values())
    assert len(size) == 21 and all(abs(x / total - M.WEIGHTS.get(s, 1) / 26) < 0.02 for s, x in size.items())
    assert abs(total / sum(len(d[1]) for d in data) - 1) < 0.02

import random

from symgrid.llm import quality as Q

from .fixtures import EDGE_DOCS, documents, prose, rows


def test_sketch_merges_and_is_close(spark):
    rng = random.Random(0)
    values = [int(rng.lognormvariate(5, 1)) for _ in range(2000)]
    df = spark.createDataFrame([("en", f"s{i % 3}", v) for i, v in enumerate(values)], "lang string, source string, words long")
    parts = Q.sketches(df, ["lang", "source"], ["words"])
    whole = Q.quantiles(Q.merge(parts, ["lang"]), ["lang"]).first()
    exact = sorted(values)
    for p, got in ((25, whole["q1"]), (75, whole["q3"])):
        true = exact[-(-len(values) * p // 100) - 1]
        assert true - true / 32 - 1 <= got <= true
    assert whole["total"] == 2000
    assert rows(Q.merge(parts, ["lang"])) == rows(Q.sketches(df, ["lang"], ["words"]))


def test_adapts_to_language_and_source(spark):
    rng = random.Random(1)
    plain = [(i, prose(rng, 100)) for i in range(60)]
    loud = [(100 + i, prose(rng, 100).upper()) for i in range(60)]
    a = documents(spark, [*plain, (99, prose(rng, 100).upper())], source="a")
    b = documents(spark, loud, source="b")
    kept = {r["doc_id"] for r in Q.quality_filter(a.unionByName(b)).collect()}
    assert kept == {i for i, _ in plain + loud}  # capitals are usual in b alone


def test_rejects_junk_keeps_clean(spark):
    rng = random.Random(2)
    clean = [(i, prose(rng, rng.randint(5, 400)).capitalize() + ".") for i in range(300)]
    junk = [(1000, "buy " * 300), (1001, " ".join(w + "###" for w in prose(rng, 80).split())), (1002, " | ".join(prose(rng, 80).split())), (1003, "x" * 5000)]
    kept = {r["doc_id"] for r in Q.quality_filter(documents(spark, clean + junk)).collect()}
    assert kept == {i for i, _ in clean}


def test_edge_cases(spark):
    docs = EDGE_DOCS(spark)
    got = Q.quality_filter(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(3) == 2 and {4, 5, None} <= set(ids)  # repeated rows and null ids are judged like others
    assert not {1, 2, 6} & set(ids)  # null, empty and blank texts go
    nulls = documents(spark, [(1, "some words here")], lang=None, source=None)
    assert [r["doc_id"] for r in Q.quality_filter(nulls).collect()] == [1]
    assert Q.quality_filter(documents(spark, [])).count() == 0

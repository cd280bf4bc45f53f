import random
import re
from collections import Counter

import pytest

from symgrid.llm import bpe, mixing, quality, secrets
from symgrid.llm.common import components

from .fixtures import DOCS, EDGE_DOCS, documents, prose
from .test_mixing import brute as brute_mix
from .test_simhash import brute as brute_pairs, groups

pipeline = pytest.importorskip("corpus_pipeline")


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = groups({(a, b) for a, b in edges if a is not None and a != b})
    assert got == want


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    kept = {r["doc_id"] for r in quality.quality_filter(docs).collect()}
    by_id = {r["doc_id"]: r for r in docs.collect()}
    ids = sorted(kept)
    pairs = {(ids[i], ids[j]) for i, j in brute_pairs([by_id[i]["text"] for i in ids])}
    lost = {x for x, r in groups(pairs).items() if x != r}
    left = [i for i in ids if i not in lost]
    text = {i: secrets.redact_text(by_id[i]["text"]) for i in left}
    size = Counter()
    for i in left:
        size[by_id[i]["source"]] += len(text[i])
    total = sum(size.values())
    weight = {s: mixing.WEIGHTS.get(s, 1.0) for s in size}
    rates = {s: int(float(total) * (weight[s] / sum(weight.values())) / float(n) * mixing.UNIT) for s, n in size.items()}
    want = brute_mix(((i, by_id[i]["source"]) for i in left), rates)
    got = pipeline.run(spark, DOCS).collect()
    assert Counter(r["doc_id"] for r in got) == want
    with open(bpe.VOCABULARY, "rb") as f:
        coder = bpe.ForcedBoundaryBPE(f.read())
    assert all(coder.decode(r["ids"]).decode() == text[r["doc_id"]] for r in got)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "simhash near-dedup", "secret scan", "source mixing", "bpe"]
    for _, f in pipeline.STAGES[:-1]:
        out = f(spark, docs, DOCS)
        assert out.dtypes == docs.dtypes
        docs = out


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(pipeline.__file__).parent
    for p in root.glob("symgrid/**/*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p




def test_edge_cases(spark, tmp_path):
    """Null ids, null, empty, blank, wordless and very long texts, ties, repeated rows and clashing names in every stage."""
    docs = EDGE_DOCS(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    for _, f in pipeline.STAGES[:-1]:
        at = f(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    got = pipeline.run(spark, str(tmp_path)).collect()
    # 1, 2, 6: no words; 7: unlike all others; 4 and 8 are copies of 3, as is its repeated row
    assert {r["doc_id"] for r in got} >= {3, 5} and not {1, 2, 6, 4, 8} & {r["doc_id"] for r in got}
    assert all(r["exact"] for r in got) and max(r["n_tokens"] for r in got) > 30_000


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_decisions_take_effect(spark, tmp_path):
    rng = random.Random(2)
    base = [(i, prose(rng, 80)) for i in range(120)]
    near = [(200 + i, base[i][1] + " indeed") for i in range(5)]
    secret = [(300, prose(rng, 60) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + prose(rng, 20))]
    documents(spark, base + near + secret + [(400, "buy " * 500)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in base} | {300}
    with open(bpe.VOCABULARY, "rb") as f:
        coder = bpe.ForcedBoundaryBPE(f.read())
    assert "[secret: named-hex-secret]" in coder.decode(got[300]["ids"]).decode()

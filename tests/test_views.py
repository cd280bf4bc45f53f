"""Token store, surfaces and views over the driver's tables."""

import pytest
from pyspark.sql import functions as F

from symgrid.codemap import SERVICES, from_tables
from symgrid.operators import lookup as L, metrics as M, resolve as R, search, services as V
from symgrid.sources import surfaces as U, tokens as K
from symgrid.views import text as W

DIR = "/root/testdata/sf0.001"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def shown(df):
    return [r["line"] for r in df.orderBy("ord").collect()]


def test_token_store(spark):
    entries = spark.createDataFrame([(f"e{i:02}", "word " * i + "äö\n") for i in range(40)] + [("empty", ""), ("null", None)], "name string, text string")
    store = K.encode_entries(entries, VOCABULARY)
    rows = sorted(store.collect(), key=lambda r: r["name"])
    at = 0
    for r in rows:
        assert (r["offset"], r["n"]) == (at, len(r["ids"]))
        at += r["n"]
    K.checked(store)
    assert K.not_round(entries, store, VOCABULARY).count() == 0
    assert K.not_round(entries.where("name <> 'e05'"), store, VOCABULARY).collect()[0]["name"] == "e05"
    assert K.decode_entries(store, VOCABULARY, ["e03"]).first()["text"] == "word word word äö\n"
    for broken in (store.withColumn("version", F.lit(9)), store.where("name <> 'e07'"), store.withColumn("n", F.col("n") + 1)):
        with pytest.raises(ValueError):
            K.checked(broken)


def test_surfaces(spark, monkeypatch):
    m = from_tables(spark, DIR)
    own = U.surface(m, "here", V.members(m, SERVICES))
    text = own.first()["json"]
    peers = spark.createDataFrame([("a", text), ("b", "{}"), ("c", None), ("d", '{"schema": 7}'), ("e", "nonsense")], "peer string, json string")
    provides, consumes, errors = U.read_surfaces(peers)
    assert provides.count() == m.annotations.where("boundary = 'serves'").join(m.files, "file_id").count()
    assert consumes.count() == m.annotations.where("boundary = 'calls'").join(m.files, "file_id").count()
    assert {r["peer"]: r["error"] for r in errors.collect()} == {"b": "not a surface", "c": "no surface", "d": "schema 7 is not read", "e": "not a surface"}
    sites = R.crossing_sites(m, V.members(m, SERVICES), provides.limit(50), consumes.limit(50))
    assert sites.where("external and dst = 'a'").count() > 0 and sites.where("external and src = 'a'").count() > 0
    monkeypatch.setenv("TOKEN_X", "t")
    assert U.bearer("env:TOKEN_X") == "t" and U.bearer(None) is None
    with pytest.raises(ValueError):
        U.bearer("literal")


def test_views(spark):
    m = from_tables(spark, DIR)
    counts = L.file_counts(m)
    lines = shown(W.index(counts))
    assert len(lines) == counts.count() + 2 and lines[0].startswith("| path | language |") and lines[1].count("---") == lines[0].count("|") - 1
    found = search.find(m, "f1")
    assert len(shown(W.hits(found, m.files))) == found.join(m.files, "file_id").count() + 1
    refs = shown(W.references(L.definitions(m, "f7"), L.references(m, "f7"), "f7"))
    assert refs[0].startswith("f7: ") and any(" in " in x for x in refs)
    assert shown(W.notes(search.notes_by_marker(m, "todo"), m.files))[0] == "notes"
    lint = spark.createDataFrame([("many-params", "info", 1, "a.py", 3, 7), ("leak-risk", "warn", 2, "b.py", 1, 1)], "rule string, severity string, node_id long, path string, line int, value long")
    assert shown(W.lints(lint)) == ["findings", "warn leak-risk b.py:1 (1)", "info many-params a.py:3 (7)"]
    assert M.lints_of(lint, "leak-risk").count() == 1
    with pytest.raises(ValueError):
        M.lints_of(lint, "nope")
    run = spark.createDataFrame([("t1", "a.py", 1, "python", 1, "f"), ("t0", "a.py", 9, "python", 0, "g")], "test string, file string, line int, language string, distance int, covers string")
    commands = spark.createDataFrame([("python", "pytest -k x", 2), ("rust", "c" * 1300, 300)], "language string, command string, selects long")
    assert shown(W.triggers(run, commands)) == ["tests to run", "  pytest -k x", "  rust: 300 tests, too many for one command", "  0 a.py:9 t0 covers g", "  1 a.py:1 t1 covers f"]
    tg = spark.createDataFrame([("a::f", "perf-test", "smoke-test", 9, False, "deep"), ("a::g", "smoke-test", "", 11, True, "")], "id string, kind string, also string, priority long, covered boolean, why string")
    assert shown(W.targets(tg)) == ["targets", "11 smoke-test a::g", "9 perf-test a::f (untested): deep"] and len(shown(W.targets(tg, "smoke-test"))) == 3 and len(shown(W.targets(tg, "perf-test"))) == 2
    edges = spark.createDataFrame([("x", "y", True, False)], "src string, dst string, declared boolean, detected boolean")
    roll = spark.createDataFrame([("x", 2, 3), ("z", 1, 1), (None, 4, 4)], "service string, files long, funcs long")
    assert shown(W.services(roll, edges)) == ["services", "  x: 2 file(s), 3 function(s)", "  z: 1 file(s), 1 function(s)", "  x -> y declared"]
    assert shown(W.services(roll, edges, "z")) == ["services", "  z: 1 file(s), 1 function(s)"]
    assert shown(W.table(spark.createDataFrame([("a|b\nc", None)], "x string, y string"), ["x", "y"], "x")) == ["| x | y |", "| --- | --- |", "| a\\|b c |  |"]
    path = m.files.orderBy("path").first()["path"]
    entry = shown(W.file_entry(m, path))
    assert entry[0] == path and any(" func " in x for x in entry)
    assert shown(W.table(counts.limit(0), ["path"], "path")) == ["| path |", "| --- |"]

"""Small maps by hand, each with what must come of it."""

import pytest

from symgrid.codemap import CodeMap
from symgrid.operators import calls as C, graph as G, resolve as R, services as V
from symgrid.schema import SCHEMAS, TOP


def make(spark, **rows):
    """Tables from dictionaries; fields that are not given are null, or false for flags."""
    tables = {}
    for name, own in rows.items():
        fields = [f.split(" ", 1) for f in SCHEMAS[name].split(", ")]
        zero = {"boolean": False, "array<string>": []}
        tables[name] = spark.createDataFrame([tuple(r.get(f, zero.get(t)) for f, t in fields) for r in own], SCHEMAS[name])
    m = CodeMap(spark, tables, derive_refs=True)
    m.tables["refs"] = C.same_file_refs(m)
    return m


def func(file_id, ord_, name, start, end, **more):
    return {"file_id": file_id, "ord": ord_, "node_id": file_id * 100 + ord_, "line": start, "name": name, "start_line": start, "end_line": end} | more


def file(file_id, path, language="rust", typed=True):
    return {"file_id": file_id, "path": path, "language": language, "family": language, "is_typed": typed, "lines": 99}


def edges(m):
    return {(r["src"], r["dst"]): r["sites"] for r in C.call_edges(m).collect()}


def test_two_files_and_an_import(spark):
    m = make(
        spark, files=[file(1, "src/lib.rs"), file(2, "src/main.rs")], funcs=[func(1, 0, "helper", 1, 2), func(1, 1, "charge", 4, 6), func(2, 0, "main", 3, 9)],
        calls=[{"file_id": 1, "caller": "charge", "line": 5, "name": "helper"}, {"file_id": 2, "caller": "main", "line": 4, "name": "charge"}], imports=[{"file_id": 2, "line": 1, "module": "crate::lib", "names": ["charge"]}],
    )
    assert edges(m) == {(101, 100): 1, (200, 101): 1}


def test_ambiguous_names_make_no_edge(spark):
    m = make(spark, files=[file(1, "a.rs"), file(2, "b.rs"), file(3, "c.rs")], funcs=[func(1, 0, "run", 1, 2), func(2, 0, "run", 1, 2), func(3, 0, "go", 1, 9)], calls=[{"file_id": 3, "caller": "go", "line": 2, "name": "run"}])
    assert edges(m) == {}


@pytest.mark.parametrize("typed,evident,sites", [(3, [9], 2), (9, [3], 1), (3, [], 1), (5, [5], 1), (4, [6, 8], 3)])
def test_typed_calls_count_where_they_come_first(spark, typed, evident, sites):
    calls = [{"file_id": 2, "caller": "f", "line": typed, "name": "charge", "recv_type": "Client"}] + [{"file_id": 2, "caller": "f", "line": x, "name": "charge", "qualifier": "money"} for x in evident]
    m = make(spark, files=[file(1, "money.rs"), file(2, "b.rs")], funcs=[func(1, 0, "charge", 1, 2, owner="Client"), func(2, 0, "f", 1, 20)], calls=calls)
    assert edges(m) == {(200, 100): sites}


def test_innermost_of_equal_names_calls(spark):
    m = make(spark, files=[file(1, "a.ts")], funcs=[func(1, 0, "f", 1, 30), func(1, 1, "f", 10, 20), func(1, 2, "g", 40, 41)], calls=[{"file_id": 1, "caller": "f", "line": 15, "name": "g"}, {"file_id": 1, "caller": TOP, "line": 50, "name": "g"}])
    assert edges(m) == {(101, 102): 1, (-2, 102): 1}


def test_flame_of_a_chain_and_of_recursion(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 9)], "src long, dst long")
    tree = {r["path"]: r for r in G.flame(e, spark.createDataFrame([(1,), (9,)], "node_id long")).collect()}
    assert tree["1"]["value"] == 3 and tree["9"]["value"] == 2 and tree["9,9"]["recursive"] and tree["9,9"]["truncated"]


def test_three_services(spark):
    m = make(
        spark, files=[file(1, "gateway/main.rs"), file(2, "billing/lib.rs"), file(3, "auth/lib.rs"), file(4, "tools/x.rs")], modules=[{"file_id": 2, "name": "billing"}],
        funcs=[func(1, 0, "serve", 1, 9), func(2, 0, "charge", 1, 3), func(2, 1, "refund", 5, 7), func(3, 0, "login", 1, 2)],
        calls=[{"file_id": 1, "caller": "serve", "line": 2, "name": "charge", "qualifier": "billing"}, {"file_id": 1, "caller": "serve", "line": 3, "name": "refund", "qualifier": "billing"}, {"file_id": 1, "caller": "serve", "line": 4, "name": "ok"}],
    )
    member = V.members(m, {s: [s] for s in ("gateway", "billing", "auth")})
    symbols = R.edge_symbols(m, member, R.resolved_calls(m, member))
    assert {(r["symbol"], r["via"], r["src"], r["dst"]) for r in symbols.collect()} == {("charge", "qualifier", "gateway", "billing"), ("refund", "qualifier", "gateway", "billing")}
    e = R.overlay(symbols, {"gateway": ["auth"]})
    assert {(r["dst"], r["declared"], r["detected"]) for r in e.collect()} == {("billing", False, True), ("auth", True, False)}
    got = R.impact(e, spark.createDataFrame([("billing",)], "service string")).collect()
    assert {(r["service"], r["reason"], r["path"]) for r in got} == {("billing", "changed", "billing"), ("gateway", "dependency", "billing <- gateway")}


def test_keys_meet_without_case_and_space(spark):
    note = lambda f, line, b, key, t: {"file_id": f, "line": line, "boundary": b, "key": key, "transport": t, "function": "f"}
    m = make(spark, files=[file(1, "a/x.rs"), file(2, "b/y.rs")], annotations=[note(1, 2, "calls", " Audit.Events ", "queue"), note(2, 5, "serves", "audit.events", "unspecified"), note(1, 7, "calls", "nobody", "http")])
    member = V.members(m, {"a": ["a"], "b": ["b"]})
    got = {(r["src"], r["dst"], r["line"], r["transport"], r["remote_line"], r["external"]) for r in R.crossing_sites(m, member).collect()}
    assert got == {("a", "b", 2, "queue", 5, False), ("a", "", 7, "http", None, False)}
    peers = spark.createDataFrame([("peer", "NOBODY", "http", "p.rs", 42, "h")], "peer string, key string, transport string, file string, line int, function string")
    assert ("a", "peer", 42, True) in {(r["src"], r["dst"], r["remote_line"], r["external"]) for r in R.crossing_sites(m, member, peers).collect()}

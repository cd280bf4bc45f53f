"""Operators over empty maps and maps with nulls."""

import pytest

from symgrid.codemap import CodeMap
from symgrid.operators import calls as C, coverage as T, graph as G, lookup as L, metrics as M, report as P, resolve as R, search, services as V, spans
from symgrid.schema import SCHEMAS

HUNKS = "path string, start int, stop int"


def maps(spark):
    nulls = {k: spark.createDataFrame([tuple(None for _ in v.split(", "))], v) for k, v in SCHEMAS.items()}
    return {"empty": CodeMap(spark), "nulls": CodeMap(spark, nulls)}


def results(m, spark):
    member = V.members(m, {"a": ["a/**"]})
    hunks = spark.createDataFrame([("a/x", 1, 2)], HUNKS)
    edges = C.call_edges(m)
    nodes = C.nodes(m)
    resolved = R.resolved_calls(m, member)
    symbols = R.edge_symbols(m, member, resolved)
    cyc = G.components(edges)
    yield "edges", edges
    yield "degrees", C.degrees(nodes.where("node_id is not null"), edges)
    yield "cycles", cyc
    yield "depth", G.depth_below(nodes.where("node_id is not null"), edges, cyc)
    yield "chains", G.deepest_chains(nodes, edges, cyc)
    yield "coverage", T.covering_tests(m)
    yield "symbols", symbols
    yield "unresolved", R.unresolved(m, resolved)
    yield "crossings", R.crossing_sites(m, member).where("key is not null")
    yield "impact", R.impact(symbols.select("src", "dst"), member.select("service"))
    yield "report", P.changed_report(m, hunks, member, resolved)
    yield "triggers", P.triggered_tests(m, hunks)
    yield "targets", P.test_targets(m, member)
    yield "dependencies", L.dependencies(m)
    yield "lints", M.all_lints(m, C.degrees(nodes, edges)).where("node_id is not null")
    yield "find", search.find(m, "x")
    yield "references", L.references(m, "a::x")
    yield "definitions", L.definitions(m, "a::x")
    yield "annotations", spans.bind_annotations(m).where("key is not null")
    yield "suggest", L.suggest(m, "x")


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_nothing_comes_of_nothing(spark, kind):
    for name, df in results(maps(spark)[kind], spark):
        assert df.count() == 0, name
    assert T.coverage_totals(maps(spark)[kind]).first()["tests"] == 0

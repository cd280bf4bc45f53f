"""Calls and crossings between services in numbers, without a row for each pair of sites."""

from symgrid.codemap import from_tables
from symgrid.operators import resolve as R, services as V
from symgrid.plans import registry

from .test_cases import file, func, make


def _note(f, line, boundary, key="k"):
    return {"file_id": f, "line": line, "boundary": boundary, "key": key, "transport": "unspecified" if boundary == "calls" else f"t{line}", "function": "f"}


def test_a_common_key_costs_its_calls(spark):
    notes = [_note(1, x, "calls") for x in range(30)] + [_note(2, x, "serves", " K ") for x in range(1, 31)] + [_note(3, x, "serves") for x in range(5)] + [_note(1, 99, "serves"), _note(1, 50, "calls", "lone")]
    m = make(spark, files=[file(1, "a/x.rs"), file(2, "b/y.rs"), file(3, "z.rs")], annotations=notes)
    member = V.members(m, {"a": ["a"], "b": ["b"]})
    got = R.crossing_counts(m, member).collect()
    assert len(got) == 2 * 30 + 1
    sites = R.crossing_sites(m, member)
    assert sum(max(r["n"], 1) for r in got) == sites.count() == 30 * 35 + 1 and [r["line"] for r in got if r["n"] == 0] == [50]
    none = spark.createDataFrame([], "src string, dst string, declared boolean, detected boolean, symbols long"), spark.createDataFrame([], "src string, dst string, symbol string, path string, line int, via string, kind string")
    parts = [[sorted(map(tuple, x.collect())) for x in R.merge_crossings(*none, y)] for y in (R.crossing_counts(m, member), sites)]
    assert parts[0] == parts[1] and parts[0][0] == [("a", "b", False, True, 30)] and parts[0][1][0][-1] == "t1"


def test_resolution_has_the_first_line_and_needs_no_symbols(spark):
    m = make(
        spark, files=[file(1, "a/x.rs"), file(2, "b/y.rs")], funcs=[func(1, 0, "go", 1, 9), func(2, 0, "run", 1, 2)],
        calls=[{"file_id": 1, "caller": "go", "line": x, "name": "run", "qualifier": "y"} for x in (7, 3, 5)] + [{"file_id": 1, "caller": "go", "line": 8, "name": "run"}],
    )
    got = {(r["service"], r["name"], r["qualifier"], r["line"], r["target"], r["via"], r["reason"]) for r in R.resolved_calls(m, V.members(m, {"a": ["a"], "b": ["b"]})).collect()}
    assert got == {("a", "run", "y", 3, "b", "qualifier", None), ("a", "run", None, 8, None, None, "no-evidence")}
    here = from_tables(spark, "/root/testdata/sf0.001")
    for k in ("resolved", "symbols", "members"):
        here.derived.pop(k, None)
    fixed = set(here.fixed)
    registry.QUERIES["service_resolution"](spark, "/root/testdata/sf0.001")
    assert "symbols" not in here.derived and here.fixed - fixed <= {"files", "funcs", "imports"}

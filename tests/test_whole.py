"""Nothing is left out of what a query lists."""

from pyspark.sql import functions as F

from symgrid.operators import coverage as T, report as P, services as V
from symgrid.plans import registry

from .test_cases import file, func, make


def test_all_tests_of_a_function(spark):
    n = 30
    m = make(
        spark, files=[file(1, "a/x.rs"), file(2, "a/tests/t.rs")], funcs=[func(1, 0, "run", 1, 9)] + [func(2, i, f"test_{i:02}", 10 * i + 1, 10 * i + 5) for i in range(n)],
        calls=[{"file_id": 2, "caller": f"test_{i:02}", "line": 10 * i + 2, "name": "run", "qualifier": "x"} for i in range(n)],
    )
    assert [r["rank"] for r in T.covering_tests(m).orderBy("rank").collect()] == list(range(1, n + 1))
    none = spark.createDataFrame([], "service string, name string, target string")
    hunks = spark.createDataFrame([("a/x.rs", 1, 2)], "path string, start int, stop int")
    report = P.changed_report(m, hunks, V.members(m, {"a": ["a"]}), none).where(F.col("function") == "run").first()
    assert report["tested_by"].split(",") == [f"test_{i:02}" for i in range(n)]


def test_sql_has_no_cap():
    assert "rank <=" not in registry.SQL["covering_tests"] + registry.SQL["changed_report"]

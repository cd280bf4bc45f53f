"""Trees, diffs, manifests and the extraction of Python source."""

import os

import pytest

from symgrid.extract import build, python as P
from symgrid.operators import calls as C, coverage as T, graph as G, lookup as L, metrics as M
from symgrid.sources import diffs as D, tree as S

MONEY = '''import os
from pkg.rates import Rate, convert

RATE_MAX = 10
limit = 3


class Client:
    """Talks to the bank."""

    def charge(self, amount: int, rate: "Rate" = None) -> int:
        # TODO(me): retries
        for i in range(3):
            for j in [x for x in range(2)]:
                if i > j:
                    self.log(amount)
                elif i:
                    pass
        return convert(amount)

    # map: calls queue bank.charged
    def log(self, what):
        with open("log") as f:
            f.write(what)
        g = open("other")


def fact(n):
    return n * fact(n - 1) if n else 1


c = Client()
c.charge(1)
'''
RATES = "class Rate:\n    A = 1\n\n\ndef convert(x):\n    return x\n"
TESTS = "from pkg.money import Client, fact\nfrom pkg import rates\n\n\ndef test_charge():\n    c = Client()\n    c.charge(2)\n    fact(3)\n    rates.convert(1)\n    os.getcwd()\n"


@pytest.fixture(scope="module")
def code(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    files = {
        "pkg/money.py": MONEY, "pkg/rates.py": RATES, "tests/test_money.py": TESTS, "broken.py": "def f(:\n", "notes.txt": "x", ".hidden/a.py": "a=1", "build/b.py": "b=1", "gen/skip.py": "c=1", "gen/keep.py": "d=1", "a/x-y.py": "e=1", "a-x/y.py": "f=1", "big.py": "x = 1\n" * 400_000,
        ".gitignore": "# generated\n/gen/*\n!keep.py\n*.tmp\n",
    }
    for p, t in files.items():
        os.makedirs(root / os.path.dirname(p), exist_ok=True)
        (root / p).write_text(t)
    (root / "latin.py").write_bytes(b"x = '\xff'\n")
    return str(root)


def test_tree(spark, code):
    got = {r["path"]: r for r in S.read_tree(spark, code).collect()}
    assert set(got) == {"pkg/money.py", "pkg/rates.py", "tests/test_money.py", "broken.py", "gen/keep.py", "a/x-y.py", "a-x/y.py"}
    assert got["pkg/rates.py"]["content"] == RATES and got["pkg/rates.py"]["language"] == "python"
    named = {r["path"]: r for r in S.with_names(S.read_tree(spark, code)).collect()}
    assert sorted(r["file_id"] for r in named.values()) == list(range(7))
    assert [p for p, _ in sorted(named.items(), key=lambda x: x[1]["file_id"])] == sorted(named)
    assert named["pkg/money.py"]["cache_name"] == "pkg-money.py.md"
    assert len({r["cache_name"] for r in named.values()}) == 7 and named["a/x-y.py"]["cache_name"] != "a-x-y.py.md"


def test_ignore_lines():
    import re

    fits = lambda line, path: re.search(S.ignore_regex(line)[0], path) is not None
    assert S.ignore_regex("# no") is None and S.ignore_regex("  ") is None and S.ignore_regex("!a")[1]
    assert fits("*.log", "a/b.log") and not fits("/*.log", "a/b.log") and fits("doc/", "x/doc/a") and not fits("doc/", "doc")
    assert fits("a/**/b", "a/x/y/b") and fits("a/**/b", "a/b") and fits("[!a]x", "bx") and not fits("[!a]x", "ax")


def test_map_of_a_tree(spark, code):
    m = build.from_tree(spark, code)
    funcs = {r["name"]: r for r in m.funcs.collect()}
    assert set(funcs) == {"charge", "log", "fact", "convert", "test_charge"}
    charge = funcs["charge"]
    assert (charge["owner"], charge["params"], charge["branches"], charge["ret"], charge["recursive"]) == ("Client", 3, 2, "int", False)
    assert charge["param_types"] == ["int", '"Rate"'] and funcs["fact"]["recursive"] and funcs["test_charge"]["test_ctx"]
    loops = sorted((r["depth"], r["kind"], r["trip"]) for r in m.loops.collect())
    assert loops == [(1, "for", 3), (2, "for", None), (3, "comprehension", 2)]
    assert sorted((r["name"], r["acquire"], r["guarded"]) for r in m.resources.collect()) == [("open", True, False), ("open", True, True)]
    assert sorted(r["name"] for r in m.consts.collect()) == ["RATE_MAX"]
    assert {(r["name"], r["kind"]) for r in m.types.collect()} == {("Client", "class"), ("Rate", "class")}
    assert [r["text"] for r in m.notes.collect()] == ["TODO(me): retries"]
    a = m.annotations.first()
    assert (a["boundary"], a["transport"], a["key"], a["function"]) == ("calls", "queue", "bank.charged", "log")
    assert {(r["module"], tuple(r["names"])) for r in m.imports.collect()} >= {("os", ()), ("pkg.rates", ("Rate", "convert")), ("pkg", ("rates",))}
    name = {r["node_id"]: r["name"] for r in C.nodes(m).collect()}
    edges = {(name[r["src"]], name[r["dst"]]) for r in C.call_edges(m).collect()}
    assert edges == {("charge", "log"), ("charge", "convert"), ("fact", "fact"), ("<top>", "charge"), ("test_charge", "charge"), ("test_charge", "fact"), ("test_charge", "convert")}
    tests = {(name[r["node_id"]], r["evidence"]) for r in T.covering_tests(m).collect()}
    assert tests == {("charge", "receiver-type"), ("fact", "import"), ("convert", "qualifier")}
    assert {r["path"]: r["funcs"] for r in L.file_counts(m).collect()}["pkg/money.py"] == 3
    deps = {(r["src"], r["dst"]) for r in L.dependencies(m).collect()}
    ids = {r["path"]: r["file_id"] for r in m.files.collect()}
    assert (ids["pkg/money.py"], ids["pkg/rates.py"]) in deps and (ids["tests/test_money.py"], ids["pkg/money.py"]) in deps
    lints = {(r["rule"], name[r["node_id"]]) for r in M.all_lints(m, C.degrees(C.nodes(m), C.call_edges(m))).collect()}
    assert ("deep-loop-nest", "charge") in lints and ("unroll-candidate", "charge") in lints and ("leak-risk", "log") in lints


def test_files_that_do_not_parse():
    assert P.extract("def f(:") is None and P.extract("x = '\0'") is None
    assert P.extract("") == {k: [] for k in ("funcs", "loops", "resources", "calls", "uses", "imports", "consts", "types", "notes", "annotations")}
    assert P.extract("(" * 50_000) is None


def test_annotations():
    assert P.parse_annotation("map: serves grpc  pay.v1 ") == ("serves", "grpc", "pay.v1")
    assert P.parse_annotation("x map: Uses orders table") == ("calls", "unspecified", "orders table")
    assert P.parse_annotation("map: serves http") is None and P.parse_annotation("xmap: serves a") is None and P.parse_annotation("map: eats a b") is None


def test_hunks_and_status(spark):
    diff = 'diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@ def f\n+a\n@@ -9 +12 @@\n@@ -20,3 +19,0 @@\n--- a/gone.py\n+++ /dev/null\n@@ -1,5 +0,0 @@\n--- a/y\n+++ "b/y z.py"\n@@ -0,0 +1,7 @@\n'
    df = spark.createDataFrame([(diff,), (None,)], "diff string")
    assert sorted(tuple(r) for r in D.read_hunks(df).collect()) == [("x.py", 3, 6), ("x.py", 12, 12), ("x.py", 19, 19), ("y z.py", 1, 7)]
    raw = spark.createDataFrame([("M\0a.py\0R100\0old.py\0new.py\0C75\0b.py\0c.py\0T\0t\0U\0u\0D\0d",)], "raw string")
    got = [tuple(x) for x in raw.select(D.name_status("raw")).first()[0]]
    assert got == [("modified", "a.py"), ("renamed", "new.py"), ("deleted", "old.py"), ("copied", "c.py"), ("type_changed", "t"), ("changed", "u"), ("deleted", "d")]


def test_manifests(spark):
    rows = [
        ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1.0" # c\nmy-lib = { version = "2", path = "y" }\n[dev-dependencies.rand]\nversion = "3"\n'), ("web/package.json", '{"dependencies": {"left-pad": "^1"}, "devDependencies": {"jest": "29"}}'),
        ("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.3 // indirect\n)\nrequire golang.org/x/net v0.1.0\n"), ("requirements.txt", "numpy==2.0 # n\n-r other\nflask[async]>=3\nplain\n"), ("README.md", "x"),
    ]
    p = D.declared_packages(spark.createDataFrame(rows, "path string, text string"))
    got = {(r["kind"], r["name"]): r["version"] for r in p.collect()}
    assert got == {("dependencies", "serde"): "1.0", ("dependencies", "my-lib"): "2", ("dev-dependencies", "rand"): None, ("dependencies", "left-pad"): "^1", ("devDependencies", "jest"): "29", ("require", "github.com/a/b"): "v1.2.3", ("require", "golang.org/x/net"): "v0.1.0", ("requirement", "numpy"): "==2.0", ("requirement", "flask"): "[async]>=3", ("requirement", "plain"): None}
    assert [r["name"] for r in D.package_named(p, "My_Lib").collect()] == ["my-lib"]


def test_looks(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 1), ("z", 1, 1)], "path string, mtime long, size long")
    b = spark.createDataFrame([("x", 1, 1), ("y", 2, 1), ("n", 1, 1)], "path string, mtime long, size long")
    assert sorted(tuple(r) for r in S.changed_paths(a, b).collect()) == [("n", "added"), ("y", "changed"), ("z", "removed")]
    e = spark.createDataFrame([("a", "t 20240101-10-00-00"), ("b", "x"), ("c", "x")], "name string, text string")
    s = spark.createDataFrame([("a", "t 20250101-10-00-00"), ("b", "y"), ("d", "x")], "name string, text string")
    assert sorted(tuple(r) for r in S.stale_entries(e, s).collect()) == [("b", "modified"), ("c", "missing"), ("d", "stale")]


def test_cycles_chains_and_flame(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (5, 6), (6, 4), (7, 7), (7, 1), (8, 9)], "src long, dst long").selectExpr("*", "1L as sites")
    nodes = spark.range(1, 11).selectExpr("id as node_id")
    member = G.components(edges)
    assert {(r["node_id"], r["cycle"]) for r in member.collect()} == {(2, 3), (3, 3), (4, 6), (5, 6), (6, 6)}
    assert [(r["cycle"], r["size"], r["members"]) for r in G.cycles(member).collect()] == [(6, 3, "4,5,6"), (3, 2, "2,3")]
    depth = {r["node_id"]: r["depth"] for r in G.depth_below(nodes, edges, member).collect()}
    assert depth == {1: 2, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 3, 8: 1, 9: 0, 10: 0}
    assert [(r["root"], r["chain"]) for r in G.deepest_chains(nodes, edges, member).collect()] == [(7, "7,1,3,6"), (8, "8,9")]
    tree = {r["path"]: r for r in G.flame(edges, spark.createDataFrame([(1,), (8,)], "node_id long"), depth=3).collect()}
    assert set(tree) == {"1", "1,2", "1,2,3", "1,2,3,2", "1,2,3,4", "8", "8,9"}
    assert tree["1"]["value"] == 5 and tree["1,2,3,2"]["recursive"] and tree["1,2,3,4"]["truncated"] and not tree["8"]["truncated"]
    assert G.flame(edges, spark.createDataFrame([(1,), (8,)], "node_id long"), nodes=4).count() == 4
    assert G.components(edges.limit(0)).count() == 0

"""Scalar functions and predicates by examples, nulls included."""

import datetime

import pytest
from pyspark.sql import functions as F

from symgrid.functions import predicates as P, scalars as S


def values(spark, f, cases):
    """``f`` over all keys of ``cases`` at once."""
    keys = list(cases)
    width = len(keys[0]) if isinstance(keys[0], tuple) else 1
    rows = [(i, *(k if isinstance(k, tuple) else (k,))) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"c{j} string" for j in range(width)))
    got = {r["i"]: r["v"] for r in df.select("i", f(*[F.col(f"c{j}") for j in range(width)]).alias("v")).collect()}
    return {k: got[i] for i, k in enumerate(keys)}


CASES = {
    "one_line": (S.one_line, {" a\n\t b ": "a b", "": "", "x": "x"}),
    "truncate": (lambda c: S.truncate(c, 4), {"abcd": "abcd", "abcde": "abc…", "äöüßx": "äöü…", "": ""}),
    "strip_comment": (S.strip_comment, {"// a": "a", "/* a\n * b\n */": "a b", "# TODO: x": "TODO: x", "/// doc\n//! more": "doc more", "<!-- h -->": "h"}),
    "is_shouting": (S.is_shouting, {"MAX_1": True, "Max": False, "__": False, "A": True, "1": False}),
    "split_qualified": (lambda c: F.concat_ws("|", F.coalesce(S.split_qualified(c)["qualifier"], F.lit("-")), S.split_qualified(c)["name"]), {"a::b::c": "a::b|c", "a.b": "a|b", "c": "-|c"}),
    "split_query": (lambda c: F.concat_ws("|", F.coalesce(S.split_query(c)["qualifier"], F.lit("-")), S.split_query(c)["name"], S.split_query(c)["under"].cast("string")), {"clap::": "clap||true", "client.": "client||true", "a::b": "a|b|false", "b": "-|b|false"}),
    "edit_distance": (lambda a, b: S.edit_distance(a, b, 2), {("abc", "abd"): 1, ("abc", "xyz"): None, ("", "ab"): 2, ("same", "same"): 0}),
    "name_distance": (S.name_distance, {("Foo", "foo"): 0, ("foo", "foobar"): 1003, ("f", "f" * 3000): 1999, ("client", "cleint"): 2002, ("abc", "xyz"): None}),
    "short_hash": (S.short_hash, {"": "84222325"}),
    "cache_name": (S.cache_name, {"src/a/b.rs": "src-a-b.rs.md", "Makefile": "Makefile.txt.md", "a b/c-d.py": "a_b-c_d.py.md"}),
    "display_name": (S.display_name, {"src/a.rs": "a.rs.md", ".env": ".env.txt.md"}),
    "strip_stamp": (S.strip_stamp, {"made 20240131-23-59-59 UTC": "made  UTC", "x": "x"}),
    "norm_key": (S.norm_key, {" Topic.A ": "topic.a", "": ""}),
    "pick_transport": (S.pick_transport, {("unspecified", "http"): "http", ("queue", "http"): "queue", ("unspecified", "unspecified"): "unspecified"}),
    "via_rank": (S.via_rank, {"annotation": 0, "receiver-type": 1, "type-reference": 5, "name-only": 6, "?": 6}),
    "status_label": (S.status_label, {"A": "added", "M": "modified", "D": "deleted", "R100": "renamed", "C75": "copied", "T": "type_changed", "U": "changed", "X": "changed"}),
    "toml_version": (S.toml_version, {'a = "1.2"': "1.2", 'a = { version = "3", x = "y" }': "3", 'a = { path = "../b" }': None}),
    "url_decode": (S.url_decode, {"a%20b+c": "a b c", "plain": "plain", "%zz": None}),
    "target_id": (S.target_id, {("a/b.rs", "f"): "a/b.rs::f"}),
    "facade_name": (lambda c: S.facade_name(c, F.lit("proj")), {"pkg/__init__.py": "pkg", "a/mod.rs": "a", "mod.rs": None, "src/lib.rs": "proj", "web/index.ts": "index", "x/y.go": "y"}),
    "normalize_type": (S.normalize_type, {"&mut Option<billing::Client<'a>>": "Client", "Vec<Box<dyn Shape>>": "Shape", ": Promise<User[]>": "User", "[]Item": "Item", "const Foo *": "Foo *", "Result<T3, Error>": "T3", "HashMap<K, V>": "HashMap", "std::shared_ptr<a::B>": "B", "": ""}),
    "is_test_path": (P.is_test_path, {"src/tests/a.rs": True, "a/test_x.py": True, "a/x_test.go": True, "a/x.spec.ts": True, "a/latest.py": False, "testdata/x": True, "src/contest.rs": False}),
    "is_test_name": (P.is_test_name, {"test_a": True, "a_test": True, "TestA": True, "Testable": False, "BenchmarkX": True, 'it("works")': True, "edit": False, "__test_x": True, "a_spec": True}),
    "qualifier_matches": (P.qualifier_matches, {("a::b::c", "b::c"): True, ("a::b", "a"): False, ("b", "a::b"): False, ("x.c", "c"): True, ("x", ""): False}),
    "qualifier_under": (P.qualifier_under, {("Clap::Arg", "clap"): True, ("x::clap", "clap"): False, ("clap", "clap::arg"): False}),
    "qualifier_names": (P.qualifier_names, {("crate::billing::x", "billing"): True, ("self.bill", "billing"): False}),
    "names_project": (P.names_project, {("my_crate::a", "my-crate"): True, ("github.com/a/b/c", "github.com/a/b"): True, ("github.com/a/bc", "github.com/a/b"): False, ("x", "x"): True}),
    "in_subtree": (lambda c: P.in_subtree(c, "src/"), {"src/a": True, "src": True, "srcx/a": False, "a/src/b": False}),
    "has_marker": (P.has_marker, {"TODO: x": True, "a fixme(me): y": True, "TODO x": False, "xTODO: y": False, "note: z": True}),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_examples(spark, name):
    f, cases = CASES[name]
    assert values(spark, f, cases) == cases
    if name not in ("target_id",):  # concat_ws skips nulls
        null = tuple(None for _ in next(iter(cases))) if isinstance(next(iter(cases)), tuple) else None
        values(spark, f, {null: None})  # never fails


def test_short_hash_is_fnv_1a(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h & 0xFFFFFFFF:08x}"

    words = ["", "a", "foobar", "src/main.rs", "äöü", "x" * 300]
    assert values(spark, S.short_hash, dict.fromkeys(words)) == {w: fnv(w) for w in words}


def test_bands_arity_and_complexity(spark):
    df = spark.range(0, 40).withColumn("z", F.lit(0))
    got = [tuple(r) for r in df.select("id", S.complexity_band("id"), S.arity("id"), S.complexity("id", "z")).collect()]
    band = lambda c: next((b for top, b in S.BANDS if c <= top), 10)
    assert [g[1] for g in got] == [band(i) for i in range(40)] and [g[3] for g in got] == [i + 1 for i in range(40)]
    assert [g[2] for g in got[:4]] == ["niladic", "monadic", "dyadic", "variadic"]


def test_stamp_is_utc_whatever_the_session(spark):
    t = datetime.datetime(2024, 1, 31, 23, 59, 59, tzinfo=datetime.timezone.utc)
    df = spark.createDataFrame([(t,)], "t timestamp")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(S.utc_stamp(F.col("t"))).first()[0] == "20240131-23-59-59"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_query_parameters_and_kinds(spark):
    df = spark.createDataFrame([("http://x/y?a=1&b=c%20d&a=2#f",), ("http://x",)], "u string")
    assert [r[0] for r in df.select(S.query_params("u")).collect()] == [{"a": "2", "b": "c d"}, {}]
    assert P.checked_kind("func") == "func"
    with pytest.raises(ValueError):
        P.checked_kind("nope")


@pytest.mark.parametrize("glob,yes,no", [("svc", ["svc", "svc/a/b"], ["svcs/a", "x/svc"]), ("a/*.py", ["a/x.py"], ["a/b/x.py", "a/x.pyc"]), ("**/t", ["t", "a/b/t"], ["a/tt"]), ("a/{b,c}/?", ["a/b/x", "a/c/y"], ["a/d/x", "a/b/xy"]), ("[!a]x", ["bx"], ["ax"])])
def test_globs(glob, yes, no):
    import re

    fits = lambda p: any(re.search(r, p) for r in P.glob_regex(glob))
    assert all(map(fits, yes)) and not any(map(fits, no))

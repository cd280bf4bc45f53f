"""Which definitions tests reach, by what evidence, and how many there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..codemap import CodeMap
from ..functions.predicates import is_test_name, is_test_path, names_project
from ..functions.scalars import parent_dir, segments
from ..plans.storage import cut
from ..schema import TOP
from .calls import file_aliases, imported_definitions

#: Parts of a qualifier that point back at the caller.
RELATIVE = ("self", "Self", "this", "cls", "super", "crate")
#: Strongest first.
EVIDENCE = ("receiver-type", "same-file", "same-package", "import", "qualifier", "name-only")
MOST_TESTS = 25


def test_calls(m: CodeMap) -> DataFrame:
    """Calls from test files, in test context or by functions named as tests, with what their file is."""
    f = m.files.select("file_id", "path", "family", "language", "is_typed", "package_scoped")
    return m.calls.join(f, "file_id").where(is_test_path("path") | F.col("test_ctx") | is_test_name("caller"))


def resolved_tests(m: CodeMap, projects: list[str] | None = None) -> DataFrame:
    """``file_id, name, qualifier, recv_type, outside, dst, evidence``: what each kind of test call reaches.

    One row for each definition reached; a call that reaches none has one row with a null ``dst``, and
    ``outside`` says that it leaves the project (a receiver or qualifier that the project doesn't know).
    The rungs are tried in order: all methods of the receiver's type; without a qualifier all
    definitions of the name in the same file, in the same package, the one imported, the only one of an
    untyped language; with one, the only definition whose file it names. Only definitions of the same
    language family count. Calls of one (file, name, qualifier, receiver) resolve alike and are resolved once.
    """
    if "tests" in m.derived:
        return m.derived["tests"]
    m.fix("files", "funcs", "calls", "imports")
    key = ["file_id", "name", "qualifier", "recv_type"]
    calls = cut(test_calls(m))
    types = m.types.select("name").unionByName(m.funcs.where("owner is not null").select(F.col("owner").alias("name"))).distinct()
    aliases = cut(file_aliases(m))
    k = calls.select(*key, "path", "family", "is_typed", "package_scoped").distinct().withColumn("k", F.monotonically_increasing_id())
    k = k.withColumn("segs", F.coalesce(F.filter(segments("qualifier"), lambda x: ~x.isin(*RELATIVE)), F.array().cast("array<string>")))
    k = k.join(types.select(F.col("name").alias("recv_type"), F.lit(True).alias("own_type")), "recv_type", "left")
    named = k.select("k", F.explode("segs").alias("alias")).join(aliases.select("alias").distinct(), "alias", "left_semi").select("k", F.lit(True).alias("inside")).distinct()
    k = k.join(named, "k", "left")
    inside = F.coalesce("inside", F.lit(False))
    for p in projects or []:
        inside = inside | F.array_contains("segs", p) | F.coalesce(names_project("qualifier", F.lit(p)), F.lit(False))
    foreign = (F.col("recv_type").isNotNull() & F.col("own_type").isNull())
    k = cut(k.withColumn("inside", inside).withColumn("foreign", foreign))
    d = m.funcs.join(m.files.select("file_id", "family", "path"), "file_id").select("name", "family", F.col("file_id").alias("target"), F.col("node_id").alias("dst"), "owner", parent_dir("path").alias("dir"))
    near = F.size("segs") == 0
    cand = k.where("not foreign").withColumn("own_dir", parent_dir("path")).join(d, ["name", "family"])
    # the one file that the name was imported from; an import counts only where it leaves one
    bound = imported_definitions(m, k.select("file_id", "name", "family").distinct(), d.select("name", "family", "target"))
    bound = bound.groupBy("file_id", "name", "family").agg(F.min("target").alias("target"), F.max("target").alias("to"), F.max("many").alias("many")).where("target = `to` and not many")
    cand = cand.join(bound.select("file_id", "name", "family", "target", F.lit(True).alias("imported")), ["file_id", "name", "family", "target"], "left")
    per_file = aliases.groupBy(F.col("file_id").alias("target")).agg(F.collect_list("alias").alias("aliases"))
    cand = cand.join(per_file, "target", "left")
    flag = lambda c, n: F.coalesce(c, F.lit(False)).alias(n)
    cand = cut(
        cand.select("k", "dst", "inside", "is_typed", near.alias("near"), flag(F.col("owner") == F.col("recv_type"), "method"), flag(F.col("target") == F.col("file_id"), "same_file"), flag(F.col("package_scoped") & (F.col("dir") == F.col("own_dir")), "same_dir"), flag(F.col("imported"), "imported"), flag(F.arrays_overlap("segs", "aliases"), "named"))
    )
    n = cand.groupBy("k").agg(*[F.count(F.when(F.col(c), 1)).alias(f"n_{c}") for c in ("method", "same_file", "same_dir", "imported", "named")], F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("inside", "near", "is_typed")])
    c = F.col
    rung = F.when(c("n_method") > 0, 0).when(~c("near") & ~c("inside"), F.lit(None))
    rung = rung.when(c("near") & (c("n_same_file") > 0), 1).when(c("near") & (c("n_same_dir") > 0), 2).when(c("near") & (c("n_imported") == 1), 3).when(c("near") & ~c("is_typed") & (c("n") == 1), 5).when(~c("near") & (c("n_named") == 1), 4)
    hit = cand.join(n.select("k", rung.alias("rung")).where("rung is not null"), "k")
    of = F.when(c("rung") == 0, c("method")).when(c("rung") == 1, c("same_file")).when(c("rung") == 2, c("same_dir")).when(c("rung") == 3, c("imported")).when(c("rung") == 4, c("named")).otherwise(True)
    hit = hit.where(of).select("k", "dst", c("rung").alias("evidence"), F.lit(True).alias("hit"))
    # a method of the receiver's type is inside whatever the qualifier says
    out = k.join(hit, "k", "left").withColumn("outside", c("foreign") | (c("hit").isNull() & ~near & ~c("inside")))
    m.derived["tests"] = cut(out.select(*key, "outside", "dst", "evidence"))
    return m.derived["tests"]


def _with_calls(m: CodeMap) -> DataFrame:
    r = resolved_tests(m)
    c = test_calls(m).select("file_id", "path", "language", "caller", "line", "name", "qualifier", "recv_type")
    same = [c[x].eqNullSafe(r[x]) for x in ("qualifier", "recv_type")]
    return c.join(r, (c["file_id"] == r["file_id"]) & (c["name"] == r["name"]) & same[0] & same[1]).select(c["file_id"], "path", "language", "caller", "line", "outside", "dst", "evidence")


def covering_tests(m: CodeMap, most: int | None = None) -> DataFrame:
    """``node_id, test, file, line, language, evidence, rank``: all tests that reach each definition (or ``most`` of them), strongest first.

    A test is known by name, file and the line of its first definition (of the call where the file
    defines none); its strongest evidence counts. Calls from the top level name no test.
    """
    first = m.funcs.groupBy("file_id", F.col("name").alias("caller")).agg(F.min_by("line", "node_id").alias("at"))
    hits = _with_calls(m).where((F.col("caller") != TOP) & F.col("dst").isNotNull()).join(first, ["file_id", "caller"], "left")
    one = hits.groupBy(F.col("dst").alias("node_id"), F.col("caller").alias("test"), F.col("path").alias("file"), F.coalesce("at", "line").alias("line"), "language").agg(F.min("evidence").alias("rung"))
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy("rung", "file", "test", "line"))
    one = one.withColumn("rank", rank)
    if most:
        one = one.where(F.col("rank") <= most)
    return one.select("node_id", "test", "file", "line", "language", F.element_at(F.array(*map(F.lit, EVIDENCE)), F.col("rung") + 1).alias("evidence"), "rank")


def covered(m: CodeMap) -> DataFrame:
    """``node_id, by_test``: definitions that a test reaches, or only a test file's top level (``by_test`` false)."""
    return _with_calls(m).where("dst is not null").groupBy(F.col("dst").alias("node_id")).agg(F.max(F.col("caller") != TOP).alias("by_test"))


def coverage_totals(m: CodeMap) -> DataFrame:
    """``tests, external_calls, unresolved_calls, covered, touched``: one row."""
    c = test_calls(m).where(F.col("caller") != TOP).select(F.count_distinct("file_id", "caller").alias("tests"))
    per_call = _with_calls(m)
    # a call has a row for each definition it reaches; one that reaches none has a single row
    e = per_call.select(F.count(F.when(F.col("outside"), 1)).alias("external_calls"), F.count(F.when(~F.col("outside") & F.col("dst").isNull(), 1)).alias("unresolved_calls"))
    d = covered(m).select(F.count(F.when(F.col("by_test"), 1)).alias("covered"), F.count(F.when(~F.col("by_test"), 1)).alias("touched"))
    return c.crossJoin(e).crossJoin(d)

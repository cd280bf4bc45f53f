"""What to test: targets by structure, triggers of a change, commands, and the change report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..codemap import CodeMap
from ..functions.scalars import target_id
from ..plans.storage import cut
from . import calls as C, coverage as T, graph as G, metrics as M, spans

MOST_TARGETS, MOST_NAMED, MOST_COVERS = 60, 10, 8
#: In the order that breaks ties.
KINDS = ("perf-test", "integration-test", "contract-test", "load-test", "smoke-test")


def hot_cut(degrees: DataFrame) -> DataFrame:
    """``hot``: the call sites that put a node in the top tenth of those called, 3 at least; no row is hot if none is called."""
    w = Window.orderBy("call_sites")
    # counts of equal numbers first: the windows hold one row for each number of call sites
    n = degrees.where("call_sites > 0").groupBy("call_sites").agg(F.count(F.lit(1)).alias("n"))
    c = n.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy())})
    return c.where(F.col("upto") > F.floor(F.col("total") * 9 / 10)).agg(F.greatest(F.min("call_sites"), F.lit(3)).alias("hot"))


def test_targets(m: CodeMap, member: DataFrame, pinned: DataFrame | None = None, most: int = MOST_TARGETS) -> DataFrame:
    """``node_id, id, service, kind, also, priority, covered, pinned, why, semantics``: functions that a test would help most.

    Five kinds of test are scored and the strongest is named, others within 40 % of it under ``also``.
    Test code, module frames and trivial leaves that nothing calls or covers are left out, unless ``pinned``
    (node_id). The first ``most`` by priority and node are kept, and all pinned ones. A function's service
    is the first of its file.
    """
    edges = C.call_edges(m)
    nodes = C.nodes(m)
    deg = C.degrees(nodes, edges)
    depth = G.depth_below(nodes, edges, _cycles(m, edges))
    own = member.groupBy("file_id").agg(F.min("service").alias("service"))
    at = cut(nodes.join(own, "file_id", "left").select("node_id", "service"))
    cross = edges.join(at.select(F.col("node_id").alias("src"), F.col("service").alias("from")), "src").join(at.select(F.col("node_id").alias("dst"), "service"), "dst")
    cross = cross.where("`from` is not null and (service is null or service <> `from`)").groupBy(F.col("dst").alias("node_id")).agg(F.count_distinct("from").alias("services"), F.count(F.lit(1)).alias("cross"))
    res = m.resources.groupBy("node_id").agg(F.count(F.lit(1)).alias("resources"), F.count(F.when(F.col("acquire"), 1)).alias("acquires"))
    f = M.metrics(m).where("not is_test").join(deg, "node_id").join(depth, "node_id").join(at, "node_id", "left").join(cross, "node_id", "left").join(res, "node_id", "left")
    f = f.join(T.covered(m).select("node_id", F.lit(True).alias("covered")), "node_id", "left").crossJoin(F.broadcast(hot_cut(deg)))
    pin = pinned.select("node_id", F.lit(True).alias("pinned")).distinct() if pinned is not None else m.spark.createDataFrame([], "node_id long, pinned boolean")
    f = f.join(pin, "node_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("services", "cross", "resources", "acquires")}
    f = f.withColumns({**zero, "covered": F.coalesce("covered", F.lit(False)), "pinned": F.coalesce("pinned", F.lit(False))})
    c = F.col
    f = f.where(c("pinned") | c("covered") | (c("cx") > 1) | (c("callees") > 0) | (c("callers") > 0) | (c("body_lines") > 3))
    hot = (c("call_sites") >= c("hot")) & ((c("loop_depth") > 0) | (c("resources") > 0))
    f = f.withColumn("is_hot", F.coalesce(hot, F.lit(False)))
    when = lambda cond, v: F.when(cond, v).otherwise(F.lit(0))
    scores = [
        c("loop_depth") * c("loop_depth") * 10 + when(c("recursive"), c("depth") * 2),
        c("callees") * 4 + c("depth") * 3 + c("cx"),
        c("services") * 25,
        when(c("is_hot"), c("call_sites") * 4 + c("loop_depth") * 10),
        F.lit(8) + when(c("callers") == 0, F.lit(20)),
    ]
    kinds = F.array(*[F.struct((-s.cast("long")).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(zip(KINDS, scores))])
    ranked = F.array_sort(F.filter(kinds, lambda x: x["s"] < 0))
    f = f.withColumn("ranked", ranked)
    top = -c("ranked")[0]["s"]
    f = f.withColumn("kinds", F.transform(F.filter("ranked", lambda x: -x["s"] * 5 >= top * 2), lambda x: x["k"]))
    note = lambda cond, text: F.when(cond, text)
    said = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    why = F.array_compact(
        F.array(
            note(c("loop_depth") >= 2, said(c("loop_depth"), " nested loop levels")),
            note(c("recursive"), said("recursive, over a chain ", c("depth"), " deep")),
            note(c("services") > 0, said("called from ", c("services"), " other service(s)")),
            note((c("callees") >= 3) | (c("depth") >= 3), said(c("callees"), " direct call-out(s), chain ", c("depth"), " deep")),
            note(c("is_hot"), said(c("call_sites"), " call sites from ", c("callers"), " caller(s)")),
            note(c("callers") == 0, F.lit("nothing calls it")),
            note(c("cx") >= 10, said(c("cx"), " decision points")),
        )
    )
    ret = F.coalesce("ret", F.lit(""))
    semantics = F.array_compact(
        F.array(
            note(ret.rlike("Result|[Ee]rror"), F.lit("fallible")),
            note(ret.rlike("Option|null|undefined"), F.lit("may return nothing")),
            note(c("resources") > 0, said("acquires ", c("acquires"))),
            note(~c("is_typed"), F.lit("untyped")),
            note(c("owner").isNotNull(), F.lit("method")),
        )
    )
    score = c("cx") * 3 + c("loop_depth") * 8 + c("depth") * 4 + c("call_sites") * 2 + c("callees") * 3 + c("cross") * 10 + when(~c("covered"), F.lit(40)) + when(c("recursive"), F.lit(6))
    out = f.select("node_id", target_id("path", "name").alias("id"), "service", c("kinds")[0].alias("kind"), F.array_join(F.slice("kinds", F.lit(2), F.size("kinds")), ",").alias("also"), score.cast("long").alias("priority"), "covered", "pinned", F.array_join(why, "; ").alias("why"), F.array_join(semantics, "; ").alias("semantics"))
    best = out.where("not pinned").orderBy(F.desc("priority"), "node_id").limit(most)
    return best.unionByName(out.where("pinned"))


def _cycles(m: CodeMap, edges: DataFrame) -> DataFrame:
    if "cycles" not in m.derived:
        m.derived["cycles"] = cut(G.components(edges))
    return m.derived["cycles"]


def target_summary(targets: DataFrame) -> DataFrame:
    """``kind, functions, untested``: targets by kind."""
    return targets.groupBy("kind").agg(F.count(F.lit(1)).alias("functions"), F.count(F.when(~F.col("covered"), 1)).alias("untested"))


def triggered_tests(m: CodeMap, hunks: DataFrame) -> DataFrame:
    """``test, file, line, language, distance, covers``: tests that reach a changed function or one that calls it.

    ``distance`` is the least number of calls between; ``covers`` names up to eight functions, those met
    first by node. Tests are the first ``MOST_TESTS`` of each function.
    """
    reach = spans.callers_within(C.call_edges(m), spans.changed_functions(m, hunks))
    plain = M.metrics(m).where("not is_test").select("node_id", "name")
    hit = T.covering_tests(m, T.MOST_TESTS).join(reach, "node_id").join(plain, "node_id")
    named = hit.groupBy("test", "file", "name").agg(F.min("node_id").alias("first"), F.min("distance").alias("d"), F.min("line").alias("line"), F.min("language").alias("language"))
    w = Window.partitionBy("test", "file").orderBy("first", "name")
    n = named.withColumn("i", F.row_number().over(w))
    g = n.groupBy("test", "file").agg(F.min("line").alias("line"), F.min("language").alias("language"), F.min("d").alias("distance"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("i") <= MOST_COVERS, F.col("name")))), ",").alias("covers"))
    return g.select("test", "file", "line", "language", "distance", "covers")


def test_commands(run: DataFrame) -> DataFrame:
    """``language, command, selects``: one command for each language that has one, tests in order of distance, file and name."""
    g = run.groupBy("language").agg(F.sort_array(F.collect_list(F.struct("distance", "file", "test"))).alias("t"), F.count(F.lit(1)).alias("selects"))
    names = F.transform("t", lambda x: x["test"])
    dirs = F.array_sort(F.array_distinct(F.transform("t", lambda x: F.concat(F.lit("./"), F.coalesce(F.nullif(F.regexp_extract(x["file"], "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))))))
    label = F.transform(names, lambda n: F.when(n.rlike(r"^[^(]*\(.*\)$"), F.regexp_replace(F.regexp_extract(n, r"^[^(]*\((.*)\)$", 1), '^"+|"+$', "")).otherwise(n))
    of: dict[tuple[str, ...], Column] = {
        ("rust",): F.concat(F.lit("cargo test -- "), F.array_join(names, " ")),
        ("go",): F.concat(F.lit("go test -run '^("), F.array_join(names, "|"), F.lit(")$' "), F.array_join(dirs, " ")),
        ("python",): F.concat(F.lit('pytest -k "'), F.array_join(names, " or "), F.lit('"')),
        ("javascript", "typescript", "tsx"): F.concat(F.lit('npx jest -t "'), F.array_join(label, "|"), F.lit('"')),
        ("cpp",): F.concat(F.lit("ctest -R '"), F.array_join(names, "|"), F.lit("'")),
    }
    command = F.coalesce(*[F.when(F.col("language").isin(*k), v) for k, v in of.items()])
    return g.select("language", command.alias("command"), "selects").where("command is not null")


def trigger_totals(run: DataFrame, tests: DataFrame) -> DataFrame:
    """``tests_to_run, direct, total_tests, full_suite_advised``: the last from 80 % of all tests on."""
    r = run.agg(F.count(F.lit(1)).alias("tests_to_run"), F.count(F.when(F.col("distance") == 0, 1)).alias("direct"))
    j = r.crossJoin(F.broadcast(tests.select(F.col("tests").alias("total_tests"))))
    return j.withColumn("full_suite_advised", (F.col("total_tests") > 0) & (F.col("tests_to_run") * 5 >= F.col("total_tests") * 4))


def changed_report(m: CodeMap, hunks: DataFrame, member: DataFrame, resolved: DataFrame) -> DataFrame:
    """``node_id, function, path, start_line, end_line, services, tested, tested_by, called_from``: each changed function.

    Test code counts as tested; ``tested_by`` names all tests. ``called_from`` are other services that call the name.
    """
    ch = spans.changed_functions(m, hunks).select("node_id", "path")
    f = M.metrics(m).drop("path").join(ch, "node_id")
    svc = member.groupBy("file_id").agg(F.sort_array(F.collect_set("service")).alias("services"))
    by = T.covering_tests(m).groupBy("node_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "test"))), lambda x: x["test"]), ",").alias("tested_by"))
    cov = T.covered(m).select("node_id", F.lit(True).alias("reached"))
    callers = resolved.where("target is not null").groupBy("name").agg(F.collect_set("service").alias("callers"))
    j = f.join(svc, "file_id", "left").join(by, "node_id", "left").join(cov, "node_id", "left").join(callers, "name", "left")
    none = F.array().cast("array<string>")
    away = F.array_sort(F.array_except(F.coalesce("callers", none), F.coalesce("services", none)))
    return j.select("node_id", F.col("name").alias("function"), "path", "start_line", "end_line", F.array_join(F.coalesce("services", none), ",").alias("services"), (F.col("is_test") | F.coalesce("reached", F.lit(False))).alias("tested"), F.coalesce("tested_by", F.lit("")).alias("tested_by"), F.array_join(away, ",").alias("called_from"))


def coverage_gaps(m: CodeMap, report: DataFrame, run: DataFrame, targets: DataFrame) -> DataFrame:
    """``id, start_line, end_line, resolved``: changed functions outside tests that no test reaches, and whether a target has the id."""
    plain = M.metrics(m).where("not is_test").select("node_id")
    named = run.select(F.explode(F.split("covers", ",")).alias("function")).distinct()
    g = report.where("tested_by = ''").join(plain, "node_id", "left_semi").join(named, "function", "left_anti").select(target_id("path", "function").alias("id"), "start_line", "end_line")
    return g.join(targets.select("id", F.lit(True).alias("resolved")).distinct(), "id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def change_counts(m: CodeMap, hunks: DataFrame, member: DataFrame, report: DataFrame, impacted: DataFrame, unresolved: DataFrame, crossings: DataFrame) -> DataFrame:
    """One row of counts of a change report; ``crossings`` as ``crossing_counts`` has them."""
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    files = one(hunks.select("path").distinct(), "changed_files")
    away = one(hunks.select("path").distinct().join(member.select("path").distinct(), "path", "left_anti"), "unassigned_files")
    fns = report.agg(F.count(F.lit(1)).alias("changed_functions"), F.count(F.when(~F.col("tested"), 1)).alias("untested"))
    x = crossings.agg(F.coalesce(F.sum(F.greatest("n", F.lit(1))), F.lit(0)).cast("long").alias("crossings"), F.count(F.when(F.col("n") == 0, 1)).alias("unmatched_crossings"))
    ext = T.coverage_totals(m).select(F.col("external_calls").alias("external_test_calls"))
    out = files
    for other in (away, fns, one(impacted, "services_to_test"), one(unresolved, "unresolved_calls"), x, ext):
        out = out.crossJoin(F.broadcast(other))
    return out

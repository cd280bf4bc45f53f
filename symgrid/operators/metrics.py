"""Function metrics, rollups by language and the lint rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..codemap import CodeMap
from ..functions.predicates import is_test_path
from ..functions.scalars import arity, complexity, complexity_band
from ..schema import resource_pairs

MOST_COMPLEX, MOST_LINTS = 2000, 400
RULES = {"inline-candidate": "info", "unroll-candidate": "info", "deep-loop-nest": "warn", "leak-risk": "warn", "high-complexity": "warn", "long-function": "info", "many-params": "info", "no-callers": "info"}


def metrics(m: CodeMap) -> DataFrame:
    """``funcs`` with path, language, loops, loop_depth, cx and is_test (by context or path, not by name)."""
    nested = m.loops.groupBy("node_id").agg(F.count(F.lit(1)).alias("loops"), F.max("depth").alias("loop_depth"))
    own = m.funcs.join(nested, "node_id", "left").join(m.files.select("file_id", "path", "language", "family", "is_typed"), "file_id")
    own = own.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("loops", "loop_depth")})
    return own.withColumns({"cx": complexity("branches", "loops").cast("long"), "is_test": F.col("test_ctx") | is_test_path("path")})


def language_totals(m: CodeMap) -> DataFrame:
    """``language, files, funcs, lines, avg_complexity``; the average is 0 where there is no function."""
    per = metrics(m).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cx").alias("cx"))
    g = m.files.join(per, "file_id", "left").groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("funcs"), F.sum("lines").cast("long").alias("lines"), F.sum("cx").alias("cx"))
    return g.select("language", "files", "funcs", "lines", F.round(F.when(F.col("funcs") == 0, 0.0).otherwise(F.col("cx") / F.col("funcs")), 6).alias("avg_complexity"))


def complexity_table(m: CodeMap, most: int = MOST_COMPLEX) -> DataFrame:
    """The most complex functions with band and arity; ties in order of node."""
    own = metrics(m).select("node_id", "name", "path", "cx", complexity_band("cx").cast("int").alias("band"), arity("params").alias("arity"), "is_test")
    return own.orderBy(F.desc("cx"), "node_id").limit(most)


def resource_balance(m: CodeMap) -> DataFrame:
    """``node_id, release_name, acquires, releases, guarded, line, names``: unguarded acquires against releases.

    ``line`` is that of the first unguarded acquire, ``names`` the acquiring names in order.
    """
    pairs = resource_pairs(m.spark).select(F.col("language").alias("lang"), "acquire_name", "release_name")
    own = m.resources.join(m.funcs.select("node_id", "file_id"), "node_id").join(m.files.select("file_id", "language"), "file_id")
    held = own.join(F.broadcast(pairs), (F.col("language") == F.col("lang")) & (F.col("pair") == F.col("acquire_name")) & F.col("acquire"), "left")
    key = F.when(F.col("acquire"), F.col("release_name")).otherwise(F.col("name"))
    open_ = F.col("acquire") & ~F.col("guarded")
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return held.withColumn("key", key).where("key is not null").groupBy("node_id", F.col("key").alias("release_name")).agg(
        count(open_, "acquires"), count(~F.col("acquire"), "releases"), count(F.col("acquire") & F.col("guarded"), "guarded"), F.min(F.when(open_, F.col("line"))).alias("line"), F.array_join(F.sort_array(F.collect_set(F.when(open_, F.col("pair")))), "/").alias("names")
    )


def all_lints(m: CodeMap, degrees: DataFrame) -> DataFrame:
    """``rule, severity, node_id, path, line, value``: every finding outside test code.

    The rules that look at the function alone are one pass over its metrics; only loops, resources
    and callers are joined. ``value`` is the number that the rule is about.
    """
    f = metrics(m).where("not is_test").join(degrees.select("node_id", "callers"), "node_id")
    called = m.calls.select("name").distinct()
    f = f.join(called.withColumn("called", F.lit(True)), "name", "left")
    deep = m.loops.where("depth >= 3").groupBy("node_id").agg(F.min("line").alias("deep_line"))
    f = f.join(deep, "node_id", "left")

    def hit(cond: Column, rule: str, line: str, value: str) -> Column:
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), F.col(line).alias("line"), F.col(value).cast("long").alias("value")))

    c = F.col
    own = F.array(
        hit((c("body_lines") <= 5) & (c("loops") == 0) & (c("branches") <= 1) & ~c("recursive") & (c("callers") >= 3), "inline-candidate", "line", "callers"),
        hit(c("loop_depth") >= 3, "deep-loop-nest", "deep_line", "loop_depth"),
        hit(c("cx") >= 15, "high-complexity", "line", "cx"),
        hit(c("body_lines") >= 120, "long-function", "line", "body_lines"),
        hit(c("params") >= 6, "many-params", "line", "params"),
        hit((c("callers") == 0) & c("called").isNull() & (c("name") != "main"), "no-callers", "line", "callers"),
    )
    simple = f.select("node_id", "path", F.explode(F.array_compact(own)).alias("h")).select("h.rule", "node_id", "path", "h.line", "h.value")
    plain = metrics(m).where("not is_test").select("node_id", "path")
    unroll = m.loops.where("trip between 1 and 8").join(plain, "node_id").select(F.lit("unroll-candidate").alias("rule"), "node_id", "path", "line", F.col("trip").cast("long").alias("value"))
    leak = resource_balance(m).where("acquires > releases").join(plain, "node_id").select(F.lit("leak-risk").alias("rule"), "node_id", "path", "line", (F.col("acquires") - F.col("releases")).alias("value"))
    severity = F.when(c("rule").isin(*[r for r, s in RULES.items() if s == "warn"]), "warn").otherwise("info")
    return simple.unionByName(unroll).unionByName(leak).withColumn("severity", severity).select("rule", "severity", "node_id", "path", "line", "value")


def lints(m: CodeMap, degrees: DataFrame, most: int = MOST_LINTS) -> DataFrame:
    """The findings worst first: warnings, then by rule, path, line and node, at most ``most``."""
    return all_lints(m, degrees).orderBy(F.desc("severity"), "rule", "path", "line", "node_id", "value").limit(most)


def rule_catalogue(spark: SparkSession) -> DataFrame:
    """``rule, severity``."""
    return spark.createDataFrame(sorted(RULES.items()), "rule string, severity string")


def lints_of(found: DataFrame, rule: str) -> DataFrame:
    """Findings of one rule; an unknown one is an error."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}; one of {', '.join(RULES)}")
    return found.where(F.col("rule") == rule)

"""Results as lines of text: ``ord, line`` tables, in order of ``ord``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MOST_COMMAND = 1200


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _lines(rows: DataFrame, head: list[str], *order: Column | str) -> DataFrame:
    """Rows of ``line`` after the lines of a head, which stand for themselves where there is no row. A view shows a page of rows."""
    n = rows.withColumn("ord", F.row_number().over(Window.orderBy(*order)) + F.lit(len(head))).select("ord", "line")
    top = rows.sparkSession.createDataFrame([(i + 1, h) for i, h in enumerate(head)], "ord int, line string")
    return top.unionByName(n)


def table(df: DataFrame, columns: list[str], *order: Column | str) -> DataFrame:
    """A Markdown table; bars and line ends in cells are broken up."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "\\\\|"), r"\s*\n\s*", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    return _lines(df.withColumn("line", line), ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)], *order)


def index(counts: DataFrame) -> DataFrame:
    """One row for each file; columns of modules and exports only where any file has some."""
    has = counts.agg(F.max("mods"), F.max("exports")).first()
    shown = ["path", "language", "funcs", "consts", "refs", "notes", *[c for c, n in zip(("mods", "exports"), has) if n]]
    return table(counts, shown, "path")


def hits(found: DataFrame, paths: DataFrame) -> DataFrame:
    """Hits of a search as ``path:line kind name``, with the total where not all are shown."""
    f = found.join(paths.select("file_id", "path"), "file_id")
    n = f.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("total"), F.lit(0)).alias("t")).first()
    head = [f"{n['t']} hit(s)" + (f", {n['n']} shown" if n["t"] > n["n"] else "")]
    return _lines(f.withColumn("line", _said(F.col("path"), ":", F.col("line"), " ", F.col("kind"), " ", F.col("name"))), head, "path", "line", "kind", "name")


def references(defs: DataFrame, refs: DataFrame, symbol: str) -> DataFrame:
    """Definitions, then references, then how many there are of either."""
    d = defs.select(F.lit(0).alias("a"), "path", F.col("line").alias("at"), _said("  ", F.col("kind"), " ", F.col("path"), ":", F.col("line"), F.when(~F.col("narrowed"), " (same name only)")).alias("line"))
    r = refs.select(F.lit(1).alias("a"), "path", F.col("line").alias("at"), _said("  ", F.col("kind"), " ", F.col("path"), ":", F.col("line"), F.when(F.col("caller").isNotNull(), _said(" in ", F.col("caller")))).alias("line"))
    n = d.count(), (refs.agg(F.max("total")).first()[0] or 0)
    return _lines(d.unionByName(r), [f"{symbol}: {n[0]} definition(s), {n[1]} reference(s)"], "a", "path", "at", "line")


def notes(found: DataFrame, paths: DataFrame) -> DataFrame:
    f = found.join(paths.select("file_id", "path"), "file_id")
    return _lines(f.withColumn("line", _said(F.col("path"), ":", F.col("line"), " ", F.col("text"))), ["notes"], "path", "line")


def lints(found: DataFrame) -> DataFrame:
    line = _said(F.col("severity"), " ", F.col("rule"), " ", F.col("path"), ":", F.col("line"), " (", F.col("value"), ")")
    return _lines(found.withColumn("at", F.col("line")).withColumn("line", line), ["findings"], F.desc("severity"), "rule", "path", "at", "value")


def triggers(run: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands, then tests by distance. A command of over MOST_COMMAND characters is described instead."""
    c = commands.select(F.lit(0).alias("a"), F.col("language").alias("b"), F.when(F.length("command") > MOST_COMMAND, _said("  ", F.col("language"), ": ", F.col("selects"), " tests, too many for one command")).otherwise(_said("  ", F.col("command"))).alias("line"))
    t = run.select((F.col("distance") + 1).alias("a"), _said(F.col("file"), F.col("test")).alias("b"), _said("  ", F.col("distance"), " ", F.col("file"), ":", F.col("line"), " ", F.col("test"), " covers ", F.col("covers")).alias("line"))
    return _lines(c.unionByName(t), ["tests to run"], "a", "b", "line")


def targets(found: DataFrame, kind: str | None = None) -> DataFrame:
    """Targets by priority; ``kind`` fits the first kind or any other."""
    f = found if kind is None else found.where((F.col("kind") == kind) | F.array_contains(F.split("also", ","), kind))
    line = _said(F.col("priority"), " ", F.col("kind"), " ", F.col("id"), F.when(~F.col("covered"), " (untested)"), F.when(F.col("why") != "", _said(": ", F.col("why"))))
    return _lines(f.withColumn("line", line), ["targets"], F.desc("priority"), "id")


def services(rollup: DataFrame, edges: DataFrame, service: str | None = None) -> DataFrame:
    """Services and edges, all or those of one service at either end."""
    if service is not None:
        rollup, edges = rollup.where(F.col("service") == service), edges.where((F.col("src") == service) | (F.col("dst") == service))
    s = rollup.where("service is not null").select(F.lit(0).alias("a"), F.col("service").alias("b"), F.lit("").alias("c"), _said("  ", F.col("service"), ": ", F.col("files"), " file(s), ", F.col("funcs"), " function(s)").alias("line"))
    e = edges.select(F.lit(1).alias("a"), F.col("src").alias("b"), F.col("dst").alias("c"), _said("  ", F.col("src"), " -> ", F.col("dst"), F.when(F.col("declared"), " declared"), F.when(F.col("detected"), " detected")).alias("line"))
    return _lines(s.unionByName(e), ["services"], "a", "b", "c")


def file_entry(m, path: str) -> DataFrame:  # noqa: ANN001
    """One file: functions with signatures and doc, constants, types, imports and notes, in order of line."""
    f = m.files.where(F.col("path") == path).select("file_id")
    pick = lambda df, kind, text: df.join(f, "file_id").select("line", F.lit(kind).alias("k"), text.alias("t"))
    c = F.col
    rows = pick(m.funcs, "func", _said(F.when(c("owner").isNotNull(), _said(c("owner"), ".")), c("name"), F.when(c("ret").isNotNull(), _said(" -> ", c("ret"))), F.when(c("comment").isNotNull(), _said("  ", c("comment")))))
    rows = rows.unionByName(pick(m.consts, "const", _said(c("name"), F.when(c("ty").isNotNull(), _said(": ", c("ty"))))))
    rows = rows.unionByName(pick(m.types, "type", _said(c("kind"), " ", c("name")))).unionByName(pick(m.imports, "import", _said(c("module"), F.when(F.size("names") > 0, _said(": ", F.array_join("names", ", "))))))
    rows = rows.unionByName(pick(m.notes, "note", c("text")))
    return _lines(rows.withColumn("at", c("line")).withColumn("line", _said("  ", c("line"), " ", c("k"), " ", c("t"))), [path], "at", "k", "line")

"""Calls between services by evidence, the edges they make, and what follows from a change.

Sets of services are arrays in a row: their number is that of the configuration. All else is equi joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..codemap import CodeMap
from ..functions.predicates import names_project
from ..functions.scalars import norm_key, normalize_type, parent_dir, pick_transport, segments, stem, via_rank
from ..plans.storage import cut

FACADES = ("__init__", "index", "mod", "lib")
MOST_SYMBOLS = 100


def _sets(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.collect_set("service").alias("services"))


def _none() -> Column:
    return F.array().cast("array<string>")


def service_words(m: CodeMap, member: DataFrame) -> DataFrame:
    """``word, services``: what a qualifier can call a service by: types, modules, stems and directories of facades."""
    own = m.files.select("file_id", "path")
    s = own.select("file_id", stem("path").alias("word"), F.element_at(F.split(parent_dir("path"), "/"), -1).alias("dir"))
    words = s.select("file_id", "word").unionByName(s.where(F.col("word").isin(*FACADES)).select("file_id", F.col("dir").alias("word")))
    words = words.unionByName(m.types.select("file_id", F.col("name").alias("word"))).unionByName(m.modules.select("file_id", F.col("name").alias("word")))
    return _sets(words.where("word <> ''").join(member.select("file_id", "service"), "file_id"), "word")


def resolved_calls(m: CodeMap, member: DataFrame, projects: dict[str, list[str]] | None = None) -> DataFrame:
    """``service, file_id, name, qualifier, recv_type, line, target, via, reason, candidates``: each kind of call of a service, and its first line.

    The receiver's type decides if one other service has its method; else, among the other services
    that define the name, a qualifier, a named import, an import of everything, and for untyped
    languages the name alone. Where a step leaves more than one the call is ambiguous and no later step
    is tried. ``reason`` is null for resolved calls, else local, undefined, ambiguous or no-evidence.
    Calls are read once and shuffled three times, for what depends on names; what depends on a file or
    on a qualifier alone is joined last, as one small row for each.
    """
    at = cut(member.select("file_id", "service").distinct())
    defs = cut(_sets(m.funcs.join(at, "file_id"), "name"))
    methods = _sets(m.funcs.where("owner is not null").join(at, "file_id"), "owner", "name")
    words = cut(service_words(m, member))
    ids = projects or {}

    def by_project(text: Column) -> Column:
        found = [F.when(F.coalesce(names_project(text, F.lit(i)), F.lit(False)), F.array(*map(F.lit, s))) for i, s in ids.items()]
        return F.flatten(F.array_compact(F.array(*found))) if found else _none()

    imps = m.imports.select("file_id", "module", "names").distinct().withColumn("i", F.monotonically_increasing_id())
    imps = cut(imps)
    asked = imps.select("i", F.explode(F.concat(segments("module"), "names")).alias("word")).join(words, "word").groupBy("i").agg(F.flatten(F.collect_list("services")).alias("found"))
    imps = imps.join(asked, "i", "left").withColumn("services", F.array_distinct(F.concat(F.coalesce("found", _none()), by_project(F.col("module"))))).where(F.size("services") > 0)
    imps = cut(imps.select("file_id", "names", "services"))
    union = lambda df, *k: df.groupBy(*k).agg(F.array_distinct(F.flatten(F.collect_list("services"))).alias("services"))
    bound = union(imps.select("file_id", F.explode("names").alias("name"), "services"), "file_id", "name")
    whole = union(imps.where(F.size("names") == 0), "file_id")
    kind = ["file_id", "name", "qualifier", "recv_type"]
    k = m.calls.select(*kind, "line").join(at.select("file_id").distinct(), "file_id", "left_semi").repartition("file_id", "name").groupBy(*kind).agg(F.min("line").alias("line"))
    k = cut(k.join(bound.withColumnRenamed("services", "bound"), ["file_id", "name"], "left"))
    q = k.where("qualifier is not null").select("qualifier").distinct()
    q = cut(q.select("qualifier", segments("qualifier").alias("segs"), by_project(F.col("qualifier")).alias("project")))
    said = q.select("qualifier", F.explode("segs").alias("word")).join(words, "word").groupBy("qualifier").agg(F.flatten(F.collect_list("services")).alias("said"))
    # services by name: their number is that of the configuration
    every = F.array(*[F.lit(r[0]) for r in at.select("service").distinct().collect()]).cast("array<string>")
    said = q.join(said, "qualifier", "left").select("qualifier", F.array_intersect(F.concat(F.coalesce("said", _none()), "segs", "project"), every).alias("named"), (F.size("project") > 0).alias("project"))
    said = cut(said.where(F.size("named") > 0))
    per_file = cut(m.files.select("file_id", "is_typed").join(at.groupBy("file_id").agg(F.collect_list("service").alias("of")), "file_id").join(whole.withColumnRenamed("services", "whole"), "file_id", "left"))
    k = k.join(methods.select(F.col("owner").alias("recv_type"), "name", F.col("services").alias("methods")), ["recv_type", "name"], "left")
    k = k.join(defs.withColumnRenamed("services", "definers"), "name", "left")
    k = k.join(said, "qualifier", "left").join(per_file, "file_id").withColumn("service", F.explode("of")).drop("of")
    c = F.col
    own = F.array("service")
    k = k.withColumns({"by_type": F.array_sort(F.array_except(F.coalesce("methods", _none()), own)), "others": F.array_sort(F.array_except(F.coalesce("definers", _none()), own))})
    both = lambda x: F.when(c(x).isNull(), _none()).otherwise(F.array_intersect("others", x))
    k = k.withColumns({f"by_{x}": both(x) for x in ("named", "bound", "whole")})
    steps = [
        (c("by_type"), F.lit("receiver-type")),
        (c("by_named"), F.when(c("project"), "project").otherwise("qualifier")),
        (c("by_bound"), F.lit("import")),
        (c("by_whole"), F.lit("import")),
        (F.when(~c("is_typed") & (F.size("others") == 1), c("others")).otherwise(_none()), F.lit("name-only")),
    ]
    of = lambda t, v, r, x: F.struct(t.cast("string").alias("target"), v.cast("string").alias("via"), r.cast("string").alias("reason"), x.alias("candidates"))
    null = F.lit(None)
    dead = F.when(c("definers").isNull(), of(null, null, F.lit("undefined"), _none())).when(F.size("others") == 0, of(null, null, F.lit("local"), _none()))
    out = of(null, null, F.when(F.size("others") > 1, "ambiguous").otherwise("no-evidence"), c("others"))
    for i, (cands, via) in reversed(list(enumerate(steps))):
        hit = F.when(F.size(cands) == 1, of(cands[0], via, null, _none())).when(F.size(cands) > 1, of(null, null, F.lit("ambiguous"), cands))
        out = F.coalesce(hit, F.coalesce(dead, out) if i == 0 else out)
    return k.withColumn("r", out).select("service", *kind, "line", "r.*")


def edge_symbols(m: CodeMap, member: DataFrame, resolved: DataFrame, most: int = MOST_SYMBOLS) -> DataFrame:
    """``src, dst, symbol, path, line, via, kind``: what ties two services, each symbol once by its strongest evidence.

    Besides calls, a signature of a typed language that mentions a type of just one other service.
    Of equal evidence the first in order of path and line counts. An edge has at most ``most`` symbols,
    those met first, calls before types.
    """
    hit = resolved.where("target is not null").select("file_id", F.col("service").alias("src"), F.col("target").alias("dst"), F.col("name").alias("symbol"), "line", "via", F.lit("call").alias("kind"))
    at = member.select("file_id", "service")
    types = _sets(m.types.join(at, "file_id"), "name")
    f = m.funcs.join(m.files.where("is_typed").select("file_id"), "file_id")
    mentioned = F.filter(F.concat("param_types", F.array(normalize_type("ret"), F.col("owner"))), lambda t: t.isNotNull() & (t != ""))
    refs = f.select("file_id", "line", F.explode(mentioned).alias("symbol")).join(at, "file_id").join(types.withColumnRenamed("name", "symbol"), "symbol")
    refs = refs.withColumn("others", F.array_except("services", F.array("service"))).where(F.size("others") == 1)
    refs = refs.select("file_id", F.col("service").alias("src"), F.col("others")[0].alias("dst"), "symbol", "line", F.lit("type-reference").alias("via"), F.lit("type").alias("kind"))
    met = hit.unionByName(refs).join(m.files.select("file_id", "path"), "file_id")
    order = F.struct(F.when(F.col("kind") == "call", 0).otherwise(1).alias("a"), F.col("path"), F.col("line"), F.col("via"))
    best = F.struct(via_rank("via").alias("rank"), order.alias("order"), "path", "line", "via", "kind")
    one = met.groupBy("src", "dst", "symbol").agg(F.min(best).alias("b"), F.min(order).alias("first"))
    n = F.row_number().over(Window.partitionBy("src", "dst").orderBy("first", "symbol"))
    return one.withColumn("n", n).where(F.col("n") <= most).select("src", "dst", "symbol", "b.path", "b.line", "b.via", "b.kind")


def unresolved(m: CodeMap, resolved: DataFrame, most: int = MOST_SYMBOLS) -> DataFrame:
    """``src, symbol, path, line, reason, candidates``: calls that more than one service or no evidence is left for.

    One for each service and name, the first in order of path and line; the first ``most`` of all.
    """
    bad = resolved.where("reason in ('ambiguous', 'no-evidence')").select("service", "file_id", "name", "line", "reason", F.array_join("candidates", ",").alias("candidates")).join(m.files.select("file_id", "path"), "file_id")
    one = bad.groupBy(F.col("service").alias("src"), F.col("name").alias("symbol")).agg(F.min(F.struct("path", "line", "reason", "candidates")).alias("b"))
    return one.select("src", "symbol", "b.*").orderBy("path", "line", "src", "symbol").limit(most)


def overlay(symbols: DataFrame, deps: dict[str, list[str]]) -> DataFrame:
    """``src, dst, declared, detected, symbols``: edges with the declared dependencies laid over."""
    found = symbols.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("symbols"))
    said = symbols.sparkSession.createDataFrame([(x, y, True) for x, ys in deps.items() for y in ys], "src string, dst string, declared boolean")
    j = found.join(said, ["src", "dst"], "full")
    return j.select("src", "dst", F.coalesce("declared", F.lit(False)).alias("declared"), F.col("symbols").isNotNull().alias("detected"), F.coalesce("symbols", F.lit(0)).cast("long").alias("symbols"))


def crossing_sites(m: CodeMap, member: DataFrame, provides: DataFrame | None = None, consumes: DataFrame | None = None) -> DataFrame:
    """``key, transport, src, dst, path, line, function, remote_path, remote_line, external``: every annotated call and whom it meets.

    A call meets the handlers of its key in other services, and what peers provide (``provides, consumes``:
    peer, key, transport, file, line, function); one that meets none has an empty ``dst``. A key that a
    peer consumes comes in from the peer. The caller's service is the first of its file, '' for none;
    handlers count for each service of theirs. Keys are compared without case and outer space.
    """
    first = member.groupBy("file_id").agg(F.min("service").alias("own"))
    a = m.annotations.join(m.files.select("file_id", "path"), "file_id").withColumn("k", norm_key("key"))
    call = a.where("boundary = 'calls'").join(first, "file_id", "left").select("k", "key", "transport", F.coalesce("own", F.lit("")).alias("src"), "path", "line", "function", F.monotonically_increasing_id().alias("n"))
    call = cut(call)
    serve = a.where("boundary = 'serves'").join(member.select("file_id", "service"), "file_id", "left").select("k", F.coalesce("service", F.lit("")).alias("dst"), F.col("transport").alias("t"), F.col("path").alias("remote_path"), F.col("line").alias("remote_line"), F.col("function").alias("handler"))
    own = serve.withColumn("external", F.lit(False))
    if provides is not None:
        p = provides.select(norm_key("key").alias("k"), F.col("peer").alias("dst"), F.col("transport").alias("t"), F.col("file").alias("remote_path"), F.col("line").alias("remote_line"), F.col("function").alias("handler"), F.lit(True).alias("external"))
        own = own.unionByName(p)
    met = call.join(own, "k").where("src <> dst or external")
    out = met.select("n", "key", pick_transport("transport", "t").alias("transport"), "src", "dst", "path", "line", "function", "remote_path", "remote_line", "external")
    lone = call.join(met.select("n").distinct(), "n", "left_anti").select("key", "transport", "src", F.lit("").alias("dst"), "path", "line", "function", F.lit(None).cast("string").alias("remote_path"), F.lit(None).cast("int").alias("remote_line"), F.lit(False).alias("external"))
    out = out.drop("n").unionByName(lone)
    if consumes is not None:
        c = consumes.select(norm_key("key").alias("k"), "key", F.col("transport").alias("ct"), F.col("peer").alias("src"), F.col("file").alias("rf"), F.col("line").alias("rl"))
        back = c.join(serve, "k").select("key", pick_transport("ct", "t").alias("transport"), "src", "dst", F.col("remote_path").alias("path"), F.col("remote_line").alias("line"), F.col("handler").alias("function"), F.col("rf").alias("remote_path"), F.col("rl").alias("remote_line"), F.lit(True).alias("external"))
        out = out.unionByName(back)
    return out


def crossing_counts(m: CodeMap, member: DataFrame) -> DataFrame:
    """``key, transport, src, dst, path, line, n``: every annotated call with each service that it meets, and in how many handlers.

    What ``crossing_sites`` (without peers) has, counted: a call that meets none has an empty ``dst`` and
    ``n`` 0. Handlers are counted by key and service before they are joined, so a common key costs its
    calls and services, not its calls times its handlers. ``transport`` is the least of the handlers'.
    """
    first = member.groupBy("file_id").agg(F.min("service").alias("own"))
    a = m.annotations.join(m.files.select("file_id", "path"), "file_id").withColumn("k", norm_key("key"))
    call = a.where("boundary = 'calls'").join(first, "file_id", "left").select("k", "key", "transport", F.coalesce("own", F.lit("")).alias("src"), "path", "line")
    serve = a.where("boundary = 'serves'").join(member.select("file_id", "service"), "file_id", "left").groupBy("k", F.coalesce("service", F.lit("")).alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.min("transport").alias("t"))
    met = serve.groupBy("k").agg(F.collect_list(F.struct("dst", "n", "t")).alias("met"))
    away = F.filter(F.coalesce("met", F.array().cast("array<struct<dst:string,n:bigint,t:string>>")), lambda x: x["dst"] != F.col("src"))
    j = call.join(met, "k", "left").select("key", "transport", "src", "path", "line", F.explode_outer(away).alias("x"))
    return j.select("key", F.when(F.col("x").isNull(), F.col("transport")).otherwise(pick_transport("transport", "x.t")).alias("transport"), "src", F.coalesce("x.dst", F.lit("")).alias("dst"), "path", "line", F.coalesce("x.n", F.lit(0)).cast("long").alias("n"))


def merge_crossings(edges: DataFrame, symbols: DataFrame, crossings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and symbols with the crossings folded in; a crossing already there by symbol, path and line adds nothing."""
    new = crossings.where("src <> '' and dst <> ''").select("src", "dst", F.col("key").alias("symbol"), "path", "line", F.lit("annotation").alias("via"), F.col("transport").alias("kind"))
    new = new.groupBy("src", "dst", "symbol", "path", "line", "via").agg(F.min("kind").alias("kind"))
    new = new.join(symbols, ["src", "dst", "symbol", "path", "line"], "left_anti")
    all_ = symbols.unionByName(new.select(*symbols.columns))
    n = new.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("more"))
    e = edges.join(n, ["src", "dst"], "full")
    false = F.lit(False)
    e = e.select("src", "dst", F.coalesce("declared", false).alias("declared"), (F.coalesce("detected", false) | F.col("more").isNotNull()).alias("detected"), (F.coalesce("symbols", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("symbols"))
    return e, all_


def impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``service, reason, path``: the changed services and all that depend on them, by the shortest way.

    Of several shortest ways each step takes the first by name, from the front.
    """
    back = cut(edges.select("src", "dst").distinct())
    front = cut(changed.select("service", F.array("service").alias("path")).distinct())
    seen = front.withColumn("reason", F.lit("changed"))
    levels = [seen]
    known = front.select("service")
    while True:
        step = front.join(back, front["service"] == back["dst"]).select(F.col("src").alias("service"), F.concat("path", F.array("src")).alias("path"))
        front = cut(step.join(known, "service", "left_anti").groupBy("service").agg(F.min("path").alias("path")))
        if front.isEmpty():
            break
        known = cut(known.unionByName(front.select("service")))
        levels.append(front.withColumn("reason", F.lit("dependency")))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select("service", "reason", F.array_join("path", " <- ").alias("path"))

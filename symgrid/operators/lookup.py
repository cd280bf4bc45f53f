"""Lookups by symbol and file: references, dependencies between files, the index, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..codemap import CodeMap
from ..functions.predicates import in_subtree, qualifier_matches, qualifier_names
from ..functions.scalars import facade_name, parent_dir, segments, split_qualified, stem
from ..plans.storage import cut, spread

MOST_REFERENCES, MOST_EDGE_SYMBOLS, PAGE = 500, 20, 500
#: Files in one row when the files of a class are named.
BLOCK = 1000


def routes(m: CodeMap, name: str) -> DataFrame:
    """``facade, module, path, line, glob``: where ``name`` is published again, by name or with everything of a module."""
    f = m.imports.where("reexport").join(m.files.select("file_id", "path"), "file_id")
    hit = F.array_contains("names", name) | (F.size("names") == 0)
    return f.where(hit).select(facade_name("path").alias("facade"), "module", "path", "line", (F.size("names") == 0).alias("glob"))


def definitions(m: CodeMap, symbol: str) -> DataFrame:
    """``kind, file_id, path, line, detail, narrowed``: definitions of a symbol, ``a::b`` or ``a.b`` narrowed to what ``a`` names.

    A qualifier narrows by the file's stem, a method's type or a constant's type, also through a file
    that publishes the name again. Where it narrows anything only that is returned; where it narrows
    nothing, all are returned with ``narrowed`` false: they share the name and are not the symbol.
    """
    q = m.spark.range(1).select(split_qualified(F.lit(symbol)).alias("q")).first()["q"]
    name, want = q["name"], q["qualifier"]
    funcs = m.funcs.where(F.col("name") == name).select(F.lit("func").alias("kind"), "file_id", "line", F.col("ret").alias("detail"), "owner")
    consts = m.consts.where(F.col("name") == name).select(F.lit("const").alias("kind"), "file_id", "line", F.col("ty").alias("detail"), F.col("ty").alias("owner"))
    types = m.types.where(F.col("name") == name).select(F.lit("type").alias("kind"), "file_id", "line", F.col("kind").alias("detail"), F.lit(None).cast("string").alias("owner"))
    d = funcs.unionByName(consts).unionByName(types).join(m.files.select("file_id", "path"), "file_id").withColumn("stem", stem("path"))
    if want is None:
        return d.select("kind", "file_id", "path", "line", "detail", F.lit(True).alias("narrowed"))
    named = lambda by: qualifier_names(by, F.col("stem")) | F.coalesce(qualifier_names(by, F.col("owner")), F.lit(False))
    via = routes(m, name).where(qualifier_names(F.lit(want), F.col("facade"))).select("module").distinct()
    seen = d.join(F.broadcast(via.limit(MOST_REFERENCES)), named(F.col("module")), "left_semi").select("kind", "file_id", "line").distinct().withColumn("via", F.lit(True))
    d = d.join(seen, ["kind", "file_id", "line"], "left").withColumn("narrowed", named(F.lit(want)) | F.coalesce("via", F.lit(False)))
    any_ = F.max("narrowed").over(Window.partitionBy())
    return d.withColumn("any", any_).where("narrowed or not any").select("kind", "file_id", "path", "line", "detail", "narrowed")


def references(m: CodeMap, symbol: str, most: int = MOST_REFERENCES) -> DataFrame:
    """``kind, path, line, caller, qualifier, total``: calls, uses, imports and re-exports of a symbol, in order of path and line.

    With a qualifier, those whose own qualifier ends in it. An import counts if it binds the name, or
    binds nothing and its module ends in it. ``total`` counts all, also beyond ``most``.
    """
    q = m.spark.range(1).select(split_qualified(F.lit(symbol)).alias("q")).first()["q"]
    name, want = q["name"], q["qualifier"]
    ok = (lambda c: F.lit(True)) if want is None else (lambda c: F.coalesce(qualifier_matches(c, F.lit(want)), F.lit(False)))
    sites = [t.where((F.col("name") == name) & ok("qualifier")).select(F.lit(k).alias("kind"), "file_id", "line", "caller", "qualifier") for k, t in (("call", m.calls), ("use", m.uses))]
    tail = (F.size("names") == 0) & (F.regexp_extract("module", "([A-Za-z0-9_]*)$", 1) == name)
    imps = m.imports.where((F.array_contains("names", name) | tail) & ok("module")).select(F.when(F.col("reexport"), "reexport").otherwise("import").alias("kind"), "file_id", "line", F.lit(None).cast("string").alias("caller"), F.col("module").alias("qualifier"))
    r = sites[0].unionByName(sites[1]).unionByName(imps).join(m.files.select("file_id", "path"), "file_id").select("kind", "path", "line", "caller", "qualifier")
    total = r.agg(F.count(F.lit(1)).alias("total"))
    return r.orderBy("path", "line", "kind", F.col("caller").asc_nulls_first(), F.col("qualifier").asc_nulls_first()).limit(most).crossJoin(F.broadcast(total))


def _two(rows: DataFrame, *by: str) -> DataFrame:
    """``<by>, target, many``: up to two targets of each key, or one row that says there are more."""
    n = rows.groupBy(*by).agg(F.count_distinct("target").alias("n"), F.min("target").alias("lo"), F.max("target").alias("hi"), F.max("many").alias("many"))
    many = F.col("many") | (F.col("n") > 2)
    kept = F.when(many, F.array(F.lit(None).cast("long"))).otherwise(F.array_distinct(F.array("lo", "hi")))
    return n.select(*by, F.explode(kept).alias("target"), many.alias("many"))


def file_links(m: CodeMap) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What edges between files come from, and what files answer to.

    ``src, word, symbol``: imports, by every segment of their module that is a file and by imported names
    that are files. ``file_id, name, n, dst``: calls of names that the file does not define, by how many
    files they may mean: 0, 1 (``dst``) or 2 for more. ``word, dst``: the files a word stands for.

    A call may mean a file that defines its name and that the qualifier names, that the name or the
    qualifier was imported from, or that a facade named by the qualifier imports the name from. Common
    words stand for many files and are said by many, so words are joined with words; of the files they
    come to, two are kept or that there are more, which is all that counting to two asks for.
    """
    m.fix("files", "funcs", "calls", "imports")
    s = m.files.select(F.col("file_id").alias("dst"), stem("path").alias("word"), F.element_at(F.split(parent_dir("path"), "/"), -1).alias("dir"))
    words = cut(s.select("word", "dst").unionByName(s.where(F.col("word").isin("__init__", "index", "mod") & (F.col("dir") != "")).select(F.col("dir").alias("word"), "dst")).distinct())
    known = words.select("word").distinct()
    defs = cut(m.funcs.select("name", F.col("file_id").alias("dst")).distinct())
    imps = m.imports.select("file_id", "module", "names").distinct()
    by_seg = cut(imps.select("file_id", "names", F.explode(segments("module")).alias("word")).join(known, "word").distinct())
    by_name = imps.select("file_id", F.explode("names").alias("word")).join(known, "word").select("file_id", "word", F.col("word").alias("symbol"))
    named = cut(by_seg.select("file_id", "word", F.explode("names").alias("symbol")).unionByName(by_name).distinct())
    whole = cut(by_seg.where(F.size("names") == 0).select("file_id", "word").distinct())
    first = named.unionByName(whole.withColumn("symbol", F.col("word"))).select(F.col("file_id").alias("src"), "word", "symbol").distinct()
    c = m.calls.select("file_id", "name", "qualifier").distinct().join(defs.select(F.col("dst").alias("file_id"), "name"), ["file_id", "name"], "left_anti").join(defs.select("name").distinct(), "name", "left_semi").withColumn("k", F.monotonically_increasing_id())
    c = cut(c)
    segs = cut(c.select("k", "file_id", "name", F.explode(F.array_distinct(segments("qualifier"))).alias("word")))
    sure = F.lit(False).alias("many")
    met = cut(_two(defs.join(words, "dst").select("word", "name", F.col("dst").alias("target"), sure), "word", "name"))
    by_stem = _two(defs.join(s.select("word", "dst"), "dst").select("word", "name", F.col("dst").alias("target"), sure), "word", "name")
    row = ["target", "many"]
    # the file of that name
    hits = segs.join(by_stem, ["word", "name"]).select("k", *row)
    # imported under the name, or with everything
    pairs = c.select("file_id", "name").distinct()
    mine = named.withColumnRenamed("symbol", "name").join(met, ["word", "name"]).select("file_id", "name", *row)
    mine = mine.unionByName(pairs.join(met, "name").join(whole, ["file_id", "word"], "left_semi").select("file_id", "name", *row))
    hits = hits.unionByName(c.join(_two(mine, "file_id", "name"), ["file_id", "name"]).select("k", *row))
    # the qualifier was imported from it
    under = segs.withColumnRenamed("word", "symbol").join(named, ["file_id", "symbol"])
    hits = hits.unionByName(under.join(met, ["word", "name"]).select("k", *row))
    both = segs.join(defs.withColumnRenamed("name", "word"), "word").join(defs, ["dst", "name"]).select("k", "file_id", "dst")
    hits = hits.unionByName(both.join(words, "dst").join(whole, ["file_id", "word"], "left_semi").select("k", F.col("dst").alias("target"), sure).distinct())
    # a facade of that name imports it; not from itself
    at = words.withColumnRenamed("dst", "file_id")
    facade = named.withColumnRenamed("symbol", "name").join(met, ["word", "name"]).where("many or target <> file_id").select("file_id", "name", *row).join(at, "file_id").select("word", "name", *row)
    leads = at.join(whole.withColumnRenamed("word", "to"), "file_id").groupBy("word", "to").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("a"))
    asked = segs.select("word", "name").distinct().join(known, "word", "left_semi")
    far = asked.join(met.withColumnRenamed("word", "to"), "name").join(leads, ["word", "to"]).where("many or n > 1 or a <> target")
    facade = _two(facade.unionByName(far.select("word", "name", *row)), "word", "name")
    hits = hits.unionByName(segs.join(facade, ["word", "name"]).select("k", *row))
    n = hits.groupBy("k").agg(F.min("target").alias("dst"), F.max("target").alias("to"), F.max("many").alias("many"))
    n = n.select("k", "dst", F.when(F.col("many") | (F.col("dst") != F.col("to")), 2).otherwise(1).alias("n"))
    state = cut(c.join(n, "k", "left").select("file_id", "name", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("dst")).alias("dst")))
    return first, state, words


def unlinked(m: CodeMap) -> DataFrame:
    """``name, reason``: names of calls that may mean no other file, or more than one."""
    _, state, _ = file_links(m)
    return state.where("n <> 1").select("name", F.when(F.col("n") == 0, "excluded").otherwise("ambiguous").alias("reason")).distinct()


def dependencies(m: CodeMap, most: int = MOST_EDGE_SYMBOLS) -> DataFrame:
    """``src, dst, n_symbols, symbols``: edges between files with their first ``most`` symbols by name.

    Files that answer to the same words have the same edges from imports, so these are put together for
    each such class, and each row only names its files at the end, without another shuffle. Just the
    pairs of files that a call ties as well are put together pair by pair.
    """
    links, state, words = file_links(m)
    of = words.groupBy("dst").agg(F.array_sort(F.collect_set("word")).alias("words"))
    # files by class, in blocks, so that no row is longer than those
    block = F.floor((F.row_number().over(Window.partitionBy("words").orderBy("dst")) - 1) / BLOCK)
    of = cut(of.withColumn("block", block))
    kinds = cut(of.select("words").distinct().withColumn("kind", F.monotonically_increasing_id()))
    of = cut(of.join(kinds, "words").select("kind", "block", "dst"))
    files = cut(of.groupBy("kind", "block").agg(F.collect_list("dst").alias("files")))
    base = cut(links.join(kinds.select("kind", F.explode("words").alias("word")), "word").select("src", "kind", "symbol").distinct())
    called = cut(state.where("n = 1").select(F.col("file_id").alias("src"), "dst", F.col("name").alias("symbol")).distinct())
    own = cut(called.select("src", "dst").distinct().join(of, "dst").select("src", "dst", "kind"))

    def listed(rows: DataFrame, *by: str) -> DataFrame:
        r = rows.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("symbol")))
        return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n_symbols"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("i") <= most, F.col("symbol")))), ",").alias("symbols"))

    both = listed(called.unionByName(own.join(base, ["src", "kind"]).select("src", "dst", "symbol")).distinct(), "src", "dst")
    apart = own.groupBy("src", "kind").agg(F.collect_list("dst").alias("apart"))
    rows = spread(cut(listed(base, "src", "kind").join(apart, ["src", "kind"], "left")))
    away = F.array_except("files", F.concat(F.array("src"), F.coalesce("apart", F.array().cast("array<long>"))))
    alike = rows.join(files, "kind").select("src", F.explode(away).alias("dst"), "n_symbols", "symbols")
    return alike.unionByName(both)


def file_counts(m: CodeMap, prefix: str = "") -> DataFrame:
    """``path, language, funcs, consts, refs, notes, mods, exports``: the index, all or below a directory."""
    f = m.files.where(in_subtree("path", prefix)).select("file_id", "path", "language")
    parts = {k: df.select("file_id", F.lit(1).alias("w")) for k, df in {"funcs": m.funcs, "consts": m.consts, "refs": m.refs, "notes": m.notes, "mods": m.modules}.items()}
    parts["exports"] = m.imports.where("reexport").select("file_id", F.greatest(F.size("names"), F.lit(1)).alias("w"))
    all_ = None
    for k, df in parts.items():
        one = df.groupBy("file_id").agg(F.sum("w").alias("n")).select("file_id", F.lit(k).alias("k"), "n")
        all_ = one if all_ is None else all_.unionByName(one)
    n = all_.groupBy("file_id").agg(*[F.sum(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in parts])
    return f.join(n, "file_id", "left").select("path", "language", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in parts])


def totals(counts: DataFrame) -> DataFrame:
    """One row: files and sums of the index."""
    return counts.agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts.columns[2:]])


def page(df: DataFrame, *order: str, offset: int = 0, limit: int | None = None, default: int = PAGE) -> DataFrame:
    """Rows ``offset`` and on in a given order, 1 to max(``default``, 500) of them."""
    n = min(max(limit or default, 1), max(default, PAGE))
    return df.orderBy(*order).offset(max(offset, 0)).limit(n)


def find_file(m: CodeMap, key: str) -> DataFrame:
    """``file_id, path, how``: what a key means: the file of that path; else all whose path ends in it; else up to ten that hold it.

    ``how`` is exact, suffix, ambiguous (several end in it) or close; no row means no file at all.
    """
    key = key.strip().removeprefix("./")
    f = m.files.select("file_id", "path")
    how = F.when(F.col("path") == key, 0).when(F.col("path").endswith(key), 1).when(F.contains(F.lower("path"), F.lit(key.lower())), 2)
    hit = f.withColumn("r", how).where("r is not null")
    best = hit.groupBy("r").agg(F.count(F.lit(1)).alias("n")).orderBy("r").limit(1)
    named = F.when(F.col("r") == 0, "exact").when((F.col("r") == 1) & (F.col("n") == 1), "suffix").when(F.col("r") == 1, "ambiguous").otherwise("close")
    out = hit.join(F.broadcast(best), "r").select("file_id", "path", named.alias("how"))
    return out.withColumn("i", F.row_number().over(Window.partitionBy("how").orderBy("path"))).where("how <> 'close' or i <= 10").drop("i")


def suggest(m: CodeMap, want: str, most: int = 8) -> DataFrame:
    """``name, kind, path``: the nearest names to one that was not found; types before functions before constants before imports."""
    from ..functions.scalars import name_distance

    at = m.files.select("file_id", "path")
    parts = [(0, "type", m.types.select("name", "file_id")), (1, "func", m.funcs.select("name", "file_id")), (2, "const", m.consts.select("name", "file_id")), (3, "import", m.imports.select(F.explode("names").alias("name"), "file_id"))]
    all_ = None
    for r, k, df in parts:
        one = df.join(at, "file_id").withColumn("score", name_distance(F.lit(want.strip()), "name")).where("score is not null").select(F.lower("name").alias("low"), F.struct("score", F.lit(r).alias("r"), F.col("name"), F.col("path"), F.lit(k).alias("kind")).alias("s"))
        all_ = one if all_ is None else all_.unionByName(one)
    best = all_.groupBy("low").agg(F.min("s").alias("s")).select("s.*")
    return best.orderBy("score", "r", "name").limit(most).select("name", "kind", "path")


def qualifier_evidence(m: CodeMap, qualifier: str, shown: int = 3) -> DataFrame:
    """``path, line, name, sites``: the first calls and uses under a qualifier, and how many there are in all."""
    from ..functions.predicates import qualifier_under

    c = m.calls.select("file_id", "line", "name", "qualifier").unionByName(m.uses.select("file_id", "line", "name", "qualifier"))
    hit = c.where(F.coalesce(qualifier_under("qualifier", F.lit(qualifier)), F.lit(False))).join(m.files.select("file_id", "path"), "file_id").select("path", "line", "name")
    n = hit.agg(F.count(F.lit(1)).alias("sites"))
    return hit.orderBy("path", "line", "name").limit(shown).crossJoin(F.broadcast(n))


def qualifier_evidence_of_miss(m: CodeMap, symbol: str) -> DataFrame:
    """``searched, suggestion, kind, sites``: what a lookup that found nothing can go on with; one row at least."""
    q = m.spark.range(1).select(split_qualified(F.lit(symbol)).alias("q")).first()["q"]
    s = suggest(m, q["name"]).select(F.col("name").alias("suggestion"), "kind")
    n = qualifier_evidence(m, q["qualifier"]).agg(F.coalesce(F.max("sites"), F.lit(0)).alias("sites")) if q["qualifier"] else m.spark.range(1).select(F.lit(0).cast("long").alias("sites"))
    one = m.spark.range(1).select(F.lit("func, const, type, call, use, import, reexport").alias("searched")).crossJoin(n)
    return one.join(s, F.lit(True), "left").select("searched", "suggestion", "kind", "sites")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing but themselves calls."""
    called = edges.where("src <> dst").select(F.col("dst").alias("node_id")).distinct()
    return nodes.join(called, "node_id", "left_anti")


def edge_sites(m: CodeMap, nodes: DataFrame, edges: DataFrame, member: DataFrame, most: int = 60) -> DataFrame:
    """``src, dst, symbol, caller, path``: calls between services with both ends, each symbol of an edge once, at most ``most`` of an edge.

    A function in several services counts for each; of several callers of a symbol the first by path and name.
    """
    at = nodes.select("node_id", "file_id", "name").join(member.select("file_id", "path", "service"), "file_id")
    a = at.select(F.col("node_id").alias("src"), F.col("service").alias("s"), F.col("name").alias("caller"), "path")
    b = at.select(F.col("node_id").alias("dst"), F.col("service").alias("d"), F.col("name").alias("symbol"))
    hit = edges.select("src", "dst").join(a, "src").join(b, "dst").where("s <> d")
    one = hit.groupBy("s", "d", "symbol").agg(F.min(F.struct("path", "caller")).alias("x"))
    r = one.withColumn("i", F.row_number().over(Window.partitionBy("s", "d").orderBy("symbol")))
    return r.where(F.col("i") <= most).select(F.col("s").alias("src"), F.col("d").alias("dst"), "symbol", "x.caller", "x.path")


def complexity_filter(table: DataFrame, name: str = "", arities: tuple[str, ...] = (), low: int = 1, high: int = 10, tests: bool = True) -> DataFrame:
    """Rows of a complexity table by part of the name or path, arities, range of bands, with or without tests."""
    t = table.where(F.col("band").between(low, high))
    if name:
        t = t.where(F.contains(F.lower("name"), F.lit(name.lower())) | F.contains(F.lower("path"), F.lit(name.lower())))
    if arities:
        t = t.where(F.col("arity").isin(*arities))
    return t if tests else t.where("not is_test")


def by_band(table: DataFrame) -> DataFrame:
    """``band, functions, tests, greatest``: a complexity table by band."""
    return table.groupBy("band").agg(F.count(F.lit(1)).alias("functions"), F.count(F.when(F.col("is_test"), 1)).alias("tests"), F.max("cx").alias("greatest"))


def fold_hot(nodes: DataFrame, **views: DataFrame) -> DataFrame:
    """``node_id, name`` and the rank in each view (best first, node_id in ``views``); functions of no view are left out.

    ``badge`` names the views in their order.
    """
    all_ = None
    for i, (k, v) in enumerate(views.items()):
        one = v.select("node_id", F.col("rank").cast("int"), F.lit(k).alias("view"), F.lit(i).alias("i"))
        all_ = one if all_ is None else all_.unionByName(one)
    g = all_.groupBy("node_id").agg(*[F.min(F.when(F.col("view") == k, F.col("rank"))).alias(k) for k in views], F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("i", "view"))), lambda x: x["view"]), "+").alias("badge"))
    return nodes.select("node_id", "name").join(g, "node_id")

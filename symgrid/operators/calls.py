"""The call graph: names resolved to definitions by evidence.

All of it is equi joins on names with the evidence as a residual condition, then one aggregation that
keeps a call only where a single definition is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..codemap import CodeMap
from ..plans.storage import cut, spread
from ..functions.scalars import parent_dir, segments, stem
from ..schema import TOP

GENERIC_DIRS = ("src", "pkg", "internal", "cmd", "app", "lib", "test", "tests", "include")
FACADES = ("__init__", "index", "mod")
HOPS = 3
#: Files in one row when the files of a kind are named.
BLOCK = 1000


def span_of(m: CodeMap) -> DataFrame:
    return m.funcs.select("file_id", "name", "node_id", "start_line", "end_line")


def module_frames(m: CodeMap) -> DataFrame:
    """``file_id, node_id``: a frame for each file that calls from its top level; its number is that of no function."""
    return m.calls.where(F.col("caller") == TOP).select("file_id").distinct().select("file_id", (-1 - F.col("file_id")).alias("node_id"))


def nodes(m: CodeMap) -> DataFrame:
    """``node_id, file_id, name, is_module``: functions and module frames."""
    own = m.funcs.select("node_id", "file_id", "name", F.lit(False).alias("is_module"))
    return own.unionByName(module_frames(m).select("node_id", "file_id", F.lit(TOP).alias("name"), F.lit(True).alias("is_module")))


def file_aliases(m: CodeMap) -> DataFrame:
    """``file_id, alias``: stem, modules, types and directories that are not generic."""
    dirs = m.files.select("file_id", F.explode(F.split(parent_dir("path"), "/")).alias("alias")).where(~F.col("alias").isin(*GENERIC_DIRS))
    parts = m.files.select("file_id", stem("path").alias("alias")).unionByName(dirs)
    parts = parts.unionByName(m.modules.select("file_id", F.col("name").alias("alias"))).unionByName(m.types.select("file_id", F.col("name").alias("alias")))
    return parts.where("alias <> ''").distinct()


def same_file_refs(m: CodeMap) -> DataFrame:
    """Calls without receiver type whose name the file itself defines, matched to the first definition."""
    first = m.funcs.groupBy("file_id", "name").agg(F.min_by(F.struct("line", "ret"), "node_id").alias("d"))
    c = m.calls.where("recv_type is null").join(first, ["file_id", "name"])
    return c.select("file_id", "caller", F.col("line").alias("call_line"), F.col("d.line").alias("target_line"), F.lit(1).alias("target_col"), F.col("name").alias("target_name"), F.col("d.ret").alias("target_ret")).distinct()


def import_words(m: CodeMap) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``word, target``: what each file answers to; ``file_id, name, word`` and ``file_id, word``: imports by name and of everything.

    The last segment of a module path decides if any other file answers to it, else all segments do;
    an imported name that is itself a file counts, too. Words are not replaced by the files that
    answer to them: a common word has many, and many imports say it.
    """
    s = m.files.select(F.col("file_id").alias("target"), stem("path").alias("word"), F.element_at(F.split(parent_dir("path"), "/"), -1).alias("dir"))
    answers = s.select("word", "target").unionByName(s.where(F.col("word").isin(*FACADES) & (F.col("dir") != "")).select(F.col("dir").alias("word"), "target")).distinct()
    answers = cut(answers)
    key = ["file_id", "module", "names"]
    imps = m.imports.select(*key).distinct().withColumn("segs", segments("module"))
    # one explode of all that may answer, ranked: last segment 0, other segments 1, imported names 2
    asked = F.concat(
        F.transform("segs", lambda x, i: F.struct(x.alias("word"), F.when(i == F.size("segs") - 1, 0).otherwise(1).alias("rung"))),
        F.transform("names", lambda x: F.struct(x.alias("word"), F.lit(2).alias("rung"))),
    )
    n = answers.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    own = answers.select("word", F.col("target").alias("file_id"), F.lit(1).alias("own"))
    hit = imps.select(*key, F.explode(asked).alias("q")).select(*key, "q.*").join(n, "word").join(own, ["word", "file_id"], "left").where(F.col("n") > F.coalesce("own", F.lit(0)))
    best = F.min(F.when(F.col("rung") < 2, F.col("rung"))).over(Window.partitionBy(*key))
    hit = cut(hit.withColumn("best", best).where("rung = 2 or rung = best").select("file_id", "names", "word").distinct())
    named = hit.select("file_id", F.explode("names").alias("name"), "word").distinct()
    return answers, named, hit.where(F.size("names") == 0).select("file_id", "word").distinct()


def _ways(answers: DataFrame, named: DataFrame, whole: DataFrame, has: DataFrame, defs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph in which imports are followed: nodes, ``u, v`` and ``u, target``: edges, and the definitions at a node.

    A node is a word under which a name (``by``) is asked for: of all files that answer to the word, or
    (``whole``) of those that define the name (``has``), as an import of everything asks. From a node the
    way leads on to what its files import. The graph is as large as the imports and definitions are.
    """
    at = has.join(answers, "target").select("word", *by, "target")
    kinds = named.select("word", *by).distinct().withColumn("whole", F.lit(False)).unionByName(at.join(whole.select("word").distinct(), "word", "left_semi").select("word", *by).distinct().withColumn("whole", F.lit(True)))
    nodes = cut(kinds.withColumn("node", F.monotonically_increasing_id()))
    some, all_ = nodes.where("not whole").drop("whole"), nodes.where("whole").drop("whole")
    on = lambda df, n: df.withColumnRenamed("node", n)
    onto = named.join(some, ["word", *by]).select("file_id", *by, F.col("node").alias("v"))
    own = nodes.join(defs.join(answers, "target").select("word", *by, "target"), ["word", *by]).select(F.col("node").alias("u"), "target")
    through = cut(on(all_, "u").join(at, ["word", *by]).select("u", *by, F.col("target").alias("file_id")))
    edges = onto.join(answers.withColumnRenamed("target", "file_id"), "file_id").select("word", *by, "v").distinct().join(on(some, "u"), ["word", *by]).select("u", "v")
    edges = edges.unionByName(through.join(onto, ["file_id", *by]).select("u", "v"))
    leads = answers.join(whole.select(F.col("file_id").alias("target"), F.col("word").alias("to")), "target").select("word", "to").distinct()
    goal = on(all_, "v").withColumnRenamed("word", "to")
    edges = edges.unionByName(on(some, "u").join(goal, by).join(leads, ["word", "to"]).select("u", "v"))
    edges = edges.unionByName(through.join(whole, "file_id").withColumnRenamed("word", "to").join(goal, ["to", *by]).select("u", "v"))
    return nodes, cut(edges.where("u <> v").distinct()), cut(own)


def imported_definitions(m: CodeMap, keys: DataFrame, defs: DataFrame, hops: int = HOPS) -> DataFrame:
    """``file_id, <by>, target, many``: which of ``defs`` (target, <by>) the ``keys`` (file_id, <by>) may have imported.

    ``by`` is the name, with or without more. Whoever asks wants the one definition, if there is just one
    in another file: so more than two files are told by ``many`` (with a null ``target``), which adds up
    over any number of facades without a list of them, and a file itself can be taken away from two.
    The ways are those of ``imported_names``: up to two to the power of ``hops`` imports long.
    """
    by = [c for c in keys.columns if c != "file_id"]
    answers, named, whole = import_words(m)
    defs = cut(defs.select("target", *by).distinct().join(keys.select(*by).distinct(), by, "left_semi"))
    named = cut(named.join(defs.select(*by).distinct(), "name"))
    has = m.funcs.select(F.col("file_id").alias("target"), "name").distinct().join(defs.select(*by).distinct(), "name")
    nodes, edges, own = _ways(answers, named, whole, has, defs, by)
    met = _few(own.select(F.col("u").alias("node"), "target", F.lit(False).alias("many"), F.lit(False).alias("was")))
    state, front = met, met
    for _ in range(2**hops - 1):
        come = front.join(edges, front["node"] == edges["v"]).select(F.col("u").alias("node"), "target", "many", F.lit(False).alias("was")).distinct()
        state = _few(state.select("node", "target", "many", F.lit(True).alias("was")).unionByName(come))
        front = state.where("grew")
        if front.isEmpty():
            break
    found = state.select("node", "target", "many").join(nodes, "node")
    asked = found.where("whole").join(keys, by).join(whole, ["file_id", "word"], "left_semi").select("file_id", *by, "target", "many")
    asked = asked.unionByName(found.where("not whole").join(named, ["word", *by]).join(keys, ["file_id", *by], "left_semi").select("file_id", *by, "target", "many"))
    return asked.where("many or target <> file_id").distinct()


def _few(rows: DataFrame) -> DataFrame:
    """``node, target, many, grew``: up to two targets of each node, or one row that says there are more; ``grew`` beyond what ``was`` there."""
    n = rows.groupBy("node").agg(F.count_distinct("target").alias("n"), F.min("target").alias("lo"), F.max("target").alias("hi"), F.max("many").alias("more"), F.count(F.when(F.col("was"), 1)).alias("before"), F.max(F.col("was") & F.col("many")).alias("full"))
    n = n.withColumn("many", F.col("more") | (F.col("n") > 2)).withColumn("grew", ~F.col("full") & (F.col("many") | (F.col("n") > F.col("before"))))
    kept = F.when(F.col("many"), F.array(F.lit(None).cast("long"))).otherwise(F.array_distinct(F.array("lo", "hi")))
    return cut(n.select("node", F.explode(kept).alias("target"), "many", "grew"))


def imported_names(m: CodeMap, hops: int = HOPS) -> DataFrame:
    """``file_id, name, target``: from which files a name may have been imported.

    An import without names brings in all functions of its targets. Bindings are followed through
    facades, which pass a name on under the name it has, over up to two to the power of ``hops`` imports.
    The ways are found between words (see ``import_words``); only the outcome names files.
    """
    m.fix("files", "funcs", "imports")
    answers, named, whole = import_words(m)
    named, whole = cut(named), cut(whole)
    defs = m.funcs.select(F.col("file_id").alias("target"), "name").distinct()
    nodes, edges, own = _ways(answers, named, whole, defs, defs, ["name"])
    start = nodes.select(F.col("node").alias("u"), F.col("node").alias("v"))
    seen, front = start, start
    for _ in range(2**hops - 1):
        step = front.join(edges.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v")).distinct()
        front = cut(step.join(seen, ["u", "v"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    # files that answer to the same words are of one kind: of these, rows differ, so that none needs to be compared
    of = answers.groupBy("target").agg(F.array_sort(F.collect_set("word")).alias("words"))
    kinds = cut(of.select("words").distinct().withColumn("kind", F.monotonically_increasing_id()))
    of = cut(of.join(kinds, "words").withColumn("block", F.floor((F.row_number().over(Window.partitionBy("kind").orderBy("target")) - 1) / BLOCK)).select("kind", "block", "target"))
    files = cut(of.groupBy("kind", "block").agg(F.collect_list("target").alias("files")))
    # what each node comes to: kinds of which all files count, and single files
    to = cut(seen.join(nodes.withColumnRenamed("node", "v"), "v").select("u", "v", "word", "whole"))
    start = nodes.select(F.col("node").alias("u"), F.col("word").alias("by"), "name", F.col("whole").alias("all"))
    some = cut(to.where("not whole").join(kinds.select("kind", F.explode("words").alias("word")), "word").select("u", "kind").distinct().join(start, "u").drop("u"))
    one = cut(to.where("whole").join(own.withColumnRenamed("u", "v"), "v").select("u", "target").distinct().join(start, "u").drop("u"))

    def asked(df: DataFrame, *cols: str) -> DataFrame:
        """For the files that import by name, and, in all tasks as it has many rows, for those that import everything."""
        df = df.withColumnRenamed("by", "word")
        x = df.where("not all").join(named, ["word", "name"]).select("file_id", "name", *cols)
        return spread(x.unionByName(spread(df.where("all")).join(whole, "word").select("file_id", "name", *cols)), "file_id", "name").distinct()

    many = cut(asked(some, "kind"))
    single = asked(one, "target").join(of, "target").join(many, ["file_id", "name", "kind"], "left_anti").where("target <> file_id").select("file_id", "name", "target")
    rest = F.array_except("files", F.array("file_id"))
    return spread(many, "file_id", "name").join(files, "kind").select("file_id", "name", F.explode(rest).alias("target")).unionByName(single)


def owners(m: CodeMap, sites: DataFrame, caller: str, line: str) -> DataFrame:
    """``sites`` with ``src``, the node of the calling definition.

    Of several definitions of the name in the file, the innermost whose lines hold the call; where
    none does, the first. Sites without any such definition drop out.
    """
    spans = span_of(m).select("file_id", F.col("name").alias("__n"), "node_id", "start_line", "end_line")
    spans = spans.unionByName(module_frames(m).select("file_id", F.lit(TOP).alias("__n"), "node_id", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line")))
    keys = sites.select("file_id", F.col(caller).alias("__n"), F.col(line).alias("__l")).distinct()
    inside = F.coalesce((F.col("start_line") <= F.col("__l")) & (F.col("__l") <= F.col("end_line")), F.lit(False))
    # false sorts before true: spanning first, then the greatest start, the greatest node; else the least node
    rank = F.when(inside, F.struct(F.lit(1).alias("a"), F.col("start_line").alias("b"), F.col("node_id").alias("c"))).otherwise(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), (-F.col("node_id")).alias("c")))
    own = keys.join(spans, ["file_id", "__n"]).groupBy("file_id", "__n", "__l").agg(F.max_by("node_id", rank).alias("src"))
    return sites.join(own.withColumnsRenamed({"__n": caller, "__l": line}), ["file_id", caller, line])


def call_edges(m: CodeMap) -> DataFrame:
    """``src, dst, sites``: distinct edges of the call graph and how often each counts as a call site.

    Same-file references; else the one definition of (receiver type, name); else the one definition in
    another file that a qualifier's identifier names or the name was imported from. References count
    first, then calls in the order of their lines: an evident call always counts, a receiver-typed one
    only if it is the first of its edge (on one line, evident ones come first); a receiver-typed call of
    the function itself is no edge. The tables that are read several times are checkpointed first, and
    so is the outcome.
    """
    if "edges" in m.derived:
        return m.derived["edges"]
    m.fix("files", "funcs", "calls", "imports")
    m.tables["refs"] = same_file_refs(m) if m.derive_refs else m.refs
    m.fix("refs")
    refs = m.refs.select("file_id", "caller", F.col("call_line").alias("line"), "target_name")
    # which definition each place belongs to is asked three times below
    places = m.calls.select("file_id", "caller", "line").unionByName(refs.select("file_id", "caller", "line")).distinct()
    at = cut(owners(m, places, "caller", "line"))
    place = ["file_id", "caller", "line"]
    first = m.funcs.groupBy("file_id", "name").agg(F.min("node_id").alias("dst"))
    local = refs.join(at, place).join(first.withColumnRenamed("name", "target_name"), ["file_id", "target_name"]).select("src", "dst")
    has = m.funcs.select("file_id", "name").distinct().unionByName(module_frames(m).select("file_id", F.lit(TOP).alias("name")))
    # equal calls resolve alike: resolve each once, count them again at the end
    c = m.calls.groupBy("file_id", "caller", "line", "name", "qualifier", "recv_type").agg(F.count(F.lit(1)).alias("n"))
    typed = c.where("recv_type is not null")
    plain = c.where("recv_type is null").join(has, ["file_id", "name"], "left_anti")
    method = m.funcs.where("owner is not null").groupBy(F.col("owner").alias("recv_type"), "name").agg(F.count(F.lit(1)).alias("defs"), F.min("node_id").alias("dst")).where("defs = 1").drop("defs")
    typed = typed.join(method, ["recv_type", "name"], "left")
    by_type = typed.where("dst is not null").join(at, place).where("src <> dst").groupBy("src", "dst").agg(F.min("line").alias("typed"))
    rest = cut(plain.unionByName(typed.where("dst is null").drop("dst").select(*plain.columns)))
    cand = m.funcs.select("name", F.col("node_id").alias("dst"), F.col("file_id").alias("target"))
    call = ["file_id", "name", "qualifier"]
    keys = cut(rest.select(*call).distinct())
    named = keys.select("file_id", "name").distinct()
    # definitions by name and what their file is called, so that a common directory name meets few of them
    called = cand.join(file_aliases(m).select("alias", F.col("file_id").alias("target")), "target")
    by_alias = keys.withColumn("alias", F.explode(F.array_distinct(segments("qualifier")))).join(called, ["name", "alias"])
    bound = imported_definitions(m, named, cand.select("name", "target")).join(cand, ["name", "target"], "left").groupBy("file_id", "name").agg(F.min("dst").alias("dst"), F.max("dst").alias("to"), F.max("many").alias("many"))
    by_import = keys.join(bound, ["file_id", "name"])
    evident = by_alias.where("target <> file_id").select(*call, "dst", F.col("dst").alias("to"), F.lit(False).alias("many")).unionByName(by_import.select(*call, "dst", "to", "many"))
    one = evident.groupBy(*call).agg(F.min("dst").alias("dst"), F.max("to").alias("to"), F.max("many").alias("many")).where("dst = to and not many").select(*call, "dst")
    same = (F.col("r.file_id") == F.col("o.file_id")) & (F.col("r.name") == F.col("o.name")) & F.col("r.qualifier").eqNullSafe(F.col("o.qualifier"))
    matched = rest.alias("r").join(one.alias("o"), same).select("r.*", "dst")
    cross = matched.join(at, place).groupBy("src", "dst").agg(F.sum("n").alias("evident"), F.min("line").alias("line"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    parts = local.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("local")).select("src", "dst", "local", *none("long", "evident"), *none("int", "line", "typed"))
    parts = parts.unionByName(cross.select("src", "dst", *none("long", "local"), "evident", "line", *none("int", "typed"))).unionByName(by_type.select("src", "dst", *none("long", "local", "evident"), *none("int", "line"), "typed"))
    g = parts.groupBy("src", "dst").agg(*[F.max(x).alias(x) for x in ("local", "evident", "line", "typed")])
    leads = F.col("typed").isNotNull() & F.col("local").isNull() & (F.col("line").isNull() | (F.col("typed") < F.col("line")))
    sites = F.coalesce("local", F.lit(0)) + F.coalesce("evident", F.lit(0)) + F.when(leads, 1).otherwise(0)
    m.derived["edges"] = cut(g.select("src", "dst", sites.cast("long").alias("sites")))
    return m.derived["edges"]


def degrees(all_nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, callers, callees, call_sites`` of every node."""
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("callers"), F.sum("sites").alias("call_sites"))
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("callees"))
    j = all_nodes.select("node_id").join(into, "node_id", "left").join(out, "node_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return j.select("node_id", zero("callers"), zero("callees"), zero("call_sites"))


def known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))

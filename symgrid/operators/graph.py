"""Cycles, chains and trees of the call graph, and services where no configuration names them.

All loops run over levels that are materialised and shrink; their number follows the length of the
longest way in the graph, never its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..codemap import CodeMap
from ..plans.storage import cut

MOST_CYCLES, MOST_MEMBERS, MOST_CHAINS = 25, 12, 25
FLAME_DEPTH, FLAME_NODES = 14, 1200


def components(edges: DataFrame) -> DataFrame:
    """``node_id, cycle``: the strongly connected component (its greatest node) of nodes in one of more than one node.

    Forward colouring: every node takes the greatest node that reaches it; what reaches back to that
    node within its colour is a component. Nodes without a way in or out drop out first.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    found = []
    while not e.isEmpty():
        while True:  # no way in or no way out: a component of its own
            inner = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            same = inner.count() == e.count()
            e = inner
            if same:
                break
        if e.isEmpty():
            break
        colour = cut(e.select(F.col("src").alias("node_id")).distinct().withColumn("colour", F.col("node_id")))
        while True:
            come = e.join(colour.withColumnRenamed("node_id", "src"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.max("colour").alias("come"))
            new = cut(colour.join(come, "node_id", "left").select("node_id", F.greatest("colour", F.coalesce("come", "colour")).alias("colour"), (F.col("come") > F.col("colour")).alias("grew")))
            grew = not new.where("grew").isEmpty()
            colour = new.drop("grew")
            if not grew:
                break
        ends = colour.withColumnsRenamed({"node_id": "src", "colour": "cs"})
        inside = cut(e.join(ends, "src").join(colour.withColumnsRenamed({"node_id": "dst", "colour": "cd"}), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("colour")))
        front = cut(colour.where("node_id = colour"))
        seen = front
        while True:
            step = inside.join(front.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node_id"), "colour").distinct()
            front = cut(step.join(seen, "node_id", "left_anti"))
            if front.isEmpty():
                break
            seen = cut(seen.unionByName(front))
        size = seen.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(cut(seen.join(size, "colour", "left_semi").select("node_id", F.col("colour").alias("cycle"))))
        left = inside.join(seen.select(F.col("node_id").alias("src")), "src", "left_anti").join(seen.select(F.col("node_id").alias("dst")), "dst", "left_anti")
        e = cut(left.select("src", "dst"))
    if not found:
        return edges.sparkSession.createDataFrame([], "node_id long, cycle long")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def cycles(member: DataFrame, most: int = MOST_CYCLES, shown: int = MOST_MEMBERS) -> DataFrame:
    """``cycle, size, members``: the largest cycles, each with its first ``shown`` nodes."""
    w = Window.partitionBy("cycle").orderBy("node_id")
    r = member.withColumn("i", F.row_number().over(w))
    g = r.groupBy("cycle").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("i") <= shown, F.col("node_id")))), lambda x: x.cast("string")), ",").alias("members"))
    return g.orderBy(F.desc("size"), "cycle").limit(most)


def _condensed(nodes: DataFrame, edges: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's component (itself, outside cycles), and the edges between components."""
    at = cut(nodes.select("node_id").join(member, "node_id", "left").select("node_id", F.coalesce("cycle", "node_id").alias("c")))
    e = edges.select("src", "dst").join(at.select(F.col("node_id").alias("src"), F.col("c").alias("a")), "src").join(at.select(F.col("node_id").alias("dst"), F.col("c").alias("b")), "dst")
    return at, cut(e.where("a <> b").select("a", "b").distinct())


def chain_levels(nodes: DataFrame, edges: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Components of nodes, edges between them, and ``c, depth``: the longest way down from each component."""
    at, e = _condensed(nodes, edges, member)
    level = cut(at.select("c").distinct().join(e.select(F.col("a").alias("c")).distinct(), "c", "left_anti"))
    parts, done, rest, d = [level.withColumn("depth", F.lit(0))], level, e, 0
    while True:
        # a component is done once all below it are; the last of them was done a level ago
        rest = cut(rest.join(done.withColumnRenamed("c", "b"), "b", "left_anti")) if d else rest
        waiting = rest.join(level.withColumnRenamed("c", "b"), "b", "left_anti").select("a").distinct()
        up = rest.join(level.withColumnRenamed("c", "b"), "b", "left_semi").select("a").distinct()
        d += 1
        done, level = level, cut(up.join(waiting, "a", "left_anti").select(F.col("a").alias("c")))
        if level.isEmpty():
            break
        parts.append(level.withColumn("depth", F.lit(d)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return at, e, cut(out)


def depth_below(nodes: DataFrame, edges: DataFrame, member: DataFrame) -> DataFrame:
    """``node_id, depth``: the longest chain of calls below each node.

    Cycles add nothing: the nodes of one count as one, whatever the order they are walked in.
    """
    at, _, level = chain_levels(nodes, edges, member)
    return at.join(level, "c").select("node_id", "depth")


def deepest_chains(nodes: DataFrame, edges: DataFrame, member: DataFrame, most: int = MOST_CHAINS) -> DataFrame:
    """``root, depth, chain``: the longest chains from nodes that nothing else calls.

    Of several ways on, the deepest, then the least component; a cycle is shown by its greatest node.
    Ties between roots go by node.
    """
    at, e, level = chain_levels(nodes, edges, member)
    called = edges.where("src <> dst").select(F.col("dst").alias("node_id")).distinct()
    roots = at.join(called, "node_id", "left_anti").join(level, "c").where("depth > 0")
    walk = cut(roots.orderBy(F.desc("depth"), "node_id").limit(most).select(F.col("node_id").alias("root"), "depth", F.col("c").alias("last"), F.array("node_id").alias("chain")))
    step = e.join(level.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("last")).agg(F.min(F.struct((-F.col("depth")).alias("d"), F.col("b"))).alias("n"))
    step = cut(step.select("last", F.col("n.b").alias("next")))
    longest = walk.agg(F.max("depth")).first()[0] or 0
    for _ in range(longest):
        walk = cut(walk.join(step, "last", "left").select("root", "depth", F.coalesce("next", "last").alias("last"), F.when(F.col("next").isNull(), F.col("chain")).otherwise(F.concat("chain", F.array("next"))).alias("chain")))
    return walk.select("root", "depth", F.array_join(F.transform("chain", lambda x: x.cast("string")), ",").alias("chain")).orderBy(F.desc("depth"), "root")


def flame(edges: DataFrame, roots: DataFrame, depth: int = FLAME_DEPTH, nodes: int = FLAME_NODES) -> DataFrame:
    """``path, node_id, depth, value, recursive, truncated``: the calls below the ``roots`` as a tree.

    A node that is on the way already is shown and not expanded. The tree has at most ``nodes`` nodes,
    whole levels first, each in order of path, and ``depth`` levels below the roots. ``value`` counts a
    node and all below it; ``truncated`` says that some of its calls are not shown.
    """
    e = cut(edges.select("src", "dst").distinct())
    level = cut(roots.select(F.col("node_id"), F.array("node_id").alias("path"), F.lit(False).alias("recursive")).orderBy("path").limit(nodes))
    left, levels = nodes - level.count(), [level.withColumn("depth", F.lit(0))]
    for d in range(1, depth + 1):
        step = level.where("not recursive").join(e, level["node_id"] == e["src"]).select(F.col("dst").alias("node_id"), F.concat("path", F.array("dst")).alias("path"), F.array_contains("path", F.col("dst")).alias("recursive"))
        level = cut(step.orderBy("path").limit(left)) if left else step.limit(0)
        n = level.count() if left else 0
        if not n:
            break
        left -= n
        levels.append(level.withColumn("depth", F.lit(d)))
    tree = levels[0]
    for x in levels[1:]:
        tree = tree.unionByName(x)
    tree = cut(tree)
    above = tree.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice("path", F.lit(1), i))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("value"))
    kids = tree.where("depth > 0").groupBy(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.count(F.lit(1)).alias("kids"))
    out = e.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("calls"))
    j = tree.join(above, "path").join(kids, "path", "left").join(out, "node_id", "left")
    cutoff = F.coalesce("calls", F.lit(0)) > F.coalesce("kids", F.lit(0))
    return j.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "node_id", "depth", "value", "recursive", cutoff.alias("truncated"))


def fallback_members(m: CodeMap) -> DataFrame:
    """``file_id, path, service``: services by the widest level of directories that splits the tree, else one for each file.

    Files above the level are ``root``.
    """
    parts = F.split("path", "/")
    at = lambda d: F.when(F.size(parts) > d, F.array_join(F.slice(parts, 1, d), "/")).otherwise("root")
    n = m.files.agg(F.count_distinct(at(1)), F.count_distinct(at(2))).first()
    service = at(1) if n[0] > 1 else at(2) if n[1] > 1 else F.col("path")
    return m.files.select("file_id", "path", service.alias("service"))

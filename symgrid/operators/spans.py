"""Lines matched to definitions, and the closure of callers. Range joins have the file as an equi key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..codemap import CodeMap
from ..plans.storage import cut

NEAR, FAR = 10, 8


def changed_functions(m: CodeMap, hunks: DataFrame) -> DataFrame:
    """``node_id, name, path``: definitions whose lines overlap a hunk (``path, start, stop``), ends included."""
    own = m.funcs.select("node_id", "name", "file_id", "start_line", "end_line").join(m.files.select("file_id", "path"), "file_id")
    h = F.broadcast(hunks) if hunks.isLocal() else hunks
    over = (own["path"] == h["path"]) & (h["start"] <= own["end_line"]) & (own["start_line"] <= h["stop"])
    return own.join(h, over, "left_semi").select("node_id", "name", "path")


def bind_annotations(m: CodeMap, near: int = NEAR) -> DataFrame:
    """``file_id, line, key, node_id``: each annotation with the innermost definition around it.

    Where none is around, the nearest that starts within ``near`` lines below; else null. Annotations
    equal in file, line and key are one.
    """
    notes = m.annotations.select("file_id", "line", "key").distinct()
    spans = m.funcs.select("file_id", "node_id", "start_line", "end_line")
    inside = F.col("line").between(F.col("start_line"), F.col("end_line"))
    below = (F.col("start_line") - F.col("line")).between(1, near)
    hit = notes.join(spans, "file_id").where(inside | below)
    rank = F.when(inside, F.struct(F.lit(1).alias("a"), F.col("start_line").alias("b"), F.col("node_id").alias("c"))).otherwise(F.struct(F.lit(0).alias("a"), (-F.col("start_line")).alias("b"), F.col("node_id").alias("c")))
    best = hit.groupBy("file_id", "line", "key").agg(F.max_by("node_id", rank).alias("node_id"))
    return notes.join(best, ["file_id", "line", "key"], "left")


def callers_within(edges: DataFrame, seeds: DataFrame, far: int = FAR) -> DataFrame:
    """``node_id, distance``: all that calls the ``seeds`` (node_id) over at most ``far`` edges, by the shortest way.

    A frontier is joined with the edges and what was seen before drops out; each level is cut, so a
    lost executor costs a level at most. Nodes at the last distance stay and are not expanded.
    """
    back = cut(edges.select("src", "dst").distinct())
    front = cut(seeds.select("node_id").where("node_id is not null").distinct())
    seen = front.withColumn("distance", F.lit(0))
    for d in range(1, far + 1):
        step = back.join(front.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(F.col("src").alias("node_id")).distinct()
        front = cut(step.join(seen, "node_id", "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front.withColumn("distance", F.lit(d))))
    return seen

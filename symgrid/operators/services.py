"""Services as sets of files: membership, calls between them, annotated crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..codemap import CodeMap
from ..functions.predicates import glob_regex
from ..functions.scalars import norm_key, pick_transport


def members(m: CodeMap, services: dict[str, list[str]]) -> DataFrame:
    """``file_id, path, service``: a file is in each service that one of its patterns fits.

    The patterns are part of the plan as one array of conditions per file, so there is no join; their
    number is that of the configuration and does not grow with the data.
    """
    fits = []
    for s, globs in services.items():
        regex = "|".join(f"(?:{r})" for g in globs for r in glob_regex(g))
        fits.append(F.when(F.col("path").rlike(regex), F.lit(s)))
    found = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>")
    return m.files.select("file_id", "path", F.explode(found).alias("service"))


def service_rollup(m: CodeMap, member: DataFrame) -> DataFrame:
    """``service, files, funcs``; files of no service are under null."""
    n = m.funcs.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    own = m.files.select("file_id").join(member.select("file_id", "service"), "file_id", "left").join(n, "file_id", "left")
    return own.groupBy("service").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("funcs"))


def service_edges(nodes: DataFrame, edges: DataFrame, member: DataFrame, deps: dict[str, list[str]]) -> DataFrame:
    """``src, dst, edges, sites, detected, declared``: calls between different services, with the declared dependencies laid over."""
    at = nodes.select("node_id", "file_id").join(member.select("file_id", "service"), "file_id")
    a, b = at.select(F.col("node_id").alias("src"), F.col("service").alias("s")), at.select(F.col("node_id").alias("dst"), F.col("service").alias("d"))
    found = edges.join(a, "src").join(b, "dst").where("s <> d").groupBy("s", "d").agg(F.count(F.lit(1)).alias("edges"), F.sum("sites").cast("long").alias("sites"))
    said = nodes.sparkSession.createDataFrame([(x, y) for x, ys in deps.items() for y in ys], "s2 string, d2 string")
    both = found.join(said, (F.col("s") == F.col("s2")) & (F.col("d") == F.col("d2")), "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select(F.coalesce("s", "s2").alias("src"), F.coalesce("d", "d2").alias("dst"), zero("edges"), zero("sites"), F.col("s").isNotNull().alias("detected"), F.col("s2").isNotNull().alias("declared"))


def _ends(m: CodeMap, member: DataFrame, boundary: str) -> DataFrame:
    own = m.annotations.where(F.col("boundary") == boundary).join(member.select("file_id", "service"), "file_id")
    return own.groupBy(norm_key("key").alias("key"), "service").agg(F.count(F.lit(1)).alias("n"), F.min("transport").alias("transport"))


def crossings(m: CodeMap, member: DataFrame) -> DataFrame:
    """``key, src, dst, transport, calls, handlers``: annotated calls matched to what serves their key elsewhere.

    Keys are compared without case and outer space. ``dst`` is null for a key that no other service serves.
    Both sides are aggregated before the join, so a hot key costs its services, not its sites.
    """
    c = _ends(m, member, "calls").select("key", F.col("service").alias("src"), F.col("n").alias("calls"), F.col("transport").alias("ct"))
    s = _ends(m, member, "serves").select(F.col("key").alias("k"), F.col("service").alias("dst"), F.col("n").alias("handlers"), F.col("transport").alias("st"))
    j = c.join(s, (F.col("key") == F.col("k")) & (F.col("src") != F.col("dst")), "left")
    return j.select("key", "src", "dst", F.when(F.col("st").isNull(), F.col("ct")).otherwise(pick_transport("ct", "st")).alias("transport"), "calls", F.coalesce("handlers", F.lit(0)).cast("long").alias("handlers"))

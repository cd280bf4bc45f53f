"""Symbol search, notes and near names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..codemap import CodeMap
from ..functions.predicates import checked_kind, has_marker, note_matches
from ..functions.scalars import name_distance

MOST_HITS, NEAREST, MOST_PROBES = 200, 5, 10_000


def find(m: CodeMap, text: str, kind: str = "any", most: int = MOST_HITS) -> DataFrame:
    """``kind, file_id, line, name, total``: symbols that hold ``text``, whatever the case.

    ``any`` are functions, constants, types and notes; calls and imports are searched when asked for.
    ``total`` counts all hits, also beyond the ``most`` that are returned. An unknown kind is an error.
    """
    checked_kind(kind)
    parts = {"func": m.funcs.select("file_id", "line", "name"), "const": m.consts.select("file_id", "line", "name"), "type": m.types.select("file_id", "line", "name"), "note": m.notes.select("file_id", "line", F.col("text").alias("name"))}
    if kind == "call":
        parts["call"] = m.calls.select("file_id", "line", "name")
    if kind == "import":
        parts["import"] = m.imports.select("file_id", "line", F.explode(F.concat("names", F.array("module"))).alias("name"))
    out = None
    for k, df in parts.items():
        if kind in ("any", k):
            one = df.where(F.contains(F.lower("name"), F.lit(text.lower()))).select(F.lit(k).alias("kind"), "file_id", "line", "name")
            out = one if out is None else out.unionByName(one)
    total = out.agg(F.count(F.lit(1)).alias("total"))
    return out.orderBy("kind", "file_id", "line", "name").limit(most).crossJoin(F.broadcast(total))


def notes_by_marker(m: CodeMap, marker: str | None = None) -> DataFrame:
    """Notes that start a marker, all or those that hold ``marker``."""
    return m.notes.where(has_marker("text") & note_matches("text", marker)).select("file_id", "line", "text")


def nearest_names(names: DataFrame, probes: DataFrame, most: int = NEAREST) -> DataFrame:
    """``probe, name, score``: the ``most`` names nearest to each probe. Names are compared once each.

    Probes are a stated set of queries: more than ``MOST_PROBES`` distinct ones are an error.
    """
    own = names.select("name").where("name is not null").distinct()
    asked = probes.select("probe").where("probe is not null").distinct()
    if asked.limit(MOST_PROBES + 1).count() > MOST_PROBES:
        raise ValueError(f"more than {MOST_PROBES} probes")
    j = own.crossJoin(F.broadcast(asked)).withColumn("score", name_distance("probe", "name").cast("long")).where("score is not null")
    w = Window.partitionBy("probe").orderBy("score", "name")
    return j.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")

"""Watching a tree as a stream of looks: which versions of files are new, and how many changes there were."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.tree import changed_paths

LOOKS = "path string, mtime long, size long, seen timestamp"


def new_versions(looks: DataFrame, late: str = "1 hour") -> DataFrame:
    """``path, mtime, size, seen``: each version of a file once, at the first look that saw it.

    A version is a path with a time and a size. State is kept for ``late`` after a version was last seen
    for the first time, so that the same version in a later look of that span is not reported again.
    """
    return looks.withWatermark("seen", late).dropDuplicatesWithinWatermark(["path", "mtime", "size"])


def changes_by_window(looks: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """``start, folder, versions``: distinct versions in windows of time, by top folder. Late looks within ``late`` count."""
    top = F.when(F.contains(F.col("path"), F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise("")
    seen = looks.withWatermark("seen", late).groupBy(F.window("seen", width).alias("w"), top.alias("folder")).agg(F.approx_count_distinct(F.struct("path", "mtime", "size")).alias("versions"))
    return seen.select(F.col("w.start").alias("start"), "folder", "versions")


def rebuild_on_change(looks: DataFrame, last: dict, build) -> DataFrame:  # noqa: ANN001
    """For ``foreachBatch``: calls ``build`` where a batch's last look differs from the one before; returns what changed.

    ``last`` holds the look before under "look"; both are small tables of paths.
    """
    newest = looks.agg(F.max("seen").alias("seen"))
    look = looks.join(F.broadcast(newest), "seen").select("path", "mtime", "size")
    before = last.get("look")
    delta = changed_paths(before if before is not None else look.limit(0), look)
    if not delta.isEmpty():
        build(look)
        last["look"] = look
    return delta

"""Source trees as tables: files of known languages, their text, and what changed between two looks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.storage import cut
from ..functions.scalars import cache_name, disambiguated_cache_name, display_name
from ..schema import LANGUAGES

SKIPPED = ("__pycache__", "build", "dist", "node_modules", "out", "target", "vendor", "venv")
MOST_BYTES = 2_000_000


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """Regular expression over relative paths of one ignore line, and whether it lets paths back in; None for blanks and comments."""
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line.removeprefix("!").removeprefix("\\")
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.removeprefix("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] in "*?":
            out, i = out + ("[^/]*" if line[i] == "*" else "[^/]"), i + 1
        elif line[i] == "[" and "]" in line[i + 1 :]:
            j = line.index("]", i + 1)
            out, i = out + "[" + line[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/' if folder else '(?:/|$)'}", back


def _ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The last line that fits decides; ``rules`` are folder and line of every ignore file, outer folders first."""
    verdict = F.lit(False)
    for folder, line in rules:
        r = ignore_regex(line)
        if r:
            below = f"{folder}/" if folder else ""
            fits = path.startswith(below) & F.substring(path, F.lit(len(below) + 1), F.length(path)).rlike(r[0])
            verdict = F.when(fits, F.lit(not r[1])).otherwise(verdict)
    return verdict


def _ignore_files(spark: SparkSession, base: str, depth: int) -> list[tuple[str, str]]:
    """Folder and text of the ignore files down to a depth, outer folders first. They are configuration: few, small, read by the driver.

    Spark's own listing passes over hidden files, so they are found by one pattern for each level.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top, out = root.toUri().getPath().rstrip("/"), []
    for d in range(depth + 1):
        for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(base + "/*" * d + "/.gitignore")) or []:
            stream = fs.open(x.getPath())
            try:
                text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
            finally:
                stream.close()
            out.append((x.getPath().toUri().getPath().removeprefix(top).strip("/").rpartition("/")[0], text))
    return out


def read_tree(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``path, size, mtime, language, content``: the source files below ``root``, paths relative to it.

    Hidden files and folders, SKIPPED folders, what ignore files exclude, unknown extensions, files of
    more than ``most_bytes`` and files that are not UTF-8 are left out. A path is read once.
    """
    scheme = root if "://" in root or root.startswith("file:") else f"file:{root}"
    base = scheme.rstrip("/")
    every = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(re.sub("^file:/*", "/", base)) + "/", "")
    known_depth = every().load(base).agg(F.max(F.length(rel) - F.length(F.translate(rel, "/", "")))).first()[0] or 0
    rules = [(folder, x) for folder, text in _ignore_files(spark, base, known_depth) for x in text.splitlines()]
    known = F.create_map(*[F.lit(x) for r in LANGUAGES for e in r[1].split() for x in (e, r[0])])
    df = every().load(base).select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda p: p.startswith("."))
    skipped = F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(*SKIPPED))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    df = df.where((F.col("size") <= most_bytes) & ~hidden & ~skipped & ~_ignored(F.col("path"), rules)).withColumn("language", known[ext]).where("language is not null")
    return df.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", "size", "mtime", "language", F.col("content").cast("string").alias("content"))


def with_names(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with ``file_id``, in order of path, and cache and display names; equal cache names get a hash."""
    # dense numbers: place in the sorted partition, after all partitions before it
    own = cut(files.orderBy("path").withColumn("m", F.monotonically_increasing_id()).withColumn("p", F.shiftright("m", 33)))
    before = own.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.join(F.broadcast(before.drop("n")), "p").withColumn("file_id", F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).drop("p", "m", "before")
    own = own.withColumns({"cache_name": cache_name("path"), "display_name": display_name("path")})
    n = F.count(F.lit(1)).over(Window.partitionBy("cache_name"))
    return own.withColumn("same", n).withColumn("cache_name", F.when(F.col("same") > 1, disambiguated_cache_name("path")).otherwise(F.col("cache_name"))).drop("same")


def changed_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change``: added, removed or changed between two looks (``path, mtime, size``); equal files are left out."""
    a, b = before.select("path", F.struct("mtime", "size").alias("x")), after.select("path", F.struct("mtime", "size").alias("y"))
    j = a.join(b, "path", "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return j.select("path", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))


def stale_entries(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """``name, state``: entries (``name, text``) that are missing, modified or no longer expected; time stamps don't count."""
    from ..functions.scalars import strip_stamp

    e, s = expected.select("name", strip_stamp("text").alias("x")), stored.select("name", strip_stamp("text").alias("y"))
    j = e.join(s, "name", "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return j.select("name", F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "stale").otherwise("modified").alias("state"))

"""A code map from source text: one pass over the files, one row of nested tables for each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..codemap import CodeMap
from ..plans.storage import cut
from ..schema import languages
from ..sources.tree import read_tree, with_names
from . import python

#: By language: what takes a text apart. Files of other languages count as files only.
EXTRACTORS = {"python": python.extract}
_SITE = "caller string, line int, name string, qualifier string, recv_type string, test_ctx boolean"
_TABLES = {
    "funcs": "ord int, line int, col int, name string, ret string, comment string, start_line int, end_line int, test_ctx boolean, owner string, param_types array<string>, body_lines int, params int, branches int, nodes int, recursive boolean",
    "loops": "ord int, line int, kind string, depth int, trip int", "resources": "ord int, line int, name string, pair string, acquire boolean, guarded boolean", "calls": _SITE, "uses": _SITE,
    "imports": "line int, module string, names array<string>, reexport boolean", "consts": "line int, name string, ty string", "types": "line int, name string, kind string", "notes": "line int, text string", "annotations": "line int, boundary string, transport string, key string, function string",
}


def _struct(fields: str) -> str:
    return ", ".join(":".join(f.split(" ", 1)) for f in fields.split(", "))


SCHEMA = "file_id long, lines int, parsed boolean, " + ", ".join(f"{k} array<struct<{_struct(v)}>>" for k, v in _TABLES.items())


def extract_tables(files: DataFrame) -> DataFrame:
    """``file_id, lines, parsed`` and an array for each symbol table, of ``files`` (file_id, language, content).

    A text that doesn't parse, or of a language without an extractor, has empty arrays and ``parsed`` false.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, language, text in zip(f["file_id"], f["language"], f["content"]):
                own = EXTRACTORS.get(language, lambda _: None)(text)
                rows.append({"file_id": i, "lines": len(text.splitlines()), "parsed": own is not None} | {k: (own or {}).get(k, []) for k in _TABLES})
            yield pd.DataFrame(rows, columns=["file_id", "lines", "parsed", *_TABLES])

    return files.select("file_id", "language", "content").mapInPandas(run, SCHEMA)


def from_source(spark: SparkSession, files: DataFrame) -> CodeMap:
    """The code map of ``files`` (path, language, content), as ``read_tree`` gives them. Files that don't parse are left out."""
    named = cut(with_names(files))
    found = cut(extract_tables(named).where("parsed"))
    lang = languages(spark).drop("inline_hint")
    tables = {"files": named.select("file_id", "path", "cache_name", "display_name", "language").join(F.broadcast(lang), "language").join(found.select("file_id", "lines"), "file_id")}
    for k in _TABLES:
        tables[k] = found.select("file_id", F.inline(k))
    # numbers of functions: files in order of path, functions in order of place; no file limits them
    node = lambda df: df.withColumn("node_id", F.shiftleft("file_id", 21) + F.col("ord"))
    tables["funcs"] = node(tables["funcs"])
    for k in ("loops", "resources"):
        tables[k] = node(tables[k]).drop("file_id", "ord")
    m = CodeMap(spark, tables, derive_refs=True)
    from ..operators.calls import same_file_refs

    m.tables["refs"] = same_file_refs(m)
    return m


def from_tree(spark: SparkSession, root: str) -> CodeMap:
    return from_source(spark, read_tree(spark, root))

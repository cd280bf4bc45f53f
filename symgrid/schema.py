"""Schemas of the code-map tables, and the language dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOP = "<top>"
FILES = "file_id long, path string, cache_name string, display_name string, language string, family string, is_typed boolean, package_scoped boolean, lines int"
FUNCS = "file_id long, ord int, node_id long, line int, col int, name string, ret string, comment string, start_line int, end_line int, test_ctx boolean, owner string, param_types array<string>, body_lines int, params int, branches int, nodes int, recursive boolean"
LOOPS = "node_id long, line int, kind string, depth int, trip int"
RESOURCES = "node_id long, line int, name string, pair string, acquire boolean, guarded boolean"
CALLS = "file_id long, caller string, line int, name string, qualifier string, recv_type string, test_ctx boolean"
REFS = "file_id long, caller string, call_line int, target_line int, target_col int, target_name string, target_ret string"
IMPORTS = "file_id long, line int, module string, names array<string>, reexport boolean"
CONSTS = "file_id long, line int, name string, ty string"
TYPES = "file_id long, line int, name string, kind string"
MODULES = "file_id long, name string"
NOTES = "file_id long, line int, text string"
ANNOTATIONS = "file_id long, line int, boundary string, transport string, key string, function string"
SCHEMAS = {"files": FILES, "funcs": FUNCS, "loops": LOOPS, "resources": RESOURCES, "calls": CALLS, "uses": CALLS, "refs": REFS, "imports": IMPORTS, "consts": CONSTS, "types": TYPES, "modules": MODULES, "notes": NOTES, "annotations": ANNOTATIONS}

#: language, extensions, family, typed, package scoped, what inlining is asked for with, acquire -> release pairs
LANGUAGES = (
    ("rust", "rs", "rust", True, False, "#[inline]", "leak:from_raw forget:from_raw into_raw:from_raw"),
    ("python", "py pyi", "python", False, False, "inline by hand", "open:close connect:close acquire:release"),
    ("javascript", "js jsx mjs cjs", "js", False, False, "left to the JIT", "addEventListener:removeEventListener setInterval:clearInterval createObjectURL:revokeObjectURL"),
    ("typescript", "ts mts cts", "js", True, False, "left to the JIT", "addEventListener:removeEventListener setInterval:clearInterval createObjectURL:revokeObjectURL"),
    ("tsx", "tsx", "js", True, False, "left to the JIT", "addEventListener:removeEventListener setInterval:clearInterval createObjectURL:revokeObjectURL"),
    ("go", "go", "go", True, True, "left to the compiler", "Open:Close OpenFile:Close Dial:Close Lock:Unlock RLock:RUnlock NewTicker:Stop NewTimer:Stop"),
    ("cpp", "cpp cc cxx c++ hpp hh hxx h++ h", "c", True, True, "inline", "malloc:free calloc:free realloc:free strdup:free new:delete fopen:fclose lock:unlock"),
    ("c", "c", "c", True, True, "static inline", "malloc:free calloc:free realloc:free strdup:free fopen:fclose open:close opendir:closedir pthread_mutex_lock:pthread_mutex_unlock"),
    ("csharp", "cs csx", "csharp", True, True, "AggressiveInlining", "OpenRead:Dispose OpenWrite:Dispose Open:Dispose Connect:Dispose Rent:Return WaitOne:Release"),
    ("zig", "zig", "zig", True, False, "inline fn", "create:destroy alloc:free openFile:close createFile:close init:deinit lock:unlock"),
    ("odin", "odin", "odin", True, False, "#force_inline", "open:close make:delete new:free init:destroy"),
)


def languages(spark: SparkSession) -> DataFrame:
    """``language, family, is_typed, package_scoped, inline_hint``; 11 rows."""
    return spark.createDataFrame([(a, c, d, e, f) for a, _, c, d, e, f, _ in LANGUAGES], "language string, family string, is_typed boolean, package_scoped boolean, inline_hint string")


def extensions(spark: SparkSession) -> DataFrame:
    """``ext, language``."""
    return spark.createDataFrame([(x, r[0]) for r in LANGUAGES for x in r[1].split()], "ext string, language string")


def resource_pairs(spark: SparkSession) -> DataFrame:
    """``language, acquire_name, release_name``."""
    return spark.createDataFrame([(r[0], *p.split(":")) for r in LANGUAGES for p in r[6].split()], "language string, acquire_name string, release_name string")

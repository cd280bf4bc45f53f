"""Filters as boolean Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .scalars import segments

_TEST_DIR = r"(?:^|/)(?:test|tests|__tests__|spec|testdata)/"
BDD = ("bench", "context", "describe", "it", "specify", "suite", "test")
KINDS = ("any", "func", "const", "note", "call", "type", "import")
MARKERS = ("BUG", "FIXME", "HACK", "NOTE", "SAFETY", "TODO", "XXX")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_test_path(path: Column | str) -> Column:
    """A directory for tests on the way, or a file named as one."""
    p = F.lower(_c(path))
    name = F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    return p.rlike(_TEST_DIR) | name.rlike(r"^test_|_test$|\.test$|\.spec$|_spec$")


def is_test_name(name: Column | str) -> Column:
    """A function named as a test, or the label of a callback given to a registrar."""
    n = F.regexp_replace(_c(name), "^_+", "")
    return F.lower(n).rlike("^test_|_test$|_spec$") | n.rlike("^(?:Test|Benchmark|Example|Fuzz)[A-Z]") | n.rlike(rf"^(?:{'|'.join(BDD)})\(")


def glob_regex(glob: str) -> list[str]:
    """Regular expressions of a service pattern: one without wildcard stands for a file or all below a directory."""
    glob = glob.rstrip("/")
    globs = [glob] if re.search(r"[*?\[{]", glob) else [glob, f"{glob}/**"]
    out = []
    for g in globs:
        parts, i = [], 0
        while i < len(g):
            if g.startswith("**/", i):
                parts.append("(?:.*/)?")
                i += 3
            elif g.startswith("**", i):
                parts.append(".*")
                i += 2
            elif g[i] == "*":
                parts.append("[^/]*")
                i += 1
            elif g[i] == "?":
                parts.append("[^/]")
                i += 1
            elif g[i] == "{" and "}" in g[i:]:
                j = g.index("}", i)
                parts.append("(?:" + "|".join(map(re.escape, g[i + 1 : j].split(","))) + ")")
                i = j + 1
            elif g[i] == "[" and "]" in g[i:]:
                j = g.index("]", i)
                parts.append("[" + g[i + 1 : j].replace("!", "^", 1) + "]")
                i = j + 1
            else:
                parts.append(re.escape(g[i]))
                i += 1
        out.append("^" + "".join(parts) + "$")
    return out


def qualifier_matches(q: Column | str, want: Column | str) -> Column:
    """The qualifier ends in the wanted identifiers."""
    s, w = segments(q), segments(want)
    return (F.size(w) > 0) & (F.size(s) >= F.size(w)) & (F.slice(s, F.size(s) - F.size(w) + 1, F.size(w)) == w)


def qualifier_under(q: Column | str, want: Column | str) -> Column:
    """The qualifier starts with the wanted identifiers, whatever their case."""
    s, w = segments(F.lower(_c(q))), segments(F.lower(_c(want)))
    return (F.size(w) > 0) & (F.size(s) >= F.size(w)) & (F.slice(s, F.lit(1), F.size(w)) == w)


def qualifier_names(q: Column | str, service: Column | str) -> Column:
    return F.array_contains(segments(q), _c(service))


def names_project(module: Column | str, project: Column | str) -> Column:
    m, p = _c(module), _c(project)
    s = segments(m)
    return (m == p) | F.startswith(m, F.concat(p, F.lit("/"))) | F.array_contains(s, p) | F.array_contains(s, F.translate(p, "-", "_"))


def in_subtree(path: Column | str, prefix: str) -> Column:
    prefix = prefix.rstrip("/")
    return F.lit(True) if not prefix else (_c(path) == prefix) | _c(path).startswith(f"{prefix}/")


def has_marker(text: Column | str) -> Column:
    """A marker word at the start or after white space, with an owner or not, and a colon."""
    return _c(text).rlike(rf"(?i)(?:^|\s)(?:{'|'.join(MARKERS)})(?:\([^)]*\))?:")


def note_matches(text: Column | str, marker: str | None) -> Column:
    return F.lit(True) if not marker else F.contains(F.upper(_c(text)), F.lit(marker.upper()))


def checked_kind(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; one of {', '.join(KINDS)}")
    return kind

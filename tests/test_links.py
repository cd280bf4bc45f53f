"""Edges between files, put together by class of files: the same as pair by pair, without a row for each pair on disk."""

import random
import re

import pytest

from symgrid.operators import lookup as L

from .test_cases import file, func, make


def by_pairs(paths, defs, imports, calls):
    """Symbols by (src, dst), and names without one target, as the definition has them."""
    stems = {f: p.rsplit("/", 1)[1].split(".")[0] for f, p in paths.items()}
    words = {f: {s} | ({paths[f].rsplit("/", 2)[-2]} if s == "index" else set()) for f, s in stems.items()}
    segs = lambda x: {w for w in re.split("[^A-Za-z0-9_-]+", x or "") if w}
    edges, has = set(), set()
    for f, module, names in imports:
        for d in paths:
            for w in words[d] if d != f else ():
                if w in names:
                    edges.add((f, d, w))
                if w in segs(module):
                    edges |= {(f, d, n) for n in names or [w]}
                    has |= {(f, d, n) for n in names or defs[d]}
    has |= {(f, d, n) for f, d, n in edges if n in words[d] and any(i[0] == f and n in i[2] for i in imports)}
    lost = set()
    for f, name, q in set(calls):
        if name in defs[f] or not any(name in x for x in defs.values()):
            continue
        at = {d for d in paths if stems[d] in segs(q)} | {d for g, d, n in has if g == f and (n == name or n in segs(q))}
        at |= {d for g, d, n in has if n == name and g != d and words[g] & segs(q)}
        at = {d for d in at if name in defs[d]}
        if len(at) == 1:
            edges.add((f, at.pop(), name))
        else:
            lost.add((name, "ambiguous" if at else "excluded"))
    return edges, lost


@pytest.mark.parametrize("seed", range(3))
def test_as_pair_by_pair(spark, seed):
    r = random.Random(seed)
    paths = {f: f"s/d{r.randrange(3)}/{r.choice(['index', f'm{f}'])}.rs" for f in range(12)}
    defs = {f: set(r.sample("abcdef", r.randrange(1, 3))) for f in paths}
    word = lambda: r.choice([f"d{r.randrange(3)}", f"m{r.randrange(12)}", "index", "a", "b"])
    imports = {(r.randrange(12), f"s::{word()}", tuple(sorted({word() if r.random() < 0.2 else r.choice("abcdef") for _ in range(r.randrange(3))}))) for _ in range(9)}
    calls = [(r.randrange(12), r.choice("abcdefg"), r.choice([None, f"x::{word()}", word()])) for _ in range(40)]
    m = make(
        spark, files=[file(f, p) for f, p in paths.items()], funcs=[func(f, i, n, 5 * i + 1, 5 * i + 2) for f, ns in defs.items() for i, n in enumerate(sorted(ns))],
        imports=[{"file_id": f, "line": 1, "module": x, "names": list(ns)} for f, x, ns in imports], calls=[{"file_id": f, "caller": "x", "line": 2, "name": n, "qualifier": q} for f, n, q in calls],
    )
    edges, lost = by_pairs(paths, defs, imports, calls)
    want = {}
    for f, d, n in edges:
        want.setdefault((f, d), set()).add(n)
    got = [tuple(x) for x in L.dependencies(m).select("src", "dst", "n_symbols", "symbols").collect()]
    assert sorted(got) == sorted((f, d, len(n), ",".join(sorted(n))) for (f, d), n in want.items())
    assert {tuple(x) for x in L.unlinked(m).select("name", "reason").collect()} == lost


def test_a_common_word_costs_its_imports_and_its_files(spark, monkeypatch):
    n = 40
    m = make(spark, files=[file(f, f"s/d/x{f}/common/index.rs") for f in range(n)], funcs=[func(f, 0, f"g{f}", 1, 9) for f in range(n)], imports=[{"file_id": f, "line": 1, "module": "common", "names": ["g0"]} for f in range(n)])
    most, write = [0], L.cut

    def counted(df):
        out = write(df)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(L, "cut", counted)
    assert L.dependencies(m).count() == n * (n - 1)
    assert most[0] <= 2 * n

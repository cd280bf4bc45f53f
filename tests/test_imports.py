"""Imports followed between words: the same as file by file, without a row for each pair of files."""

import random

import pytest
from pyspark.sql import functions as F

from symgrid.operators import calls as C

from .test_cases import file, func, make


def by_pairs(imports, paths, defs, hops):
    """Which file a name may come from, file by file, as the definition has it."""
    answers = {}
    for f, p in paths.items():
        stem, folder = p.rsplit("/", 1)[1].split(".")[0], p.rsplit("/", 2)[-2]
        for w in {stem} | ({folder} if stem in C.FACADES else set()):
            answers.setdefault(w, set()).add(f)
    bound = set()
    for f, module, names in imports:
        segs = module.split("::")
        at = answers.get(segs[-1], set()) - {f} or set().union(*[answers.get(s, set()) for s in segs]) - {f}
        at |= set().union(*[answers.get(n, set()) for n in names]) - {f}
        bound |= {(f, n, t) for n in names for t in at}
        bound |= {(f, n, t) for t in at for n in defs.get(t, ()) if not names}
    for _ in range(hops):
        via = {}
        for f, n, t in bound:
            via.setdefault((f, n), set()).add(t)
        bound |= {(f, n, u) for f, n, t in bound for u in via.get((t, n), ()) if u != f}
    return bound


@pytest.mark.parametrize("seed", range(3))
def test_as_file_by_file(spark, seed):
    r = random.Random(seed)
    paths = {f: f"s/d{r.randrange(3)}/{r.choice(['index', f'm{f}'])}.rs" for f in range(14)}
    defs = {f: r.sample("abcdef", r.randrange(3)) for f in paths}
    imports = {(r.randrange(14), f"s::d{r.randrange(3)}::m{r.randrange(14)}", tuple(sorted(r.sample("abcdef", r.randrange(3))))) for _ in range(22)}
    m = make(
        spark, files=[file(f, p) for f, p in paths.items()], funcs=[func(f, i, n, 5 * i + 1, 5 * i + 2) for f, ns in defs.items() for i, n in enumerate(ns)] or [func(0, 0, "a", 1, 2)],
        imports=[{"file_id": f, "line": 1, "module": x, "names": list(ns)} for f, x, ns in imports],
    )
    want = by_pairs(imports, paths, defs, C.HOPS)
    assert {tuple(x) for x in C.imported_names(m).select("file_id", "name", "target").collect()} == want
    keys = m.files.select("file_id").crossJoin(m.funcs.select("name").distinct())
    got = {}
    for x in C.imported_definitions(m, keys, m.funcs.select(F.col("file_id").alias("target"), "name")).collect():
        got.setdefault((x["file_id"], x["name"]), []).append(x["target"])
    for f in paths:
        for n in "abcdef":
            own = {t for g, k, t in want if (g, k) == (f, n) and n in defs[t]}
            mine = got.get((f, n), [])
            assert set(mine) == own if len(own) < 2 else len(mine) > 1 or mine == [None], (f, n)


def test_a_common_word_costs_its_imports_and_its_files(spark, monkeypatch):
    n = 40
    m = make(
        spark, files=[file(f, f"s/d/x{f}/common/index.rs") for f in range(n)], funcs=[func(f, 0, f"g{f}", 1, 9) for f in range(n)],
        calls=[{"file_id": f, "caller": f"g{f}", "line": 2, "name": f"g{(f + 1) % n}"} for f in range(n)],
        imports=[{"file_id": f, "line": 1, "module": "common", "names": [f"g{(f + 1) % n}"] * (f % 2)} for f in range(n)],
    )
    most, write = [0], C.cut

    def counted(df):
        out = write(df)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(C, "cut", counted)
    assert {(r["src"], r["dst"]) for r in C.call_edges(m).collect()} == {(100 * f, 100 * ((f + 1) % n)) for f in range(n)}
    # the names themselves are by pairs of files, and are not written by pairs
    assert C.imported_names(m).count() == n * (n - 1)
    assert most[0] <= 4 * n

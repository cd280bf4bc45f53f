"""Suffix and LCP array by external induced sorting.

The sorted order of all suffixes is induced from that of the S* suffixes (those that begin where the
text turns from falling to rising), which is found by naming the S* substrings and recursing on the
string of names. Both inducing passes read suffixes from a priority queue in the order of their first
symbols and push the suffixes one symbol longer; a queue's tuples carry the suffix's symbol and place,
and the common prefix it has with its predecessor of the same symbol. The queue is monotone: symbols
only ever move forward. It is therefore kept as a row of symbol ranges, of which only the current one
is in memory and the others are appended to on disk once they outgrow their share.

All symbols of a range are handled in one step unless the step would push into the range itself; then
it ends before the first symbol that is pushed to.
"""

from __future__ import annotations

import os
import shutil
import uuid

import numpy as np

#: Common prefixes are measured up to this many symbols; they are kept in two bytes.
CAP = 200
LCP, LCP_BITS = np.uint16, 16


class Scratch:
    """Arrays in memory up to a size, in files of one folder beyond."""

    def __init__(self, folder: str, entries: int):
        self.folder, self.entries, self.spilled = os.path.join(folder, f"esais-{uuid.uuid4().hex}"), entries, 0

    def path(self) -> str:
        os.makedirs(self.folder, exist_ok=True)
        return os.path.join(self.folder, uuid.uuid4().hex)

    def array(self, n: int, dtype: type) -> np.ndarray:
        if n <= self.entries * 4:
            return np.zeros(n, dtype)
        self.spilled += 1
        return np.memmap(self.path(), dtype, "w+", shape=(max(n, 1),))[:n]

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class RangeQueue:
    """Monotone priority queue of suffix tuples over ranges of symbols, first in first out in a symbol.

    A tuple is a row of two numbers: symbol with common prefix, and place. Ranges are kept in groups;
    a group is split into its ranges when the pass comes to it. Tuples wait in memory until there are
    ``scratch.entries`` of them; then those of the fullest groups are appended to their files.
    """

    def __init__(self, bounds: np.ndarray, scratch: Scratch):
        self.scratch, self.held, self.bounds = scratch, 0, bounds
        self.width = max(1, int(np.sqrt(len(bounds))))
        self.groups = bounds[:: self.width] if (len(bounds) - 1) % self.width == 0 else np.append(bounds[:: self.width], bounds[-1])
        self.parts: list[list[np.ndarray]] = [[] for _ in range(len(self.groups) - 1)]
        self.sizes = [0] * len(self.parts)
        self.files: dict[int, str] = {}
        self.now, self.split = -1, []

    @staticmethod
    def _cuts(at: np.ndarray) -> tuple[list[int], list[int]]:
        cuts = (np.flatnonzero(at[1:] != at[:-1]) + 1).tolist()
        return [0, *cuts], [*cuts, len(at)]

    def push(self, symbol: np.ndarray, place: np.ndarray, lcp: np.ndarray) -> None:
        if not len(symbol):
            return
        e = np.empty((len(symbol), 2), np.int64)
        e[:, 0], e[:, 1] = symbol << LCP_BITS | lcp, place
        at = np.searchsorted(self.groups, symbol, "right") - 1
        order = np.argsort(at, kind="stable")
        e, at = e[order], at[order]
        for s, t in zip(*self._cuts(at)):
            g = int(at[s])
            if g == self.now:
                self._divide(e[s:t])
            else:
                self.parts[g].append(e[s:t])
                self.sizes[g] += t - s
        self.held += len(e)
        if self.held > self.scratch.entries:
            for g in sorted(range(len(self.parts)), key=self.sizes.__getitem__, reverse=True):
                if self.held <= self.scratch.entries // 2 or not self.sizes[g]:
                    break
                self._spill(g)

    def _spill(self, g: int) -> None:
        with open(self.files.setdefault(g, self.scratch.path()), "ab") as f:
            for p in self.parts[g]:
                p.tofile(f)
        self.scratch.spilled += 1
        self.held -= self.sizes[g]
        self.parts[g], self.sizes[g] = [], 0

    def _divide(self, e: np.ndarray) -> None:
        """Tuples of the current group to its ranges, in the order they came."""
        at = np.searchsorted(self.bounds, e[:, 0] >> LCP_BITS, "right") - 1 - self.now * self.width
        order = np.argsort(at, kind="stable")
        e, at = e[order], at[order]
        for s, t in zip(*self._cuts(at)):
            self.split[at[s]].append(e[s:t])

    def pop(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, places and common prefixes of range ``r`` in the order they were pushed."""
        g = r // self.width
        if g != self.now:
            self.now, self.split = g, [[] for _ in range(self.width)]
            if g in self.files:
                at = self.files.pop(g)
                e = np.fromfile(at, np.int64).reshape(-1, 2)
                os.remove(at)
                self.held += len(e)
                self._divide(e)
            if self.parts[g]:
                self._divide(np.concatenate(self.parts[g]))
                self.parts[g], self.sizes[g] = [], 0
        own = self.split[r - g * self.width]
        self.split[r - g * self.width] = []
        e = np.concatenate(own) if own else np.empty((0, 2), np.int64)
        self.held -= len(e)
        return e[:, 0] >> LCP_BITS, e[:, 1], (e[:, 0] & ((1 << LCP_BITS) - 1)).astype(LCP)


class RangeMinimum:
    """Minimum over stretches of an array that only grows."""

    def __init__(self, n: int, scratch: Scratch):
        self.levels = [scratch.array(n, LCP)]
        while 1 << len(self.levels) <= n:
            self.levels.append(scratch.array(n, LCP))
        self.n = 0

    def extend(self, values: np.ndarray) -> None:
        s, e = self.n, self.n + len(values)
        self.levels[0][s:e] = values
        for k in range(1, len(self.levels)):
            h = 1 << (k - 1)
            if e < 2 * h:
                break
            a = max(s, 2 * h - 1)
            np.minimum(self.levels[k - 1][a:e], self.levels[k - 1][a - h : e - h], out=self.levels[k][a:e])
        self.n = e

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of places first..last, both included."""
        k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), LCP)
        for level in np.unique(k):
            m = k == level
            own = self.levels[level]
            out[m] = np.minimum(own[last[m]], own[first[m] + (1 << int(level)) - 1])
        return out


def common_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """By comparison, for pairs of places of one text."""
    out = np.zeros(len(a), np.int64)
    on = np.arange(len(a))
    for k in range(cap):
        on = on[(a[on] + k < len(t)) & (b[on] + k < len(t))]
        on = on[t[a[on] + k] == t[b[on] + k]]
        if not len(on):
            break
        out[on] = k + 1
    return out.astype(LCP)


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S (smaller than the one after it); the last is."""
    n = len(t)
    rises = np.empty(n, bool)
    rises[-1] = True
    rises[:-1] = t[:-1] < t[1:]
    same = np.flatnonzero(np.append(t[:-1] == t[1:], False))
    if len(same):
        differs = np.flatnonzero(np.append(t[:-1] != t[1:], True))
        rises[same] = rises[differs[np.searchsorted(differs, same)]]
    return rises


def _bounds(counts: np.ndarray, most: int) -> np.ndarray:
    """Ranges of symbols of about ``most`` suffixes; a symbol with more is one alone."""
    total = np.cumsum(counts)
    cuts, base, at = [0], 0, 0
    while at < len(counts):
        end = int(np.searchsorted(total, base + most, "right"))
        at = max(end, at + 1)
        cuts.append(at)
        base = int(total[at - 1])
    return np.array(cuts)


def _chain(t: np.ndarray, place: np.ndarray, lcp: np.ndarray, runs: np.ndarray, want: bool, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """What suffixes that start with one symbol induce in that symbol, with themselves, in order.

    Those one symbol longer follow all the shorter ones, in the order of what induced them.
    """
    rep = place - runs[place] + 1
    which = np.repeat(np.arange(len(place)), rep)
    k = np.arange(len(which)) - np.repeat(np.cumsum(rep) - rep, rep)
    order = np.lexsort((which, k))
    which, k = which[order], k[order]
    out = place[which] - k
    got = np.zeros(len(out), LCP)
    if want:
        got[0] = lcp[0]
        if len(out) > 1:
            table = RangeMinimum(len(lcp), Scratch("", 1 << 62))
            table.extend(lcp)
            first = np.append(False, k[1:] != k[:-1])
            same = np.flatnonzero(~first[1:]) + 1
            got[same] = np.minimum(table.least(which[same - 1] + 1, which[same]).astype(np.int64) + k[same], cap)
            at = np.flatnonzero(first)
            got[at] = common_prefix(t, out[at - 1], out[at], cap)
    return out, got


def _induce(t: np.ndarray, stype: np.ndarray, runs: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None, down: bool, scratch: Scratch, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """One inducing pass: the induced suffixes in the order of the pass, and common prefixes.

    Up (``down`` false): seeds are S* suffixes in ascending order, L suffixes come out ascending.
    Down: seeds are L suffixes in descending order, S suffixes come out descending. In a symbol the
    pass meets the induced suffixes first, then the seeds. Without ``seed_lcp`` no common prefixes
    are found.
    """
    n = len(t)
    size = int(t.max()) + 1 if n else 0
    flip = (lambda c: size - 1 - c) if down else (lambda c: c)  # symbols in the order of the pass
    induced = stype if down else ~stype
    total = int(induced.sum())
    counts = np.bincount(flip(t[induced].astype(np.int64)), minlength=size) + (np.bincount(flip(t[seeds].astype(np.int64)), minlength=size) if len(seeds) else 0)
    step = max(64, min(scratch.entries, int(np.sqrt(n + 1))))
    bounds = _bounds(counts, step)
    queue = RangeQueue(bounds, scratch)
    want = seed_lcp is not None
    out, out_lcp, done = scratch.array(total, np.int64), scratch.array(total if want else 0, LCP), 0
    rmq = RangeMinimum(total + len(seeds), scratch) if want else None
    last_rank = np.full(size, -1, np.int64) if want else None
    if down:  # the last suffix is S but has no successor that would induce it
        queue.push(np.array([flip(int(t[n - 1]))]), np.array([n - 1]), np.zeros(1, LCP))
    seed_symbol = flip(t[seeds].astype(np.int64))
    seed_at = np.searchsorted(seed_symbol, bounds)
    rank, before = 0, -1  # how many were met; symbol of the last
    before_place = -1

    def handle(sym: np.ndarray, place: np.ndarray, lcp: np.ndarray, is_seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emit what was met, in order; what it induces: symbols, places, common prefixes."""
        nonlocal rank, before, before_place, done
        k = int((~is_seed).sum())
        out[done : done + k] = place[~is_seed]
        if want:
            new = np.empty(len(sym), bool)
            new[0] = sym[0] != before
            new[1:] = sym[1:] != sym[:-1]
            lcp = np.where(new, 0, lcp)
            seam = is_seed.copy()
            seam[1:] &= ~is_seed[:-1]
            if before_is_seed[0]:
                seam[0] = False
            seam &= ~new
            if seam.any():  # induced and seed of one symbol side by side
                at = np.flatnonzero(seam)
                left = np.where(at > 0, place[at - 1], before_place)
                lcp[at] = common_prefix(t, left, place[at], cap)
            out_lcp[done : done + k] = lcp[~is_seed]
            rmq.extend(lcp)
        done += k
        prev = place - 1
        ok = prev >= 0
        ok[ok] = induced[prev[ok]]
        src = np.flatnonzero(ok)
        target, place2 = flip(t[prev[src]].astype(np.int64)), prev[src]
        got = np.zeros(len(src), LCP)
        if want and len(src):
            order = np.argsort(target, kind="stable")
            ts, rs = target[order], rank + src[order]
            prior = np.empty(len(ts), np.int64)
            first = np.ones(len(ts), bool)
            first[1:] = ts[1:] != ts[:-1]
            prior[1:] = rs[:-1]
            prior[first] = last_rank[ts[first]]
            has = prior >= 0
            g = np.zeros(len(ts), LCP)
            g[has] = np.minimum(rmq.least(prior[has] + 1, rs[has]).astype(np.int64) + 1, cap)
            got[order] = g
            ends = np.append(first[1:], True)
            last_rank[ts[ends]] = rs[ends]
        rank += len(sym)
        before, before_place, before_is_seed[0] = int(sym[-1]), int(place[-1]), bool(is_seed[-1])
        return target, place2, got

    before_is_seed = [False]
    for r in range(len(bounds) - 1):
        high = int(bounds[r + 1])
        got = queue.pop(r)
        s0, s1 = int(seed_at[r]), int(seed_at[r + 1])
        if not len(got[0]) and s0 == s1:
            continue
        sym = np.concatenate([got[0], seed_symbol[s0:s1]])
        place = np.concatenate([got[1], seeds[s0:s1]])
        lcp = np.concatenate([got[2], seed_lcp[s0:s1] if want else np.zeros(s1 - s0, LCP)])
        seed = np.concatenate([np.zeros(len(got[0]), bool), np.ones(s1 - s0, bool)])
        order = np.argsort(sym * 2 + seed, kind="stable")
        sym, place, lcp, seed = sym[order], place[order], lcp[order], seed[order]
        while len(sym):
            prev = place - 1
            ok = prev >= 0
            ok[ok] = induced[prev[ok]]
            target = np.full(len(sym), size, np.int64)
            target[ok] = flip(t[prev[ok]].astype(np.int64))
            inside = target[target < high]
            stop = int(inside.min()) if len(inside) else size
            k = int(np.searchsorted(sym, stop))
            if k:
                tt, pp, ll = handle(sym[:k], place[:k], lcp[:k], seed[:k])
            else:  # the first symbol induces itself
                k = int(np.searchsorted(sym, sym[0], "right"))
                own = ~seed[:k]
                parts = []
                if own.any():
                    x_place, x_lcp = _chain(t, place[:k][own], lcp[:k][own], runs, want, cap)
                    a, b, c = handle(np.full(len(x_place), sym[0]), x_place, x_lcp, np.zeros(len(x_place), bool))
                    on = a != sym[0]
                    parts.append((a[on], b[on], c[on]))
                if not own.all():
                    parts.append(handle(sym[:k][~own], place[:k][~own], lcp[:k][~own], seed[:k][~own]))
                tt, pp, ll = (np.concatenate(x) for x in zip(*parts))
            near = tt < high
            queue.push(tt[~near], pp[~near], ll[~near])
            sym, place, lcp, seed = sym[k:], place[k:], lcp[k:], seed[k:]
            if near.any():
                sym, place, lcp, seed = np.concatenate([sym, tt[near]]), np.concatenate([place, pp[near]]), np.concatenate([lcp, ll[near]]), np.concatenate([seed, np.zeros(int(near.sum()), bool)])
                order = np.argsort(sym * 2 + seed, kind="stable")
                sym, place, lcp, seed = sym[order], place[order], lcp[order], seed[order]
    return out[:done], out_lcp[: done if want else 0]


def _name(t: np.ndarray, order: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the S* substrings, which ``order`` lists ascending; equal substrings share one."""
    n, m = len(t), len(order)
    length = np.empty(len(stars), np.int64)
    length[:-1] = np.diff(stars)
    length[-1] = n - 1 - stars[-1]
    which = np.searchsorted(stars, order)
    size = length[which]
    same = np.zeros(m, bool)
    on = np.flatnonzero(size[1:] == size[:-1])
    k = 0
    live = on
    while len(live):
        a, b = order[live], order[live + 1]
        live = live[(a + k < n) & (b + k < n)]
        a, b = order[live], order[live + 1]
        live = live[t[a + k] == t[b + k]]
        whole = size[live] == k
        same[live[whole] + 1] = True
        live = live[~whole]
        k += 1
    name = np.cumsum(~same) - 1
    out = np.empty(len(stars), np.int64)
    out[which] = name
    return out, int(name[-1]) + 1


def suffix_array(t: np.ndarray, scratch: Scratch, cap: int = CAP) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``t`` (symbols 0..k-1) in order, and the common prefix (up to ``cap``) of each with the one before.

    ``t`` ends with a symbol 0 that occurs nowhere else.
    """
    if cap >= 1 << LCP_BITS:
        raise ValueError(f"common prefixes are measured up to {(1 << LCP_BITS) - 1} symbols, not {cap}")
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy(), np.zeros(n, LCP)
    stype = _types(t)
    stars = np.flatnonzero(stype[1:] & ~stype[:-1]) + 1
    runs = np.arange(n)  # where the run of equal symbols begins
    runs[1:][t[1:] == t[:-1]] = 0
    runs = np.maximum.accumulate(runs)
    # a first round of both passes sorts the S* substrings
    start = stars[np.argsort(t[stars], kind="stable")]
    up, _ = _induce(t, stype, runs, start, None, False, scratch, cap)
    down, _ = _induce(t, stype, runs, np.ascontiguousarray(up[::-1]), None, True, scratch, cap)
    is_star = np.zeros(n, bool)
    is_star[stars] = True
    ordered = np.ascontiguousarray(down[::-1])
    ordered = ordered[is_star[ordered]]
    names, kinds = _name(t, ordered, stars)
    if kinds < len(stars):
        reduced, reduced_lcp = suffix_array(names, scratch, cap)
        order = stars[reduced]
        a, b = reduced[:-1], reduced[1:]
        have = stars[np.minimum(a + reduced_lcp[1:], len(stars) - 1)] - stars[a]
    else:
        order = ordered
        have = np.zeros(len(order) - 1, np.int64)
    lcp = np.zeros(len(order), LCP)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        have = np.minimum(have, cap)
        on = np.arange(len(have))
        while len(on):  # the rest of the first substrings that differ
            on = on[(have[on] < cap) & (a[on] + have[on] < n) & (b[on] + have[on] < n)]
            on = on[t[a[on] + have[on]] == t[b[on] + have[on]]]
            have[on] += 1
        lcp[1:] = have
    up, up_lcp = _induce(t, stype, runs, order, lcp, False, scratch, cap)
    # in descending order, each has the common prefix with the one met before it, its successor
    seed_lcp = np.zeros(len(up), LCP)
    seed_lcp[1:] = up_lcp[1:][::-1]
    down, down_lcp = _induce(t, stype, runs, np.ascontiguousarray(up[::-1]), seed_lcp, True, scratch, cap)
    return _merge(t, up, up_lcp, down, down_lcp, cap)


def _merge(t: np.ndarray, up: np.ndarray, up_lcp: np.ndarray, down: np.ndarray, down_lcp: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    s = down[::-1]
    s_lcp = np.zeros(len(s), LCP)
    s_lcp[1:] = down_lcp[1:][::-1]
    size = int(t.max()) + 1
    nl, ns = np.bincount(t[up], minlength=size), np.bincount(t[s], minlength=size)
    begin = np.cumsum(nl + ns) - nl - ns
    sa, lcp = np.empty(len(t), np.int64), np.empty(len(t), LCP)
    for own, own_lcp, n, base in ((up, up_lcp, nl, begin), (s, s_lcp, ns, begin + nl)):
        at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(base, n)
        sa[at], lcp[at] = own, own_lcp
    lcp[begin[nl + ns > 0]] = 0
    seams = (begin + nl)[(nl > 0) & (ns > 0)]
    lcp[seams] = common_prefix(t, sa[seams - 1], sa[seams], cap)
    return sa, lcp

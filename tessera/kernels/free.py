"""Free rectangles of many sheets at once, in numpy: what geometry.emptiest() and joined() find, sheet by sheet. No Spark here.

Rectangles are the columns of (4, n) arrays, sorted by the number of their sheet.
"""

from __future__ import annotations

import numpy as np

from tessera.kernels import geometry as G


def _pairs(key: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each place of key with all places of an equal one in keys, which are sorted and below n."""
    count = np.bincount(keys, minlength=n)
    begin, each = np.cumsum(count) - count, count[key]
    p = np.repeat(np.arange(len(key)), each)
    return p, np.arange(len(p)) + np.repeat(begin[key] - np.cumsum(each) + each, each)


def _without(sheet: np.ndarray, free: np.ndarray, taken: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The maximal free rectangles once one of each sheet (a column each) is taken."""
    a, b, c, d = free
    x0, y0, x1, y1 = taken[:, sheet]
    met = (x0 < c) & (x1 > a) & (y0 < d) & (y1 > b)
    i = np.flatnonzero(met)
    if not len(i):
        return sheet, free
    kept = np.flatnonzero(~met)
    # what a piece beside the taken one lies within has the same side, on the taken one's
    near = [kept[v[kept] == t[kept]] for v, t in ((c, x0), (a, x1), (d, y0), (b, y1))]
    old, old_sheet = free[:, kept], sheet[kept]
    beside = [sheet[k] * 4 + side for side, k in enumerate(near)]
    near = free[:, np.concatenate(near)]
    a, b, c, d, x0, y0, x1, y1, s = a[i], b[i], c[i], d[i], x0[i], y0[i], x1[i], y1[i], sheet[i]
    wide, tall, keys, parts = c - a, d - b, [], []
    for side, (ok, part) in enumerate((((x0 > a) & ((x0 - a) * tall >= least), (a, b, x0, d)), ((x1 < c) & ((c - x1) * tall >= least), (x1, b, c, d)), ((y0 > b) & (wide * (y0 - b) >= least), (a, b, c, y0)), ((y1 < d) & (wide * (d - y1) >= least), (a, y1, c, d)))):
        k = np.flatnonzero(ok)
        keys.append(s[k] * 4 + side)
        parts.append(np.stack([v[k] for v in part]))
    key, new = np.concatenate(keys), np.concatenate(parts, axis=1)
    keys, whole = np.concatenate([key, *beside]), np.concatenate([new, near], axis=1)
    order = np.argsort(keys, kind="stable")
    p, o = _pairs(key, keys[order], 4 * taken.shape[1])
    o = order[o]
    a, b, c, d = (v.take(p) for v in new)
    u, v, w, z = (v.take(o) for v in whole)
    i = np.flatnonzero((u <= a) & (v <= b) & (w >= c) & (z >= d) & (p != o))
    # of equal ones the first stays
    i = i[(o[i] < p[i]) | (o[i] >= len(key)) | (u[i] < a[i]) | (v[i] < b[i]) | (w[i] > c[i]) | (z[i] > d[i])]
    keep = np.ones(len(key), bool)
    keep[p[i]] = False
    sheet = np.concatenate([old_sheet, key[keep] // 4])
    order = np.argsort(sheet, kind="stable")
    return sheet[order], np.concatenate([old, new[:, keep]], axis=1)[:, order]


def emptiest(box: tuple, n: int, sheet: np.ndarray, taken: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """geometry.emptiest() of sheets 0 to n - 1; sheet, sorted: of each rectangle taken -> sheets and rectangles, in the order they are taken."""
    least = max(least, 1e-9)
    found, free = [np.zeros(0, np.int64)], [np.zeros((4, 0))]
    own, now = np.arange(n), np.repeat(np.array(box, float)[:, None], n, axis=1)
    count = np.bincount(sheet, minlength=n)
    rank = np.arange(len(sheet)) - (np.cumsum(count) - count)[sheet]
    nothing = np.repeat(np.array([np.inf, np.inf, -np.inf, -np.inf])[:, None], n, axis=1)
    by_rank = np.argsort(rank, kind="stable")
    ends = np.cumsum(np.bincount(rank)) if len(rank) else []
    for begin, end in zip([0, *ends[:-1]], ends, strict=False):
        k, t = by_rank[begin:end], nothing.copy()
        t[:, sheet[k]] = taken[:, k]
        own, now = _without(own, now, t, least)
    while len(own):
        size = (now[2] - now[0]) * (now[3] - now[1])
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        most = np.maximum.reduceat(size, first)
        best = np.flatnonzero(size == np.repeat(most, np.diff(np.append(first, len(own)))))
        best = best[np.lexsort((now[1, best], now[2, best], now[0, best], own[best]))]
        best = best[np.concatenate(([True], own[best[1:]] != own[best[:-1]]))]
        best = best[size[best] >= least]
        found.append(own[best])
        free.append(now[:, best])
        t = np.repeat(np.array([-np.inf, -np.inf, np.inf, np.inf])[:, None], n, axis=1)  # a sheet without a best one is done
        t[:, found[-1]] = free[-1]
        own, now = _without(own, now, t, least)
    sheets = np.concatenate(found)
    order = np.argsort(sheets, kind="stable")
    return sheets[order], np.concatenate(free, axis=1)[:, order]


def joined(n: int, sheet: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the unions of disjoint rectangles of sheets 0 to n - 1, what geometry.joined() finds: number of parts, their area, the fewest corners of an outer ring (0: none).

    A part is found by its rectangles that share a side. Its corners are corners of rectangles
    with one or three of the quarters around them covered, or two opposite ones. Those that turn
    left are four more than those that turn right, but where it has holes: such sheets are traced.
    """
    m = len(sheet)
    p, o = _pairs(sheet, sheet, n)
    a, b, c, d = free[:, p]
    u, v, w, z = free[:, o]
    touch = (np.minimum(c, w) >= np.maximum(a, u)) & (np.minimum(d, z) >= np.maximum(b, v)) & ((np.minimum(c, w) > np.maximum(a, u)) | (np.minimum(d, z) > np.maximum(b, v)))
    part, left, right = np.arange(m), p[touch], o[touch]
    while True:
        low = part.copy()
        np.minimum.at(low, left, part[right])
        low = low[low]
        if (low == part).all():
            break
        part = low
    corners, turns = np.zeros(m), np.zeros(m)
    for i, j in ((0, 1), (2, 1), (2, 3), (0, 3)):
        x, y = free[i][p], free[j][p]
        x_in, y_in = ((u < x) & (x <= w), (u <= x) & (x < w)), ((v < y) & (y <= z), (v <= y) & (y < z))
        west_south, west_north, east_south, east_north = (np.bincount(p, h & k, m) > 0 for h in x_in for k in y_in)
        here = np.bincount(p, ((x == u) | (x == w)) & ((y == v) | (y == z)), m)
        quarters = west_south.astype(int) + west_north + east_south + east_north
        opposite = (quarters == 2) & (west_south == east_north)
        convex, concave = (quarters == 1) | opposite, quarters == 3
        corners += convex + concave / here
        turns += convex - concave / here
    corners, turns = np.bincount(part, corners, m).round().astype(int), np.bincount(part, turns, m).round().astype(int)
    roots = np.flatnonzero(part == np.arange(m))
    number, area = np.bincount(sheet[roots], minlength=n), np.bincount(sheet, (free[2] - free[0]) * (free[3] - free[1]), n)
    whole = turns[roots] == 4
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, sheet[roots[whole]], corners[roots[whole]])
    ends = np.cumsum(np.bincount(sheet, minlength=n))
    for k in np.setdiff1d(sheet[roots[~whole]], np.flatnonzero(least == 4)).tolist():
        least[k] = min(len(g["outer"]) for g in G.joined(free[:, ends[k - 1] if k else 0 : ends[k]].T.tolist()))
    return number, area, np.where(number > 0, least, 0)

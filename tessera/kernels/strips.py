"""Strips of many requests at once, in numpy: what search.fill_strip() finds, request by request. No Spark here."""

from __future__ import annotations

import numpy as np

from tessera.kernels import search as K

#: Requests of more parts are filled one by one: the work of all at once grows with the cube of the parts, as many steps of arrays as the square.
MANY = 16


def _corners(w: np.ndarray, h: np.ndarray, placed: np.ndarray, width: np.ndarray, height: float, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """search.corner() for a part of every strip; placed: (4, parts, strips), by y0. Strips that have no place grow in width."""
    half, slack = gap / 2, gap - 1e-9
    x = np.concatenate([np.full((1, len(w)), half), placed[2] + gap])
    left, right = x - slack, x + w + slack
    y, open_ = np.full(x.shape, half), np.ones(x.shape, bool)
    for x0, y0, x1, y1 in placed.transpose(1, 0, 2):
        met = (x0 < right) & (x1 > left) & (y1 > y - slack) & open_
        above = met & (y0 >= y + h + slack)
        open_ &= ~above
        y = np.where(met & ~above, y1 + gap, y)
    x = np.where(y <= height - half - h + 1e-9, x, np.inf)
    first = x.min(0)
    if not np.isfinite(first).all():
        raise ValueError("coordinates too large for the gap")
    while True:
        most = width - half - w
        narrow = (most < half - 1e-12) | (first > most + 1e-9)
        if not narrow.any():
            break
        width[narrow] *= 1.1
    cost = np.where(x <= most + 1e-9, 10 * x + y, np.inf)
    best = cost == cost.min(0)
    at = np.where(best, x, np.inf).min(0)
    return at, np.where(best & (x == at), y, np.inf).min(0)


def _order(request: np.ndarray, item: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Items by request, largest first, then by id and sides: one number does for most, which rounding may make equal but never turns."""
    size = w**2 + h**2
    key = request + (1 - size / max(2 * size.max(initial=0.0), 1e-300))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    t = order[tied]
    order[tied] = t[np.lexsort((h[t], w[t], item[t], -size[t], request[t]))]
    return order


def fill_strips(n: int, request: np.ndarray, item: np.ndarray, w: np.ndarray, h: np.ndarray, demand: np.ndarray, height: float, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """search.fill_strip() of requests 0 to n - 1, with exact places; request, sorted: of each item -> widths, and of each placement its request, its item and its box (x0, y0, x1, y1) as a column."""
    order = _order(request, item, w, h)
    request, item, w, h, demand = (v[order] for v in (request, item, w, h, demand))
    width = np.bincount(request, w * h * demand, n) / height
    np.maximum.at(width, request, w + gap)
    number = np.where(h + gap > height, 0, np.maximum(demand, 0))
    count = np.bincount(request, number, n).astype(np.int64)
    many, at_once = np.flatnonzero(count > MANY), np.flatnonzero((count > 0) & (count <= MANY))
    at_once = at_once[np.argsort(-count[at_once], kind="stable")]
    count = count[at_once]
    slot = np.full(n, -1)
    slot[at_once] = np.arange(len(at_once))
    # the parts, one by one: a column for each request, those of most parts first
    row = np.repeat(np.arange(len(request)), np.where(slot[request] >= 0, number, 0))
    row = row[np.argsort(slot[request[row]], kind="stable")]
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    part = np.zeros((count.max(initial=0), len(at_once)), np.int64)
    part[k, slot[request[row]]] = row
    placed, grown = np.zeros((4, *part.shape)), width[at_once]
    owns, rows, boxes = [], [], []
    for k, of in enumerate(part):
        m = int(np.searchsorted(-count, -k))  # strips of more than k parts
        of = of[:m]
        x, y = _corners(w[of], h[of], placed[:, :k, :m], grown[:m], height, gap)
        new = np.stack([x, y, x + w[of], y + h[of]])
        owns.append(at_once[:m])
        rows.append(of)
        boxes.append(new)
        for j in range(k):
            old = placed[:, j, :m]
            before = old[1] > new[1]
            placed[:, j, :m], new = np.where(before, new, old), np.where(before, old, new)
        placed[:, k, :m] = new
    for r in many.tolist():
        a, b = np.searchsorted(request, (r, r + 1))
        got = K.fill_strip([(i, *v) for i, v in enumerate(zip(w[a:b].tolist(), h[a:b].tolist(), demand[a:b].tolist(), strict=True), int(a))], height, gap, 0, exact=True)[1]
        owns.append(np.full(len(got), r))
        rows.append(np.array([g[0] for g in got], np.int64))
        boxes.append(np.array([g[1:] for g in got]).T)
    own, rows, box = np.concatenate([np.zeros(0, np.int64), *owns]), np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros((4, 0)), *boxes], axis=1)
    widest = np.zeros(n)
    np.maximum.at(widest, own, box[2])
    return widest * 1.00001 + gap / 2, own, item[rows], box

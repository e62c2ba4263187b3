"""Packing kernels in numpy: shelves, lattices, and left-bottom-fill search. No Spark here."""

from __future__ import annotations

import math
from bisect import insort
from operator import itemgetter

import numpy as np

from tessera.kernels import geometry as G


def shelves(sizes: list[tuple[float, float]], sheet: tuple[float, float], gap: float) -> list[tuple[int, int, float, float]]:
    """Next-fit shelves, tallest first -> (index, page, x, y) of lower left corners; parts too large for a sheet are left out."""
    out, page, x, y, tall = [], 0, 0.0, 0.0, 0.0
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i][1], i)):
        w, h = sizes[k]
        if w > sheet[0] or h > sheet[1]:
            continue
        if x + w > sheet[0]:
            x, y, tall = 0.0, y + tall + gap, 0.0
        if y + h > sheet[1]:
            page, x, y, tall = page + 1, 0.0, 0.0, 0.0
        out.append((k, page, x, y))
        x, tall = x + w + gap, max(tall, h)
    return out


def _axes(ring: np.ndarray) -> np.ndarray:
    d = np.roll(ring, -1, axis=0) - ring
    return np.column_stack([-d[:, 1], d[:, 0]])


def overlap_convex(a: np.ndarray, b: np.ndarray, eps: float = 1e-9) -> bool:
    """Interiors of convex rings meet: no separating axis. Touching is apart."""
    for axis in np.vstack([_axes(a), _axes(b)]):
        p, q = a @ axis, b @ axis
        if p.max() <= q.min() + eps or q.max() <= p.min() + eps:
            return False
    return True


def arcs(*bodies: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The directions, by angle, in which a corner of one of convex bodies gives way to the next as the outermost, and for each the corners of all bodies that are so from there to the next."""
    e = np.vstack([G.following(b) - b for b in bodies])
    angle = np.sort(np.arctan2(-e[:, 0], e[:, 1]))
    middle = (angle + np.append(angle[1:], angle[0] + 2 * math.pi)) / 2
    out = np.array([np.cos(middle), np.sin(middle)])
    return np.column_stack([np.cos(angle), np.sin(angle)]), [b[(b @ out).argmax(0)] for b in bodies]


def difference(body: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half planes n.x <= c of the steps by which a convex body meets its own copy, or another convex body moved by them, and their corners.

    Corners of the difference that rounding alone parts would be edges of any direction: the
    hull is of rounded corners, and each half plane holds all corners as they are.
    """
    other = body if other is None else other
    _, (far, near) = arcs(body, -other)
    steps = far + near
    d = G.hull(steps.round(9 - math.ceil(math.log10(max(float(np.abs(steps).max()), 1e-300)))))
    e = np.roll(d, -1, axis=0) - d
    n = np.column_stack([e[:, 1], -e[:, 0]])
    n /= np.sqrt((n**2).sum(1))[:, None]
    return n, (n @ body.T).max(1) - (n @ other.T).min(1), d


def hull_areas(body: np.ndarray, other: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Of each step, the area of the hull of a convex body and another one moved by it.

    Between two directions of arcs() one corner of each body is the outermost, and the farther
    of both is the hull's: at the begin of the stretch and at its end.
    """
    u, (a, b) = arcs(body, other)
    apart, b = (a - b)[None] - steps[:, None], b[None] + steps[:, None]
    ends = [np.where((np.einsum("mjk,jk->mj", apart, v) >= 0)[..., None], a, b) for v in (u, G.following(u))]
    x, y = np.stack(ends, axis=2).reshape(len(steps), -1, 2).transpose(2, 0, 1)
    return (x * np.roll(y, -1, axis=1) - y * np.roll(x, -1, axis=1)).sum(1) / 2


def _clip(n: np.ndarray, c: np.ndarray, at: np.ndarray, along: np.ndarray) -> tuple[float, float]:
    """The stretch of at + t * along within the half planes; empty if the first is not below the second."""
    speed, room = n @ along, c - n @ at
    up, down = speed > 1e-12, speed < -1e-12
    if (room[~up & ~down] <= 1e-9).any():
        return 0.0, 0.0
    return float((room[down] / speed[down]).max(initial=-np.inf)), float((room[up] / speed[up]).min(initial=np.inf))


def _clips(n: np.ndarray, c: np.ndarray, at: np.ndarray, along: np.ndarray) -> list[list[tuple[float, float]]]:
    """_clip of every at along every ray, at once: for each ray a list of stretches."""
    speed, room = n @ along.T, c[:, None] - n @ at.T
    up, down = speed > 1e-12, speed < -1e-12
    to = room[:, None, :] / np.where(up | down, speed, 1.0)[:, :, None]
    low = np.where(down[:, :, None], to, -np.inf).max(0)
    high = np.where(up[:, :, None], to, np.inf).min(0)
    level = (~(up | down)[:, :, None] & (room <= 1e-9)[:, None, :]).any(0)
    low[level] = high[level] = 0.0
    return [list(zip(a, b, strict=True)) for a, b in zip(low.tolist(), high.tolist(), strict=True)]


def _apart(n: np.ndarray, c: np.ndarray, first: np.ndarray, second: np.ndarray, reach: float) -> bool:
    """No step of the lattice lies within the half planes: steps whose row comes near enough are tried."""
    m = np.linalg.inv(np.column_stack([first, second]))
    i_most, j_most = (np.abs(m).sum(1) * reach).astype(int) + 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(-i_most, i_most + 1), np.arange(0, j_most + 1)))
    steps = np.outer(i, first) + np.outer(j, second)
    steps = steps[(i != 0) | (j != 0)]
    return not (n @ steps.T < c[:, None] - 1e-6).all(0).any()


def lattice(ring: np.ndarray, gap: float, directions: int = 36) -> tuple[np.ndarray, np.ndarray, float]:
    """Two steps of a densest lattice found for copies of the ring's hull kept gap apart, and its density.

    Copies a step apart overlap if the step lies within the body's difference with itself, so
    each contact is the exit of a ray.
    """
    n, c, _ = difference(G.hull(G.offset(G.hull(ring), gap / 2)))
    reach, best = float(c.max()), None
    for k in range(directions):
        t = math.pi * k / directions
        u = np.array([math.cos(t), math.sin(t)])
        first = _clip(n, c, np.zeros(2), u)[1] * u
        turns = [t + math.pi * m / directions for m in range(1, directions)]
        # of a neighbouring row those copies count that can reach the ray or the cell
        most = math.ceil(3 * reach / math.hypot(*first)) + 1
        rays = np.array([(math.cos(s), math.sin(s)) for s in turns])
        for v, taken in zip(rays, _clips(n, c, np.arange(-most, most + 1)[:, None] * first, rays), strict=True):
            far = 0.0
            for low, high in sorted(taken):
                if low < far + 1e-9 and high > far:
                    far = high
            second = far * v
            cell = abs(float(first[0] * second[1] - first[1] * second[0]))
            if cell > 1e-9 and (best is None or cell < best[0]) and _apart(n, c, first, second, reach):
                best = (cell, first, second)
    return best[1], best[2], abs(G.area(ring)) / best[0]


def fill_lattice(ring: np.ndarray, steps: tuple[np.ndarray, np.ndarray], sheet: tuple[float, float], phases: int = 3) -> np.ndarray:
    """Offsets of the copies that lie within a sheet, at the best of phases x phases shifts."""
    low, high = ring.min(0), ring.max(0)
    room = np.array(sheet) - (high - low)
    if (room < 0).any():
        return np.zeros((0, 2))
    m = np.column_stack(steps)
    span = int(np.ceil(np.abs(np.linalg.inv(m)).sum() * max(sheet))) + 2
    i, j = np.meshgrid(np.arange(-span, span + 1), np.arange(-span, span + 1))
    grid = np.column_stack([i.ravel(), j.ravel()]) @ m.T
    shifts = np.array([m @ np.array([a / phases, b / phases]) for a in range(phases) for b in range(phases)])
    # steps that no shift brings onto the sheet are many
    grid = grid[((grid + shifts.max(0) >= -1e-6) & (grid + shifts.min(0) <= room + 1e-6)).all(1)]
    at = grid + shifts[:, None]
    within = ((at >= -1e-9) & (at <= room + 1e-9)).all(2)
    best = int(within.sum(1).argmax())
    return at[best][within[best]] - low


def _duals(x: np.ndarray) -> np.ndarray:
    """Dual feasible functions (rows) of sizes, shares of one: sizes that fit side by side have values of at most one in sum."""
    rows = [x[None]]
    for k in range(1, 6):
        rows.append((np.floor((k + 1) * x) / k)[None])
    e = np.unique(np.concatenate([x[x <= 0.5], 1 - x[x >= 0.5]]))
    e = e[e > 0][:, None]
    rows.append(np.where(x > 1 - e, 1.0, np.where(x < e, 0.0, x)))
    n = np.floor(1 / e)
    rows.append(np.where(x > 0.5, 1 - np.floor((1 - x) / e) / n, np.where(x >= e, 1 / n, 0.0)))
    return np.vstack(rows)


def least_pages(items: list[tuple[int, float, float, int]], sheet: tuple[float, float], gap: float) -> int:
    """A number of sheets that all of items (id, w, h, demand) need, however they are placed: Fekete and Schepers' bounds, area among them.

    Sizes are a hair less, as places may meet by one; items larger than a sheet count as one that fills it.
    """
    if not items:
        return 0
    w, h, n = (np.array([i[k] for i in items], float) for k in (1, 2, 3))
    x, y = (np.clip((v + gap - 1e-6) / s, 0.0, 1.0 - 1e-9) for v, s in ((w, sheet[0]), (h, sheet[1])))
    return math.ceil(float(((_duals(x) * n) @ _duals(y).T).max()) - 1e-6)


def uniforms(seed: int, n: int) -> np.ndarray:
    """A stream of its own for each seed: the same on every machine and partitioning."""
    return np.random.Generator(np.random.Philox(seed)).random(n)


def left_bottom(w: float, h: float, placed: np.ndarray, sheet: tuple[float, float], gap: float, seed: int, samples: int = 400, local: float = 0.2, drawn: list | None = None) -> tuple[float, float] | None:
    """The free place of least 10 x_max + y_max: parts' corners, uniform samples, then ever closer ones around the best; cost before collision.

    The sheet is deflated by half the gap, as each rectangle is inflated by it. Nothing is drawn
    where no sample can better a corner; where one could, drawn gets the seed.
    """
    half = gap / 2
    low = np.array([half, half])
    high = np.array(sheet) - half - (w, h)
    if (high < low - 1e-12).any():
        return None
    least = corner(w, h, placed[np.argsort(placed[:, 1], kind="stable")].tolist(), sheet, gap)
    if least is None:
        return None
    best, cost = None, math.inf

    def attempt(points: np.ndarray) -> None:
        nonlocal best, cost
        loss = 10 * (points[:, 0] + w) + points[:, 1] + h
        points = points[(loss < cost) & ((points >= low - 1e-9) & (points <= high + 1e-9)).all(1)]
        if len(placed) and len(points):
            x, y = points[:, :1], points[:, 1:]
            hit = (placed[:, 0] < x + (w + gap - 1e-9)) & (placed[:, 2] > x - (gap - 1e-9)) & (placed[:, 1] < y + (h + gap - 1e-9)) & (placed[:, 3] > y - (gap - 1e-9))
            points = points[~hit.any(1)]
        if len(points):
            loss = 10 * (points[:, 0] + w) + points[:, 1] + h
            k = int(loss.argmin())
            best, cost = (float(points[k, 0]), float(points[k, 1])), float(loss[k])

    floor_ = np.full(len(placed), half)
    attempt(np.vstack([low[None], *([np.column_stack([placed[:, 2] + gap, placed[:, 1]]), np.column_stack([placed[:, 0], placed[:, 3] + gap]), np.column_stack([placed[:, 2] + gap, floor_])] if len(placed) else [])]))
    if cost <= 10 * (least[0] + w) + least[1] + h + 1e-6:
        return best
    if drawn is not None:
        drawn.append(seed)
    n_local = int(samples * local)
    u = uniforms(seed, 2 * samples).reshape(-1, 2)
    attempt(low + u[: samples - n_local] * (high - low))
    if best is not None and n_local:
        for k, part in enumerate(np.array_split(u[samples - n_local :], 4)):
            reach = (high - low) * 0.1 * 0.3**k
            attempt(np.array(best) + (part - 0.5) * 2 * reach)
    return best


_foot = itemgetter(1)


def corner(w: float, h: float, placed: list[tuple], sheet: tuple[float, float], gap: float) -> tuple[float, float] | None:
    """The free place of least 10 x_max + y_max, exactly: it leans on the sheet's or a part's side at its left, and then on a lower one.

    placed: (x0, y0, x1, y1) by y0.
    """
    half, slack = gap / 2, gap - 1e-9
    most_x, most_y = sheet[0] - half - w, sheet[1] - half - h
    if most_x < half - 1e-12 or most_y < half - 1e-12:
        return None
    best, cost = None, math.inf
    boxes = np.array(placed) if len(placed) > 64 else None
    for x in sorted({half, *(p[2] + gap for p in placed)}):
        if x > most_x + 1e-9 or 10 * x + half >= cost:
            break
        left, right = x - slack, x + w + slack
        met = placed if boxes is None else map(placed.__getitem__, np.flatnonzero((boxes[:, 0] < right) & (boxes[:, 2] > left)).tolist())
        y = half
        for x0, y0, x1, y1 in met:
            if x0 < right and x1 > left and y1 > y - slack:
                if y0 >= y + h + slack:
                    break
                y = y1 + gap
        if y <= most_y + 1e-9 and 10 * x + y < cost:
            best, cost = (x, y), 10 * x + y
    return best


def fill_bins(items: list[tuple[int, float, float, int]], bins: list[tuple[int, float, float, int]], gap: float, seed: int, samples: int = 400, local: float = 0.2, exact: bool = False, drawn: list | None = None) -> list[tuple[int, int, int, float, float, float, float]]:
    """items (id, w, h, demand), bins (id, w, h, stock) -> (layout, bin, item, x0, y0, x1, y1). Open layouts before new bins, largest items first.

    exact: places of corner(), which no sample betters, instead of sampled ones that differ by seed;
    drawn: of those, gets the seeds of samples. A run that draws none is the same for every seed.
    """
    layouts: list[list] = []
    stock = {b[0]: b[3] for b in bins}
    out, draw = [], 0
    for item, w, h, demand in sorted(items, key=lambda i: (-(i[1] ** 2 + i[2] ** 2), i[0])):
        for _ in range(demand):
            for k in range(len(layouts) + len(bins)):
                fresh = k >= len(layouts)
                b = bins[k - len(layouts)] if fresh else layouts[k][0]
                if fresh and stock[b[0]] <= 0:
                    continue
                draw += 1
                if exact:
                    at = corner(w, h, [] if fresh else layouts[k][1], b[1:3], gap)
                else:
                    at = left_bottom(w, h, np.zeros((0, 4)) if fresh else np.array(layouts[k][1]), b[1:3], gap, seed * 1_000_003 + draw, samples, local, drawn)
                if at:
                    if fresh:
                        stock[b[0]] -= 1
                        layouts.append([b, []])
                        k = len(layouts) - 1
                    r = (at[0], at[1], at[0] + w, at[1] + h)
                    insort(layouts[k][1], r, key=_foot)
                    out.append((k, b[0], item, *r))
                    break
            else:
                break
    return out


def fill_strip(items: list[tuple[int, float, float, int]], height: float, gap: float, seed: int, samples: int = 400, exact: bool = False) -> tuple[float, list[tuple[int, float, float, float, float]]]:
    """items (id, w, h, demand) -> (fitted width, placements): the strip begins at the items' area by height and grows by a tenth when one doesn't fit."""
    width = max(max((w for _, w, _, _ in items), default=0.0) + gap, sum(w * h * n for _, w, h, n in items) / height)
    placed: list = []
    out, draw = [], 0
    for item, w, h, demand in sorted(items, key=lambda i: (-(i[1] ** 2 + i[2] ** 2), i[0])):
        for _ in range(demand):
            if h + gap > height:
                break
            while True:
                draw += 1
                at = corner(w, h, placed, (width, height), gap) if exact else left_bottom(w, h, np.array(placed).reshape(-1, 4), (width, height), gap, seed * 1_000_003 + draw, samples)
                if at:
                    break
                width *= 1.1
            r = (at[0], at[1], at[0] + w, at[1] + h)
            insort(placed, r, key=_foot)
            out.append((item, *r))
    return max((r[3] for r in out), default=0.0) * 1.00001 + gap / 2, out

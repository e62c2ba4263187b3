"""Iterative plane geometry in numpy: poles, hulls, simplification, offsets, free rectangles. No Spark here.

A ring is an (n, 2) array, counter-clockwise, its last vertex not repeated.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def following(ring: np.ndarray) -> np.ndarray:
    """The vertex after each: np.roll(), in a tenth of its time on short rings."""
    return np.concatenate((ring[1:], ring[:1]))


class Edges:
    """The edges of a ring, for the distances and sides of many points."""

    def __init__(self, ring: np.ndarray):
        after = following(ring)
        step = after - ring
        self.x, self.y, self.x2, self.y2 = ring[:, 0].copy(), ring[:, 1].copy(), after[:, 0].copy(), after[:, 1].copy()
        self.dx, self.dy, self.square = step[:, 0].copy(), step[:, 1].copy(), np.maximum((step * step).sum(1), 1e-300)
        self.rise = np.where(self.y2 == self.y, 1.0, self.y2 - self.y)

    def squares(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of each point to the boundary."""
        gx, gy = points[:, :1] - self.x, points[:, 1:] - self.y
        t = np.minimum(np.maximum((gx * self.dx + gy * self.dy) / self.square, 0.0), 1.0)
        gx -= t * self.dx
        gy -= t * self.dy
        return (gx * gx + gy * gy).min(1)

    def inside(self, points: np.ndarray) -> np.ndarray:
        """Parity of the edges to the right."""
        x, y = points[:, :1], points[:, 1:]
        level = (self.y < y) != (self.y2 < y)
        at = self.x + (y - self.y) / self.rise * (self.x2 - self.x)
        return np.count_nonzero(level & (x < at), axis=1) % 2 == 1


def edge_distances(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Of each point to the boundary."""
    return np.sqrt(Edges(ring).squares(points))


def inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Parity of the edges to the right."""
    return Edges(ring).inside(points)


class Clearance:
    """Squares over a ring with the distances of their middles to the boundary and to the circles taken, kept and split further from one pole to the next."""

    TOGETHER = 32

    def __init__(self, ring: np.ndarray, precision: float):
        low, high = ring.min(0), ring.max(0)
        half = float((high - low).max()) / 2
        self.edges, self.close, self.taken = Edges(ring), precision * max(half, 1e-12), np.zeros((0, 3))
        self.at, self.half = ((low + high) / 2)[None], np.array([half])
        self.clear = self._clear(self.at)

    def _clear(self, p: np.ndarray) -> np.ndarray:
        d = np.sqrt(self.edges.squares(p)) * np.where(self.edges.inside(p), 1, -1)
        if len(self.taken):
            x, y = p[:, :1] - self.taken[:, 0], p[:, 1:] - self.taken[:, 1]
            d = np.minimum(d, (np.sqrt(x * x + y * y) - self.taken[:, 2]).min(1))
        return d

    def take(self, circle: tuple[float, float, float]) -> None:
        self.taken = np.vstack([self.taken, circle])
        self.clear = np.minimum(self.clear, np.sqrt(((self.at - circle[:2]) ** 2).sum(1)) - circle[2])
        live = self.clear + self.half * math.sqrt(2) > 0
        live[self.clear.argmax()] = True
        self.at, self.half, self.clear = self.at[live], self.half[live], self.clear[live]

    def pole(self) -> tuple[float, float, float]:
        """Branch and bound: squares that may hold a larger circle, those of the highest bound first, fall into four."""
        while True:
            bound, k = self.clear + self.half * math.sqrt(2), int(self.clear.argmax())
            live = np.flatnonzero(bound > self.clear[k] + self.close)
            if not len(live):
                return float(self.at[k, 0]), float(self.at[k, 1]), float(self.clear[k])
            if len(live) > self.TOGETHER:
                live = live[np.argpartition(-bound[live], self.TOGETHER)[: self.TOGETHER]]
            h = self.half[live] / 2
            kids = (self.at[live][:, None] + h[:, None, None] * np.array([(-1, -1), (-1, 1), (1, -1), (1, 1)])).reshape(-1, 2)
            h, d = np.repeat(h, 4), self._clear(kids)
            # a middle stays as a place without a square if it is the best so far
            keep = np.ones(len(self.half), bool)
            keep[live] = False
            if not keep[k]:
                keep[k], self.half[k] = True, 0.0
            new = d + h * math.sqrt(2) > 0
            self.at, self.half, self.clear = np.vstack([self.at[keep], kids[new]]), np.append(self.half[keep], h[new]), np.append(self.clear[keep], d[new])


def pole(ring: np.ndarray, taken: np.ndarray | None = None, precision: float = 1e-3) -> tuple[float, float, float]:
    """Largest circle inside the ring and outside the circles taken (cx, cy, r)."""
    field = Clearance(ring, precision)
    for c in np.zeros((0, 3)) if taken is None else np.asarray(taken, float).reshape(-1, 3):
        field.take(c)
    return field.pole()


def _series(ring: np.ndarray, enough: Callable[[int, float], bool], precision: float = 1e-3) -> np.ndarray:
    """Poles one after the other, until none is left or there are enough: of (number, share covered)."""
    field, circles, whole, covered = Clearance(ring, precision), [], max(abs(area(ring)), 1e-300), 0.0
    while not enough(len(circles), covered / whole):
        c = field.pole()
        if c[2] <= 1e-9:
            break
        field.take(c)
        circles.append(c)
        covered += math.pi * c[2] ** 2
    return np.array(circles).reshape(-1, 3)


def surrogate(ring: np.ndarray, most: int = 10, coverage: float = 0.9) -> np.ndarray:
    """Poles until they cover a share of the ring or there are enough."""
    return _series(ring, lambda n, share: n >= most or share >= coverage)


def poles(ring: np.ndarray, limits: tuple[tuple[int, float], ...]) -> np.ndarray:
    """Poles until there are as many as the least limit (number, share) whose share they cover more than."""
    return _series(ring, lambda n, share: n > 0 and n >= min((m for m, least in limits if share > least), default=1000))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the lowest left point."""
    p = sorted(set(map(tuple, points.tolist())))

    def chain(row):
        out: list = []
        for q in row:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(p if len(p) < 3 else chain(p) + chain(p[::-1]))


def simplify(ring: np.ndarray, share: float, grow: bool = True) -> np.ndarray:
    """Fewer vertices, one-sided: a growing ring drops concave corners, a shrinking one convex ones, least change first, up to a share of the area."""
    ring, left = ring.copy(), share * abs(area(ring))
    while len(ring) > 3:
        before, after = np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0)
        turn = (ring[:, 0] - before[:, 0]) * (after[:, 1] - before[:, 1]) - (ring[:, 1] - before[:, 1]) * (after[:, 0] - before[:, 0])
        change = np.where((turn <= 0) if grow else (turn >= 0), np.abs(turn) / 2, np.inf)
        for k in np.argsort(change, kind="stable"):
            if change[k] > left:
                return ring
            fewer = np.delete(ring, k, axis=0)
            if not crossings(fewer):
                ring, left = fewer, left - change[k]
                break
        else:
            return ring
    return ring


def crossings(ring: np.ndarray) -> bool:
    """Whether two edges, not neighbours, meet."""
    n = len(ring)
    a, b = ring, np.roll(ring, -1, axis=0)
    d = b - a
    det = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    gap = a[None, :] - a[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * d[None, :, 1] - gap[..., 1] * d[None, :, 0]) / det
        u = (gap[..., 0] * d[:, None, 1] - gap[..., 1] * d[:, None, 0]) / det
    hit = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    i, j = np.nonzero(hit)
    apart = (np.abs(i - j) > 1) & (np.abs(i - j) < n - 1)
    return bool(apart.any())


def offset(ring: np.ndarray, by: float, step: float = math.pi / 8) -> np.ndarray:
    """The ring moved outwards (by > 0) with round joins at convex corners, or inwards; if the result crosses itself, by falls by quarters."""
    for _ in range(16):
        if by == 0:
            return ring.copy()
        n = len(ring)
        d = np.roll(ring, -1, axis=0) - ring
        normal = np.column_stack([d[:, 1], -d[:, 0]]) / np.maximum(np.sqrt((d**2).sum(1)), 1e-300)[:, None]
        out: list = []
        for k in range(n):
            m, q = normal[k - 1], normal[k]
            turn = m[0] * q[1] - m[1] * q[0]
            if turn * by > 1e-12:
                angle = math.atan2(turn, float(m @ q))
                count = max(1, math.ceil(abs(angle) / step))
                for t in range(count + 1):
                    c, s = math.cos(angle * t / count), math.sin(angle * t / count)
                    out.append(ring[k] + by * np.array([m[0] * c - m[1] * s, m[0] * s + m[1] * c]))
            else:
                half = m + q
                out.append(ring[k] + by * half * (2 / max(float(half @ half), 1e-12)))
        moved = np.array(out)
        if not crossings(moved) and area(moved) > 0:
            return moved
        by *= 0.75
    return ring.copy()


def _without(free: list[tuple], taken: tuple, least: float) -> list[tuple]:
    """The maximal free rectangles once another rectangle is taken: those that it meets fall into up to four."""
    x0, y0, x1, y1 = taken
    kept, cut = [], set()
    for r in free:
        a, b, c, d = r
        if x0 >= c or x1 <= a or y0 >= d or y1 <= b:
            kept.append(r)
            continue
        if x0 > a and (x0 - a) * (d - b) >= least:
            cut.add((a, b, x0, d))
        if x1 < c and (c - x1) * (d - b) >= least:
            cut.add((x1, b, c, d))
        if y0 > b and (c - a) * (y0 - b) >= least:
            cut.add((a, b, c, y0))
        if y1 < d and (c - a) * (d - y1) >= least:
            cut.add((a, y1, c, d))
    if not cut:
        return kept
    whole = [*kept, *cut]
    for r in cut:
        a, b, c, d = r
        for p, q, u, v in whole:
            if p <= a and q <= b and u >= c and v >= d and (p, q, u, v) != r:
                break
        else:
            kept.append(r)
    return kept


def _rows(boxes) -> list[tuple]:
    return boxes if isinstance(boxes, list) else np.asarray(boxes, float).reshape(-1, 4).tolist()


def emptiest(box: tuple, taken: list[tuple] | np.ndarray, least: float = 0.0) -> Iterator[tuple]:
    """The largest free rectangle (x0, y0, x1, y1), taken in its turn, and so on while one of the least area is left; the first by x0, x1, y0 on ties."""
    least = max(least, 1e-9)
    free = [tuple(box)]
    for t in _rows(taken):
        free = _without(free, t, least)
    while free:
        best = min(free, key=lambda r: (-(r[2] - r[0]) * (r[3] - r[1]), r[0], r[2], r[1]))
        if (best[2] - best[0]) * (best[3] - best[1]) < least:
            return
        yield best
        free = _without(free, best, least)


def largest_empty(box: tuple, taken: list[tuple] | np.ndarray) -> tuple | None:
    return next(emptiest(box, taken), None)


def free_rectangles(box: tuple, taken: list[tuple] | np.ndarray, min_w: float, min_h: float) -> list[tuple]:
    """Largest first, each then taken itself; those too small on a side are used up but left out."""
    return [r for r in emptiest(box, taken, min_w * min_h) if r[2] - r[0] >= min_w and r[3] - r[1] >= min_h]


def free_polygons(box: tuple, taken: list[tuple] | np.ndarray) -> list[dict]:
    """What rectangles leave free: connected parts as outer rings with holes, over the grid of all sides."""
    xs, ys, covered = _covered(box, _rows(taken))
    tall, high = len(ys) + 1, len(ys) - 1
    return _outlines(xs, ys, {c for k in range(0, tall * (len(xs) - 1), tall) for c in range(k, k + high)} - covered)


def joined(boxes: list[tuple]) -> list[dict]:
    """The union of rectangles (x0, y0, x1, y1): connected parts as outer rings with holes."""
    if not (boxes := _rows(boxes)):
        return []
    low, high = [min(v) for v in zip(*boxes, strict=True)], [max(v) for v in zip(*boxes, strict=True)]
    return _outlines(*_covered((*low[:2], *high[2:]), boxes))


def _covered(box: tuple, taken: list[tuple]) -> tuple[list[float], list[float], set[int]]:
    """The grid of all sides, and which of its cells rectangles cover.

    Cell (i, j) is the number i * (len(ys) + 1) + j, as is the corner at its lower left: numbers
    of neighbours differ by 1 or len(ys) + 1, and no cell is beyond the grid's edge.
    """
    x0, y0, x1, y1 = box
    xs = sorted({x0, x1, *(v for t in taken for v in (t[0], t[2]) if x0 < v < x1)})
    ys = sorted({y0, y1, *(v for t in taken for v in (t[1], t[3]) if y0 < v < y1)})
    tall, covered = len(ys) + 1, set()
    for a, b, c, d in taken:
        low, high = bisect_left(ys, b), min(bisect_left(ys, d), len(ys) - 1)
        for i in range(bisect_left(xs, a), min(bisect_left(xs, c), len(xs) - 1)):
            covered.update(range(i * tall + low, i * tall + high))
    return xs, ys, covered


def _outlines(xs: list[float], ys: list[float], cells: set[int]) -> list[dict]:
    """The connected cells of a grid, numbered as by _covered, largest first."""
    left, out, tall = cells, [], len(ys) + 1
    way = {tall: (1, 0), -tall: (-1, 0), 1: (0, 1), -1: (0, -1)}
    while left:
        stack = [min(left)]
        left.discard(stack[0])
        own = set(stack)
        while stack:
            at = stack.pop()
            for c in (at + tall, at - tall, at + 1, at - 1):
                if c in left:
                    left.discard(c)
                    own.add(c)
                    stack.append(c)
        # sides of cells with the part on their left, by the corner they begin at; some corners begin two
        sides = [(c, c + tall) for c in own if c - 1 not in own]
        sides += [(c + tall, c + tall + 1) for c in own if c + tall not in own]
        sides += [(c + tall + 1, c + 1) for c in own if c + 1 not in own]
        sides += [(c + 1, c) for c in own if c - tall not in own]
        step, second = dict(sides), {}
        if len(step) < len(sides):
            second = {a: b for a, b in sides if step[a] != b}
        rings = []
        for first in sorted(step):
            while first in step:
                at, path, last = first, [first], None
                while True:
                    nxt = step.pop(at)
                    if at in second:
                        step[at] = second.pop(at)
                        if last is not None:
                            # at a corner shared by two cells, turn left: rings don't cross
                            (x, y), (u, v), (p, q) = way[at - last], way[nxt - at], way[step[at] - at]
                            if x * q - y * p > x * v - y * u:
                                nxt, step[at] = step[at], nxt
                    last, at = at, nxt
                    if at == first:
                        break
                    path.append(at)
                path.append(first)
                pts = [(xs[p // tall], ys[p % tall]) for k, p in enumerate(path[:-1]) if (abs(p - path[k - 1 if k else -2]) == 1) != (abs(path[k + 1] - p) == 1)]
                whole = sum(pts[k - 1][0] * y - x * pts[k - 1][1] for k, (x, y) in enumerate(pts)) / 2
                rings.append((whole, np.array(pts)))
        rings.sort(key=lambda r: -r[0])
        out.append({"outer": rings[0][1], "holes": [r for _, r in rings[1:]], "area": sum(a for a, _ in rings)})
    return sorted(out, key=lambda p: -p["area"])

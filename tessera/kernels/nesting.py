"""Left-bottom-fill over polygons, in numpy: rotations, quality zones, poles before exact tests. No Spark here.

A shape is a ring about its own origin; a placement turns it by an angle, then moves it. Rings
that touch collide, so parts are widened and containers narrowed by half the gap and a hair less.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from tessera.kernels import geometry as G
from tessera.kernels.search import _clips, difference, fill_lattice, hull_areas, lattice

#: Standard deviations of the local search, of the sheet's larger side and of the turn, when it begins and ends.
MOVE, TURN = (0.01, 0.001), (math.radians(2.0), math.radians(0.5))
HAIR, TOGETHER = 1e-7, 64


@dataclass
class Part:
    """turns: allowed angles, None for any; quality: the least that zones under it must have, None for the best."""

    id: int
    ring: np.ndarray
    demand: int = 1
    turns: tuple[float, ...] | None = (0.0,)
    quality: int | None = None


@dataclass
class Sheet:
    """A container: bins have a stock and a cost; zones are (quality, ring), holes of quality 0."""

    id: int
    ring: np.ndarray
    stock: int = 1
    cost: int = 0
    zones: list[tuple[int, np.ndarray]] = field(default_factory=list)


class Body:
    """A ring that others may not meet, its edges and box once and for all."""

    def __init__(self, ring: np.ndarray, circles: np.ndarray = np.zeros((0, 3))):
        self.ring, self.step, self.edges, self.circles = ring, G.following(ring) - ring, G.Edges(ring), circles
        self.low, self.high = ring.min(0), ring.max(0)
        self.inner = (self.low + 1e-9).tolist(), (self.high - 1e-9).tolist()
        self.is_box = len(ring) == 4 and bool((np.minimum(ring - self.low, self.high - ring) < 1e-12).all())

    def crossed(self, ring: np.ndarray) -> bool:
        """Whether edges meet; parallel ones never do."""
        d, e = G.following(ring) - ring, self.step
        det = d[:, None, 0] * e[:, 1] - d[:, None, 1] * e[:, 0]
        gap = self.ring - ring[:, None]
        safe = np.where(det == 0, 1.0, det)
        t = (gap[..., 0] * e[:, 1] - gap[..., 1] * e[:, 0]) / safe
        u = (gap[..., 0] * d[:, None, 1] - gap[..., 1] * d[:, None, 0]) / safe
        return bool(((det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any())

    def meets(self, ring: np.ndarray) -> bool:
        if (ring.min(0) > self.high).any() or (ring.max(0) < self.low).any():
            return False
        return self.crossed(ring) or bool(self.edges.inside(ring[:1])[0]) or bool(G.inside(self.ring[:1], ring)[0])

    def holds(self, ring: np.ndarray, low: np.ndarray, high: np.ndarray) -> bool:
        """Whether a ring, of a box, lies within; in a box without touching it, its own box says so."""
        (x0, y0), (x1, y1), (a, b), (c, d) = low.tolist(), high.tolist(), self.inner[0], self.inner[1]
        if self.is_box and x0 > a and y0 > b and x1 < c and y1 < d:
            return True
        return bool((low >= self.low).all() and (high <= self.high).all()) and not self.crossed(ring) and bool(self.edges.inside(ring[:1])[0])


class Bodies:
    """Many bodies as one: their boxes, circles within them and edges, in arrays."""

    def __init__(self, bodies: list[Body]):
        self.bodies = bodies
        self.lows, self.highs, self.first = (np.array([v for b in bodies for v in k(b)]).reshape(-1, 2) for k in (lambda b: b.low, lambda b: b.high, lambda b: b.ring[0]))
        self.circles = np.vstack([np.zeros((0, 3)), *(b.circles for b in bodies)])
        self.x, self.y, self.dx, self.dy, x2, y2 = (np.concatenate([np.zeros(0), *(getattr(b.edges, k) for b in bodies)]) for k in ("x", "y", "dx", "dy", "x2", "y2"))
        self.x_min, self.x_max, self.y_min, self.y_max = np.minimum(self.x, x2) - 1e-9, np.maximum(self.x, x2) + 1e-9, np.minimum(self.y, y2) - 1e-9, np.maximum(self.y, y2) + 1e-9

        most = max((len(b.ring) for b in bodies), default=1)
        # rings of one length: a corner that is repeated adds edges of no length, which no ray crosses
        self.padded = np.zeros((5, len(bodies), most))
        for k, b in enumerate(bodies):
            e, n = b.edges, len(b.ring)
            for row, v, last in zip(self.padded[:, k], (e.x, e.y, e.y2, e.x2 - e.x, e.rise), (0.0, e.y[0], e.y[0], 0.0, 1.0), strict=True):
                row[:n], row[n:] = v, last

    def inside(self, points: np.ndarray) -> np.ndarray:
        """Of each point: it lies in any."""
        out = np.zeros(len(points), bool)
        x, y = points[:, 0], points[:, 1]
        box = (x[:, None] >= self.lows[:, 0]) & (x[:, None] <= self.highs[:, 0]) & (y[:, None] >= self.lows[:, 1]) & (y[:, None] <= self.highs[:, 1])
        p, h = np.divmod(np.flatnonzero(box), max(len(self.bodies), 1))
        if len(p):
            ex, ey, ey2, run, rise = self.padded[:, h]
            x, y = x[p, None], y[p, None]
            level = (ey < y) != (ey2 < y)
            at = ex + (y - ey) / rise * run
            out[p[np.count_nonzero(level & (x < at), axis=1) % 2 == 1]] = True
        return out

    def apart(self, x: np.ndarray, y: np.ndarray, r: float) -> np.ndarray:
        """Of circles of a radius: none meets one within a body."""
        cx, cy, cr = self.circles.T
        far = x[:, None] - cx
        far *= far
        far += (y[:, None] - cy) ** 2
        return (far >= (np.maximum(cr + r - 1e-9, 0.0)) ** 2).all(1)

    def meet(self, ring: np.ndarray, low: np.ndarray, high: np.ndarray) -> bool:
        """Whether one meets a ring, of a box, of which no corner lies in any."""
        (x0, y0), (x1, y1) = low.tolist(), high.tolist()
        k = np.flatnonzero((self.x_min <= x1) & (self.x_max >= x0) & (self.y_min <= y1) & (self.y_max >= y0))
        if len(k):
            x, y, d, e0, e1 = ring[:, :1], ring[:, 1:], G.following(ring) - ring, self.dx[k], self.dy[k]
            d0, d1, gx, gy = d[:, :1], d[:, 1:], self.x[k] - x, self.y[k] - y
            det = d0 * e1 - d1 * e0
            safe = np.where(det == 0, 1.0, det)
            t, u = (gx * e1 - gy * e0) / safe, (gx * d1 - gy * d0) / safe
            if ((det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any():
                return True
        near = ((self.lows <= (x1, y1)) & (self.highs >= (x0, y0))).all(1)
        return bool(near.any()) and bool(G.inside(self.first[near], ring).any())


def turned(points: np.ndarray, angle: float) -> np.ndarray:
    c, s = math.cos(angle), math.sin(angle)
    return points @ np.array([[c, s], [-s, c]])


class Layout:
    """A container with what lies in it; version counts its changes."""

    def __init__(self, sheet: Sheet, gap: float):
        self.sheet, self.gap = sheet, gap
        narrow = G.offset(sheet.ring, -gap / 2 + HAIR) if gap > 0 else sheet.ring
        self.outer = Body(narrow)
        self.zones = [(q, Body(G.offset(r, gap / 2 - HAIR) if gap > 0 else r)) for q, r in sheet.zones]
        self.placed: list[tuple[int, float, float, float, Body]] = []

    def hazards(self, quality: int | None) -> list[Body]:
        """What a part of that quality must not meet: zones of a lesser one (of any, for the best) and placed parts."""
        return [z for q, z in self.zones if quality is None or q < quality] + [p[4] for p in self.placed]


@dataclass
class Model:
    """What the search needs of a part: its ring widened by half the gap, and the few first poles of it."""

    part: Part
    ring: np.ndarray
    poles: np.ndarray
    diameter: float

    @classmethod
    def of(cls, part: Part, gap: float, poles: int = 2) -> Model:
        ring = G.offset(part.ring, gap / 2 - HAIR) if gap > 0 else part.ring
        circles = []
        for _ in range(poles):
            c = G.pole(ring, np.array(circles) if circles else None, 0.05)
            if c[2] <= 0:
                break
            circles.append(c)
        far = ring[:, None] - ring[None]
        return cls(part, ring, np.array(circles).reshape(-1, 3), float(np.sqrt((far**2).sum(2).max())))


def _poles_clear(model: Model, tries: np.ndarray, layout: Layout, hazards: Bodies, cost: float) -> np.ndarray:
    """Of each try (angle, x, y): no pole reaches over the container's rim, into a circle within a hazard or beyond a loss of cost."""
    ok = np.ones(len(tries), bool)
    (x0, y0), (x1, y1) = (layout.outer.low - 1e-9).tolist(), (layout.outer.high + 1e-9).tolist()
    c, s = np.cos(tries[:, 0]), np.sin(tries[:, 0])
    poles = [(px * c - py * s + tries[:, 1], px * s + py * c + tries[:, 2], r) for px, py, r in model.poles.tolist()]
    for x, y, r in poles:
        ok &= (x - r >= x0) & (y - r >= y0) & (x + r <= x1) & (y + r <= y1) & (10 * x + y < cost - 11 * r + 1e-6)
    if len(hazards.circles):
        for x, y, r in poles:
            live = np.flatnonzero(ok)
            ok[live] = hazards.apart(x[live], y[live], r)
    return ok


def _moved(ring: np.ndarray, tries: np.ndarray) -> np.ndarray:
    """[tries, corners, 2]"""
    c, s = np.cos(tries[:, :1]), np.sin(tries[:, :1])
    x, y = ring[:, 0], ring[:, 1]
    return np.stack([x * c - y * s + tries[:, 1:2], x * s + y * c + tries[:, 2:]], axis=2)


def _corners_clear(rings: np.ndarray, low: np.ndarray, high: np.ndarray, layout: Layout, hazards: Bodies) -> np.ndarray:
    """Of each ring and its box: the box lies in the container's, and no corner in a hazard. What passes is tested exactly."""
    ok = ((low >= layout.outer.low) & (high <= layout.outer.high)).all(1)
    live = np.flatnonzero(ok)
    if len(live) and hazards.bodies:
        ok[live[hazards.inside(rings[live].reshape(-1, 2)).reshape(len(live), -1).any(1)]] = False
    return ok


def _loss(model: Model, tries: np.ndarray) -> np.ndarray:
    """10 x_max + y_max of the widened ring at each try."""
    c, s = np.cos(tries[:, :1]), np.sin(tries[:, :1])
    x = (model.ring[:, 0] * c - model.ring[:, 1] * s).max(1) + tries[:, 1]
    return 10 * x + (model.ring[:, 0] * s + model.ring[:, 1] * c).max(1) + tries[:, 2]


def search(model: Model, layout: Layout, draw: np.random.Generator, samples: int, local: float) -> tuple[float, float, float] | None:
    """The valid try of least loss: uniform ones over a box that each success tightens, then normal ones around the best, ever closer."""
    hazards = layout.hazards(model.part.quality)
    all_ = Bodies(hazards)
    low, high = layout.outer.low, layout.outer.high.copy()
    turns = model.part.turns
    best, cost = None, math.inf

    def attempt(tries: np.ndarray) -> None:
        nonlocal best, cost
        # tests in turn, ever dearer ones for ever fewer tries, at last of least loss first: what any finds cannot lie there or is no gain
        tries = tries[_poles_clear(model, tries, layout, all_, cost)]
        loss = _loss(model, tries)
        order = np.flatnonzero(loss < cost)
        order = order[np.argsort(loss[order], kind="stable")]
        for m in range(0, len(order), TOGETHER):
            own = order[m : m + TOGETHER]
            rings = _moved(model.ring, tries[own])
            low, high = rings.min(1), rings.max(1)
            for k in np.flatnonzero(_corners_clear(rings, low, high, layout, all_)).tolist():
                if layout.outer.holds(rings[k], low[k], high[k]) and not all_.meet(rings[k], low[k], high[k]):
                    best, cost = tuple(tries[own[k]].tolist()), float(loss[own[k]])
                    return

    n_local = int(samples * local)
    for part in np.array_split(np.arange(samples - n_local), max(1, (samples - n_local) // 500)):
        n = len(part)
        angle = draw.uniform(0, 2 * math.pi, n) if turns is None else np.array(turns)[draw.integers(0, len(turns), n)]
        attempt(np.column_stack([angle, draw.uniform(low[0], high[0], n), draw.uniform(low[1], high[1], n)]))
        if best is not None:
            high[0] = min(high[0], max(low[0], cost / 10))
    if best is None:
        return None
    side = float((layout.outer.high - layout.outer.low).max())
    for k in range(steps := 10):
        n, t = n_local // steps, k / steps
        move, turn = (a * (b / a) ** t for a, b in (MOVE, TURN))
        angle = np.full(n, best[0]) if turns is not None else best[0] + draw.normal(0, turn, n)
        attempt(np.column_stack([angle, best[1] + draw.normal(0, move * side, n), best[2] + draw.normal(0, move * side, n)]))
    return best


def _ordered(parts: list[Part], gap: float) -> list[Model]:
    return sorted((Model.of(p, gap) for p in parts), key=lambda m: (-m.diameter, m.part.id))


def _put(layout: Layout, model: Model, at: tuple[float, float, float]) -> None:
    circles = np.column_stack([turned(model.poles[:, :2], at[0]) + np.array(at[1:]), model.poles[:, 2]])
    layout.placed.append((model.part.id, *at, Body(turned(model.ring, at[0]) + np.array(at[1:]), circles)))


def fill_bins(parts: list[Part], sheets: list[Sheet], gap: float, seed: int, samples: int = 5_000, local: float = 0.2) -> list[Layout]:
    """Largest parts first, each in the first open layout that takes it, else in a new one of the first sheet with stock that does."""
    draw = np.random.Generator(np.random.Philox(seed))
    layouts: list[Layout] = []
    stock = {s.id: s.stock for s in sheets}
    for model in _ordered(parts, gap):
        for _ in range(model.part.demand):
            for layout in [*layouts, *(Layout(s, gap) for s in sheets if stock[s.id] > 0)]:
                if at := search(model, layout, draw, samples, local):
                    if layout not in layouts:
                        stock[layout.sheet.id] -= 1
                        layouts.append(layout)
                    _put(layout, model, at)
                    break
            else:
                break
    return layouts


def box(width: float, height: float) -> np.ndarray:
    return np.array([(0.0, 0.0), (width, 0.0), (width, height), (0.0, height)])


def fill_strips(parts: list[Part], height: float, gap: float, seed: int, most: float = math.inf, samples: int = 5_000, local: float = 0.2) -> list[Layout]:
    """Strips of one height: the last one grows by a tenth, up to a width of most, where a part finds no place; then another one begins. Ends are cut to what lies in them."""
    draw = np.random.Generator(np.random.Philox(seed))
    models = _ordered(parts, gap)
    begin = min(most, max([sum(abs(G.area(m.part.ring)) * m.part.demand for m in models) / height, *(m.diameter + 2 * gap for m in models)], default=1.0))
    strips: list[Layout] = []

    def widen(old: Layout, width: float) -> Layout:
        new = Layout(Sheet(old.sheet.id, box(width, height)), gap)
        new.placed = old.placed
        return new

    for model in models:
        for _ in range(model.part.demand):
            k, at = 0, None
            while at is None:
                if k == len(strips):
                    if k and not strips[-1].placed:
                        strips.pop()  # not even an empty strip of full width takes the part
                        break
                    strips.append(Layout(Sheet(k, box(begin, height)), gap))
                at = search(model, strips[k], draw, samples, local)
                if at is None:
                    width = float(strips[k].sheet.ring[:, 0].max())
                    if width * 1.0001 < most and not (math.isinf(most) and width > 64 * begin):
                        strips[k] = widen(strips[k], min(most, width * 1.1))
                    elif math.isinf(most):
                        break
                    else:
                        k += 1
            if at is None:
                break
            _put(strips[k], model, at)
    strips = [s for s in strips if s.placed]
    return [widen(s, max(float(p[4].high[0]) for p in s.placed) + gap / 2 + HAIR) for s in strips]


def motifs(ring: np.ndarray, gap: float, nestles: int = 16, kept: int = 2) -> list[list[tuple[float, np.ndarray]]]:
    """The part alone, and its best pairs with itself turned by half, in contact along one of so many directions: lists of (angle, offset)."""
    body = G.hull(G.offset(G.hull(ring), gap / 2)) if gap > 0 else G.hull(ring)
    other = -body
    n, c, d = difference(body, other)
    # contact along edges of the difference packs closest: their directions join the even ones
    angles = [2 * math.pi * k / nestles for k in range(nestles)] + [math.atan2(*p[::-1]) for p in (d + np.roll(d, -1, axis=0)) / 2] + [math.atan2(*p[::-1]) for p in d]
    rays = np.array([(math.cos(a), math.sin(a)) for a in angles])
    steps = rays * np.array([stretch[0][1] for stretch in _clips(n, c, np.zeros((1, 2)), rays)])[:, None]
    pairs = list(zip(hull_areas(body, other, steps).tolist(), steps, strict=True))
    pairs.sort(key=lambda p: p[0])
    return [[(0.0, np.zeros(2))], *([(0.0, np.zeros(2)), (math.pi, at)] for _, at in pairs[:kept])]


def lattice_sheet(ring: np.ndarray, gap: float, sheet: tuple[float, float], directions: int = 12, half_turns: bool = True) -> list[tuple[float, float, float]]:
    """(angle, x, y) of as many copies of a part as its best lattice of single parts or pairs brings on a sheet."""
    best: list[tuple[float, float, float]] = []
    room = (sheet[0] - gap, sheet[1] - gap)
    for motif in motifs(ring, gap)[: None if half_turns else 1]:
        whole = np.vstack([turned(ring, a) + o for a, o in motif])
        first, second, _ = lattice(whole, gap, directions)
        at = fill_lattice(whole, (first, second), room)
        got = [(a, float(x + o[0] + gap / 2), float(y + o[1] + gap / 2)) for x, y in at for a, o in motif]
        if len(got) > len(best):
            best = got
    return best

"""Rings made fit for search, in numpy: crossings cut out, corners thinned, narrow bays closed, piers drawn. No Spark here.

A ring is an (n, 2) array, counter-clockwise, its last vertex not repeated.
"""

from __future__ import annotations

import math

import numpy as np

from tessera.kernels.geometry import area, crossings, inside


def meetings(ring: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j), i < j, of edges that meet and aren't neighbours, in order."""
    n = len(ring)
    d = np.roll(ring, -1, axis=0) - ring
    det = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    gap = ring[None, :] - ring[:, None]
    safe = np.where(det == 0, 1.0, det)
    t = (gap[..., 0] * d[None, :, 1] - gap[..., 1] * d[None, :, 0]) / safe
    u = (gap[..., 0] * d[:, None, 1] - gap[..., 1] * d[:, None, 0]) / safe
    i, j = np.nonzero((det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
    ok = (j - i > 1) & (j - i < n - 1)
    return list(zip(i[ok].tolist(), j[ok].tolist(), strict=True))


def distinct(ring: np.ndarray) -> np.ndarray:
    """Without vertices that repeat the one before them."""
    return ring[(ring != np.roll(ring, 1, axis=0)).any(axis=1)]


def sanitize(ring: np.ndarray) -> np.ndarray:
    """Where two edges meet the ring falls into two chains, of which the larger stays; the input itself if no simple ring is left."""
    now = ring
    while pairs := meetings(now):
        i, j = pairs[0]
        loop, rest = now[i + 1 : j + 1], np.vstack([now[: i + 1], now[j + 1 :]])
        fewer = distinct(loop if abs(area(loop)) > abs(area(rest)) else rest)
        if not 3 <= len(fewer) < len(now):
            return ring
        now = fewer
    return now


def decimate(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker from the first vertex: no dropped vertex is farther than tolerance from its chord; rings of under three vertices are refused."""
    closed = np.vstack([ring, ring[:1]])
    keep, spans = {0, len(ring)}, [(0, len(ring))]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        chord = closed[b] - closed[a]
        off = closed[a + 1 : b] - closed[a]
        t = np.clip(off @ chord / max(float(chord @ chord), 1e-300), 0, 1)
        gaps = np.hypot(*(off - t[:, None] * chord).T)
        k = int(gaps.argmax())
        if gaps[k] > tolerance:
            keep.add(a + 1 + k)
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    kept = sorted(keep - {len(ring)})
    return ring[kept] if len(kept) > 2 else ring


def _free(ring: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each segment a-b meets no edge; a little is taken off both ends."""
    a, b = a + (b - a) * 5e-5, b - (b - a) * 5e-5
    p, d, e = ring, np.roll(ring, -1, axis=0) - ring, b - a
    det = e[:, :1] * d[:, 1] - e[:, 1:] * d[:, 0]
    gap = p - a[:, None]
    safe = np.where(det == 0, 1.0, det)
    t = (gap[..., 0] * d[:, 1] - gap[..., 1] * d[:, 0]) / safe
    u = (gap[..., 0] * e[:, 1:] - gap[..., 1] * e[:, :1]) / safe
    return ~((det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any(axis=1)


def close_bays(ring: np.ndarray, reach: float, share: float, grow: bool = True) -> np.ndarray:
    """Chains behind a mouth no longer than reach * diameter and of at most share * area give way to the mouth, those of most vertices first.

    A growing ring loses bays (the mouth is outside), a shrinking one capes (it is inside).
    """
    while (n := len(ring)) > 3:
        far = np.sqrt(((ring[:, None] - ring) ** 2).sum(2))
        i, step = np.nonzero((far[np.arange(n)[:, None], (np.arange(n)[:, None] + np.arange(n)) % n] <= reach * far.max()) & (np.arange(n) > 1) & (np.arange(n) < n - 1))
        j = (i + step) % n
        middle = (ring[i] + ring[j]) / 2
        ok = inside(middle, ring) != grow if len(i) else np.zeros(0, bool)
        ok[ok] = _free(ring, ring[i[ok]], ring[j[ok]])
        best = None
        for a, k in zip(i[ok].tolist(), step[ok].tolist(), strict=True):
            chain = ring[(a + np.arange(k + 1)) % n]
            turned = area(chain) if not grow else -area(chain)
            if 0 < turned <= share * abs(area(ring)) and (best is None or k > best[1]):
                best = a, k
        if best is None:
            return ring
        gone = (best[0] + 1 + np.arange(best[1] - 1)) % n
        fewer = np.delete(ring, gone, axis=0)
        if len(fewer) < 3 or crossings(fewer):
            return ring
        ring = fewer
    return ring


def chords(ring: np.ndarray, angles: int, rays: int, trim: float = 0.999) -> np.ndarray:
    """(m, 4): parts inside the ring of parallel lines in several directions, shortened a little."""
    centre = (ring.min(0) + ring.max(0)) / 2
    out = []
    for angle in np.arange(angles) * math.pi / angles:
        along, across = np.array([math.cos(angle), math.sin(angle)]), np.array([-math.sin(angle), math.cos(angle)])
        s, t = (ring - centre) @ along, (ring - centre) @ across
        s2, t2 = np.roll(s, -1), np.roll(t, -1)
        level = np.linspace(t.min(), t.max(), rays + 2)[1:-1, None]
        hit = (t < level) != (t2 < level)
        at = np.sort(np.where(hit, s + (level - t) / np.where(hit, t2 - t, 1.0) * (s2 - s), np.inf), axis=1)
        k, m = np.nonzero(np.isfinite(at[:, 1::2]))
        a, b, across = at[k, 2 * m, None], at[k, 2 * m + 1, None], across * level[k]
        cut = (b - a) * (1 - trim) / 2
        out.append(np.hstack([centre + along * (a + cut) + across, centre + along * (b - cut) + across]))
    return np.concatenate(out) if out else np.zeros((0, 4))


def _to_segments(points: np.ndarray, seg: np.ndarray) -> np.ndarray:
    a, d = seg[:, :2], seg[:, 2:] - seg[:, :2]
    t = np.clip(((points[:, None] - a) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.sqrt(((points[:, None] - a - t[..., None] * d) ** 2).sum(2))


def piers(ring: np.ndarray, n: int, poles: np.ndarray, angles: int = 12, rays: int = 12, points: int = 16, influence: float = 0.1) -> np.ndarray:
    """n segments inside the ring, each the one that leaves the least sum of squared distances from grid points outside the poles to the nearest pole or near pier."""
    lines = chords(ring, angles, rays)
    low, side = ring.min(0), float(np.ptp(ring, axis=0).max())
    grid = low + np.stack(np.meshgrid(*[np.linspace(0, side, points)] * 2), axis=-1).reshape(-1, 2)
    grid = grid[inside(grid, ring)]
    poles = np.asarray(poles, float).reshape(-1, 3)
    gap = np.full((len(grid), 1), side) if not len(poles) else np.sqrt(((grid[:, None] - poles[:, :2]) ** 2).sum(2)) - poles[:, 2]
    open_ = gap.min(1) > 0
    grid, left = grid[open_], gap.min(1)[open_]
    if not len(lines) or not n:
        return np.zeros((0, 4))
    near = _to_segments(grid, lines)
    near = np.where(near < influence * side, near, np.inf)
    out = []
    for _ in range(n):
        k = int((np.minimum(left[:, None], near) ** 2).sum(0).argmin())
        left = np.minimum(left, near[:, k])
        out.append(lines[k])
    return np.array(out)


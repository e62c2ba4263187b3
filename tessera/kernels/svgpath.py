"""SVG path data to rings: all commands, absolute and relative, curves and arcs as SEGMENTS chords."""

from __future__ import annotations

import math
import re

import numpy as np

SEGMENTS = 16
_TOKEN = re.compile(r"([MmLlHhVvCcSsQqTtAaZz])|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
_ARGS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}


def commands(path: str):
    """(letter, arguments) with repeats made explicit; flags of arcs may stand without separators."""
    at, n = 0, len(path)
    letter = None

    def number(flag: bool) -> float | None:
        nonlocal at
        while at < n and path[at] in " ,\t\r\n":
            at += 1
        if flag and at < n and path[at] in "01":
            at += 1
            return float(path[at - 1])
        m = _TOKEN.match(path, at)
        if not m or m[1]:
            return None
        at = m.end()
        return float(m[2])

    while at < n:
        if path[at] in " ,\t\r\n":
            at += 1
            continue
        if path[at].upper() in _ARGS:
            letter, at = path[at], at + 1
            if letter in "Zz":
                yield letter, []
                continue
        elif letter is None or letter in "Zz":
            at += 1
            continue
        args = []
        for k in range(_ARGS[letter.upper()]):
            v = number(letter in "Aa" and k in (3, 4))
            if v is None:
                break
            args.append(v)
        if len(args) < _ARGS[letter.upper()]:
            at += 1 if not args and at < n and path[at].upper() not in _ARGS else 0
            if at < n and path[at].upper() in _ARGS:
                continue
            if not args:
                continue
            return
        yield letter, args
        letter = {"M": "L", "m": "l"}.get(letter, letter)


def curve(points: list[complex]) -> list[complex]:
    k = len(points) - 1
    return [sum(math.comb(k, i) * (1 - t) ** (k - i) * t**i * p for i, p in enumerate(points)) for t in (j / SEGMENTS for j in range(1, SEGMENTS + 1))]


def arc(a: complex, b: complex, rx: float, ry: float, turn: float, large: bool, sweep: bool) -> list[complex]:
    """By the centre parametrisation of an elliptic arc."""
    if a == b:
        return []
    if rx == 0 or ry == 0:
        return [b]
    rx, ry, spin = abs(rx), abs(ry), complex(math.cos(math.radians(turn)), math.sin(math.radians(turn)))
    half = (a - b) / 2 / spin
    over = (half.real / rx) ** 2 + (half.imag / ry) ** 2
    if over > 1:
        rx, ry = rx * math.sqrt(over), ry * math.sqrt(over)
    u = complex(half.real / rx, half.imag / ry)
    side = math.sqrt(max(0.0, 1 / abs(u) ** 2 - 1)) * (-1 if large == sweep else 1)
    c = side * complex(u.imag, -u.real)
    first, last = u - c, -u - c
    begin = math.atan2(first.imag, first.real)
    sweep_angle = math.atan2(last.imag, last.real) - begin
    if sweep and sweep_angle < 0:
        sweep_angle += 2 * math.pi
    elif not sweep and sweep_angle > 0:
        sweep_angle -= 2 * math.pi
    middle = (a + b) / 2 + spin * complex(c.real * rx, c.imag * ry)
    return [middle + spin * complex(rx * math.cos(begin + sweep_angle * j / SEGMENTS), ry * math.sin(begin + sweep_angle * j / SEGMENTS)) for j in range(1, SEGMENTS)] + [b]


def rings(path: str) -> list[np.ndarray]:
    """Closed sub-paths of three vertices at least: the largest first, counter-clockwise, then its holes, clockwise."""
    out, row, at, begin, control, before = [], [], 0j, 0j, None, ""
    for letter, v in commands(path):
        kind, base = letter.upper(), at if letter.islower() else 0j
        p = [base + complex(x, y) for x, y in zip(v[0::2], v[1::2], strict=False)] if kind in "MLCSQT" else []
        if kind == "M":
            out.append(row)
            at = begin = p[0]
            row = [at]
        elif kind == "L":
            at = p[0]
            row.append(at)
        elif kind in "HV":
            at = complex(base.real + v[0], at.imag) if kind == "H" else complex(at.real, base.imag + v[0])
            row.append(at)
        elif kind in "CSQT":
            smooth = 2 * at - control if control is not None and before in ("CS" if kind in "CS" else "QT") else at
            pts = [at, *([smooth] if kind in "ST" else []), *p]
            row += curve(pts)
            at, control = pts[-1], pts[-2]
        elif kind == "A":
            end = base + complex(v[5], v[6])
            row += arc(at, end, v[0], v[1], v[2], bool(v[3]), bool(v[4]))
            at = end
        elif kind == "Z":
            out.append(row)
            at, row = begin, [begin]
        before = kind
    out.append(row)
    done = []
    for r in out:
        pts = np.array([(z.real, z.imag) for k, z in enumerate(r) if k == 0 or abs(z - r[k - 1]) > 1e-9]).reshape(-1, 2)
        if len(pts) > 1 and np.abs(pts[0] - pts[-1]).max() <= 1e-9:
            pts = pts[:-1]
        if len(pts) >= 3:
            x, y = pts[:, 0], pts[:, 1]
            done.append((float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2, pts))
    done.sort(key=lambda d: -abs(d[0]))
    return [p if (a > 0) == (k == 0) else p[::-1] for k, (a, p) in enumerate(done)]

"""SVG text in and out, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segments of a linearised curve, and of a circle.
CURVE, CIRCLE = 16, 32
COMMAND = "[MmLlHhVvCcSsQqTtAaZz]"
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def tokens(path: Column) -> Column:
    """Command letters, and what stands between them and white space."""
    return F.regexp_extract_all(path, F.lit(rf"{COMMAND}|[^MmLlHhVvCcSsQqTtAaZz\s]+"), F.lit(0))


def path_of(svg: Column) -> Column:
    """The first path's data, or null."""
    got = F.regexp_extract(svg, r'<path\b[^>]*?\bd="([^"]*)"', 1)
    return F.when(got != "", got)


def circles_of(svg: Column) -> Column:
    """array<struct<cx, cy, r>> of the circles, the largest first."""
    tags = F.regexp_extract_all(svg, F.lit(r"<circle\b[^>]*>"), F.lit(0))

    def attribute(tag: Column, name: str) -> Column:
        got = F.regexp_extract(tag, rf'\b{name}="({NUMBER})', 1)
        return F.when(got != "", got.cast("double")).otherwise(F.lit(0.0))

    rows = F.transform(tags, lambda t: F.struct((-attribute(t, "r")).alias("k"), attribute(t, "cx").alias("cx"), attribute(t, "cy").alias("cy"), attribute(t, "r").alias("r")))
    return F.transform(F.array_sort(rows), lambda c: F.struct(c["cx"], c["cy"], c["r"]))


def number(v: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", v)


def path(ring: Column, digits: int = 4) -> Column:
    points = F.transform(ring, lambda p: F.concat_ws(" ", number(p["x"], digits), number(p["y"], digits)))
    return F.concat(F.lit("M "), F.array_join(points, " L "), F.lit(" Z"))


def ring(path_data: Column) -> Column:
    """Of a path of absolute M, L and Z alone."""
    numbers = F.transform(F.regexp_extract_all(path_data, F.lit(NUMBER), F.lit(0)), lambda t: t.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / 2).cast("int") - 1), lambda i: F.struct(F.get(numbers, (i * 2).cast("int")).alias("x"), F.get(numbers, (i * 2 + 1).cast("int")).alias("y")))


def bezier(points: list[tuple[Column, Column]], n: int = CURVE) -> Column:
    """n points after the first of a quadratic or cubic curve, by its control points."""
    k = len(points) - 1
    weights = [math.comb(k, i) for i in range(k + 1)]

    def at(axis: int, t: Column) -> Column:
        terms = [F.lit(float(w)) * F.pow(1 - t, F.lit(float(k - i))) * F.pow(t, F.lit(float(i))) * points[i][axis] for i, w in enumerate(weights)]
        out = terms[0]
        for x in terms[1:]:
            out = out + x
        return out

    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(at(0, i / n).alias("x"), at(1, i / n).alias("y")))


def circle_path(cx: Column, cy: Column, r: Column, n: int = CIRCLE) -> Column:
    turn = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((cx + r * F.cos(i * (2 * math.pi / n))).alias("x"), (cy + r * F.sin(i * (2 * math.pi / n))).alias("y")))
    return path(turn)


def document(width: Column, height: Column, bodies: Column) -> Column:
    """One document around an array of bodies."""
    head = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), number(width, 2), F.lit(" "), number(height, 2), F.lit('">'))
    return F.concat_ws("\n", head, F.array_join(bodies, "\n"), F.lit("</svg>"))


def rect_body(x: Column, y: Column, w: Column, h: Column, fill: str) -> Column:
    return F.concat(*[F.concat(F.lit(f'{"<rect" if k == "x" else ""} {k}="'), number(v, 2), F.lit('"')) for k, v in (("x", x), ("y", y), ("width", w), ("height", h))], F.lit(f' fill="{fill}"/>'))


def _box_path(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.concat(F.lit("M"), number(x, 2), F.lit(","), number(y, 2), F.lit(" h"), number(w, 2), F.lit(" v"), number(h, 2), F.lit(" h"), number(-w, 2), F.lit(" z"))


def kerf_band(x: Column, y: Column, w: Column, h: Column, kerf: float) -> Column:
    """Path, by the even-odd rule, of the rim that a cut takes from a rectangle: all of it if nothing is left inside; null without a kerf."""
    left = (w > 2 * kerf) & (h > 2 * kerf)
    rim = F.concat(_box_path(x, y, w, h), F.when(left, F.concat(F.lit(" "), _box_path(x + kerf, y + kerf, w - 2 * kerf, h - 2 * kerf))).otherwise(F.lit("")))
    return F.when(F.lit(kerf > 0), rim)


def inner(document: Column) -> Column:
    """What stands between a document's svg tags."""
    return F.regexp_extract(document, r"(?s)<svg[^>]*>\s*(.*?)\s*</svg>", 1)


def overlay(document: Column, bodies: Column) -> Column:
    """The document with an array of bodies drawn last; itself if there are none."""
    return F.when(F.size(bodies) > 0, F.concat(F.regexp_replace(document, r"(?s)\s*</svg>\s*$", "\n"), F.array_join(bodies, "\n"), F.lit("\n</svg>"))).otherwise(document)


def combined(documents: Column, width: Column, height: Column, gap: float) -> Column:
    """One document of several of one size, one below the other."""
    moved = F.transform(documents, lambda d, i: F.concat(F.lit('<g transform="translate(0 '), number(i * (height + gap), 2), F.lit(')">'), inner(d), F.lit("</g>")))
    return document(width, height * F.size(documents) + F.greatest(F.size(documents) - 1, F.lit(0)) * gap, moved)


def blend(a: Column, b: Column, part: float) -> Column:
    """Between two colours #rrggbb."""
    def channel(c: Column, at: int) -> Column:
        return F.conv(F.substring(c, at, 2), 16, 10).cast("double")

    mixed = [F.lpad(F.lower(F.hex(F.round(channel(a, k) * (1 - part) + channel(b, k) * part).cast("long"))), 2, "0") for k in (2, 4, 6)]
    return F.concat(F.lit("#"), *mixed)

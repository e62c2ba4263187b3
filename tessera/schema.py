"""Column types of the nested geometry model and of the instance files."""

from __future__ import annotations

POINT = "struct<x: double, y: double>"
RING = f"array<{POINT}>"
RECT = "struct<x_min: double, y_min: double, x_max: double, y_max: double>"
CIRCLE = "struct<cx: double, cy: double, r: double>"
EDGE = "struct<x1: double, y1: double, x2: double, y2: double>"
AFFINE = "struct<a: double, b: double, tx: double, c: double, d: double, ty: double>"
#: A file's shape is a union: `data` stays text and is read by `type`.
SHAPE = "struct<type: string, data: string>"
ITEM = f"struct<id: long, demand: long, allowed_orientations: array<double>, min_quality: int, shape: {SHAPE}>"
ZONE = f"struct<quality: int, shape: {SHAPE}>"
BIN = f"struct<id: long, shape: {SHAPE}, zones: array<{ZONE}>, stock: long, cost: long>"
STRIP_INSTANCE = f"name string, strip_height double, items array<{ITEM}>"
BIN_INSTANCE = f"name string, items array<{ITEM}>, bins array<{BIN}>"
MULTI_STRIP_INSTANCE = f"name string, items array<{ITEM}>, strips struct<height: double, max_width: double>"
PLACED = "struct<item_id: long, transformation: struct<rotation: double, translation: array<double>>>"
LAYOUT = f"struct<container_id: long, placed_items: array<{PLACED}>, density: double>"

"""The queries of the geometry and placement operators."""

from __future__ import annotations

from importlib import import_module

from tessera.ship import ship

MODULES = ("shapes", "collisions", "totals", "packs", "texts", "searches", "hazards", "nesting")


def _all() -> dict:
    out = {}
    for m in MODULES:
        out |= import_module(f"tessera.plans.{m}").QUERIES
    return out


def queries() -> dict:
    """name: a function of (spark, sf_dir)."""
    return {k: (lambda s, d, f=f: f(ship(s), d)) for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}

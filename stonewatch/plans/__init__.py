"""Composite plans and the queries registered over the star-schema tables."""

from importlib import import_module

from stonewatch.plans.registry import ORACLES, QUERIES

_MODULES = ("sensor_queries", "risk_queries", "work_queries", "floor_queries", "quality_queries")


def _load() -> None:
    for name in _MODULES:
        import_module(f"stonewatch.plans.{name}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_oracles():
    _load()
    return dict(ORACLES)

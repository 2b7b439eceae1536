"""All queries over the signal tables, each with its SQL for DuckDB."""

from __future__ import annotations

from importlib import import_module

from .fixture import Tables, oracle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODULES = ("scalars", "aggregates", "heat", "themes", "pairs", "finding", "happenings", "upkeep", "landing", "streams", "reference", "pieces", "further")


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query; ``sql`` is its oracle over the views."""

    def add(f):
        def run(spark, sf_dir):
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"signalweave.plans.{m}")


def queries() -> dict:
    _load()
    return QUERIES


def oracles() -> dict[str, str]:
    _load()
    return ORACLES

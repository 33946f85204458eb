"""The registered queries of the engine and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .fixtures import CTES

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("detection", "fusion", "statistics", "temporal", "catalog", "spatial", "quality", "forecast", "streams", "composites", "selection", "validation", "grids")


def query(sql: str | None = None, views: str = ""):
    """Registers a function of (spark, sf_dir) under its name, with SQL over the named views and those they stand on."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            names: list[str] = []

            def need(v: str) -> None:
                for w in CTES[v][0]:
                    need(w)
                if v not in names:
                    names.append(v)

            for v in views.split():
                need(v)
            body = sql.strip()
            head = ",\n".join(f"{v} as ({CTES[v][1]})" for v in names)
            if head:
                body = f"with recursive {head},\n{body[len('with recursive '):] if body.startswith('with recursive ') else body[5:]}" if body.startswith("with ") else f"with {head}\n{body}"
            _SQL[f.__name__] = body
        return f

    return keep


def _load() -> None:
    for m in _MODULES:
        import_module(f"tellurion.plans.{m}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["sar_flood_change"](spark, sf_dir)

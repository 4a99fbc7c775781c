"""The registered queries: plans over the fixture's tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Fixture, duck

Plan = Callable[[Fixture], DataFrame]
_PLANS: dict[str, Plan] = {}
_SQL: dict[str, str] = {}
_DOUBLES: dict[str, list[str]] = {}


def plan(sql: str | None = None, *views: str, doubles: str = "") -> Callable[[Plan], Plan]:
    """Registers a plan as query q_<name>, with its DuckDB SQL over the named views.  Both sides round the named columns of
    doubles to six digits, as sums may be taken in any order."""

    def add(f: Plan) -> Plan:
        name = f"q_{f.__name__}"
        _PLANS[name], _DOUBLES[name] = f, doubles.split()
        if sql:
            _SQL[name] = duck(sql, *views)
        return f

    return add


def with_views(text: str, select: str) -> str:
    """A select with further views before it."""
    return f"SELECT * FROM (WITH RECURSIVE {text} {select})"


def _load() -> None:
    from . import chains, details, lineage, reads, resampling, states, summaries, topology  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(name: str, p: Plan) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return p(Fixture(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in _DOUBLES[name]})

        return run

    return {name: bind(name, p) for name, p in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    _load()

    def rounded(name: str, sql: str) -> str:
        columns = _DOUBLES[name]
        return f"SELECT * REPLACE ({', '.join(f'ROUND({c}, 6) AS {c}' for c in columns)}) FROM ({sql}) q" if columns else sql

    return {name: rounded(name, sql) for name, sql in _SQL.items()}

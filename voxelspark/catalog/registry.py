"""Named queries: a Spark callable, optionally with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "i":
        c = c.cast("long")
    elif kind == "s":
        c = c.cast("string")
    elif kind == "b":
        c = c.cast("boolean")
    elif kind.startswith("d"):
        c = c.cast("double")
        c = F.round(F.when(~F.isnan(c), c), int(kind[1:])) + F.lit(0.0)
    return c.alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "s":
        return f"CAST({name} AS VARCHAR) AS {name}"
    if kind == "b":
        return f"CAST({name} AS BOOLEAN) AS {name}"
    if kind.startswith("d"):
        d = f"CAST({name} AS DOUBLE)"
        return f"ROUND(CASE WHEN NOT isnan({d}) THEN {d} END, {kind[1:]}) + 0.0::DOUBLE AS {name}"
    return name


def query(name: str, columns: str, sql: str | None = None) -> Callable:
    """Register ``name``.

    ``columns`` fixes the output of both sides: ``name`` as it is, ``name:i`` integer,
    ``name:s`` text, ``name:b`` boolean, ``name:d6`` a double rounded to six digits with
    NULL for NaN.
    """
    fields = [(c.split(":") + [""])[:2] for c in columns.split()]

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_column(n, k) for n, k in fields])

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"SELECT {', '.join(_sql_column(n, k) for n, k in fields)} FROM (\n{sql}\n)"
        return fn

    return add

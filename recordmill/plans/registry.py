"""Queries register here with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordmill.session import read_table

FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of tables (its parameters are table names) under its own name."""

    def keep(f: Callable) -> Callable:
        tables = f.__code__.co_varnames[: f.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(read_table(spark, sf_dir, t) for t in tables))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        if f.__name__ in FOUND:
            raise ValueError(f"{f.__name__} is registered twice")
        FOUND[f.__name__] = (run, sql)
        return f

    return keep

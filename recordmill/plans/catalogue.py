"""The query catalogue: each name with its Spark query and its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordmill.plans.registry import FOUND

MODULES = ("state_queries", "record_joins", "profiles", "metrics", "rankings", "similarity", "splits", "checks", "building", "repairs", "records")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"recordmill.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in FOUND.items() if s}

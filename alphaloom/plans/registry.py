"""Registry of the engine's named queries: each operator as a Spark DataFrame and, where SQL can say it, as DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Modules of alphaloom.operators with OPS: relations by name, with a Spark form and, where there is one, a SQL text.
MODULES = ("points", "neighbours", "joins", "aggregates", "ranking", "temporal", "reports", "framed", "gates", "stages", "further")


@lru_cache(maxsize=1)
def _relations() -> dict:
    out: dict = {}
    for name in MODULES:
        ops = importlib.import_module(f"alphaloom.operators.{name}").OPS
        if twice := out.keys() & ops.keys():
            raise ValueError(f"queries defined twice: {sorted(twice)}")
        out |= ops
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: r.frame for k, r in _relations().items()}


def oracle_sql() -> dict[str, str]:
    return {k: text for k, r in _relations().items() if (text := r.sql())}

"""All named queries of the core, with their SQL where it can be given."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that each hold QUERIES and SQL.
MODULES: tuple[str, ...] = ("q_text", "q_pairs", "q_eval", "q_robust", "q_train", "q_more", "q_custom", "q_chain", "q_runs")


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in importlib.import_module(f"tracemill.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in importlib.import_module(f"tracemill.plans.{m}").SQL.items()}

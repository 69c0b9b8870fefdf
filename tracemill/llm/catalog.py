"""All named queries of this subpackage, with their SQL where it can be given."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("p1_cut", "p2_answers", "p3_splits", "p4_near", "p5_consensus", "p6_cap", "p7_tokens", "p8_leakage", "p9_visual")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in importlib.import_module(f"tracemill.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in importlib.import_module(f"tracemill.llm.{m}").SQL.items()}

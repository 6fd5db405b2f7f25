"""All registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("retrieval", "textual", "graphs", "records", "evidence", "outlines", "graph_edits", "unit_queries", "catalogue")


def _all() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for name in MODULES:
        out |= import_module(f".{name}", __package__).QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["bm25_evidence"](spark, sf_dir)

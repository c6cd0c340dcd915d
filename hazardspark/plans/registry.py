"""Every query of the library by name, with its DuckDB counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazardspark.plans import queries_climate, queries_events, queries_files, queries_model, queries_selection

FLAGSHIP = "w1_w6_history_features"
_PARTS = (queries_events, queries_climate, queries_files, queries_model, queries_selection)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in _PARTS for name, (query, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}

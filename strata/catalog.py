"""All queries of the engine's own operators and the SQL that states each result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import call_queries, reference_queries, retrieval_queries, structure_queries, text_queries

GROUPS = (text_queries, structure_queries, reference_queries, retrieval_queries, call_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_queries.tree_stats(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for g in GROUPS for name, f in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for g in GROUPS for name, q in g.ORACLES.items()}

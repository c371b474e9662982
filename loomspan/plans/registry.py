"""Named queries of the engine and the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspan.plans import alignment_queries, cohort_queries, graph_queries, induction_queries, walk_queries

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = (alignment_queries, graph_queries, cohort_queries, walk_queries, induction_queries)


def queries() -> dict[str, Query]:
    return {name: q for g in GROUPS for name, q in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for g in GROUPS for name, text in g.SQL.items()}

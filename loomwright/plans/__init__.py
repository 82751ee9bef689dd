"""The queries on the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.plans import choice_queries, corpus, dialogue_queries, evaluation_queries, source_queries, token_queries, vector_queries

MODULES = (corpus, token_queries, evaluation_queries, dialogue_queries, choice_queries, vector_queries, source_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in MODULES for k, s in m.ORACLES.items()}

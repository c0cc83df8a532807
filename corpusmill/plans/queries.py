"""All registered queries of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators import conversations as V
from corpusmill.plans import adapters as A
from corpusmill.plans import conversation_queries, job_queries, state_queries, structure_queries, text_queries  # noqa: F401  (they register their queries)
from corpusmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations assembled, deduplicated and measured."""
    return V.statistics(V.deduplicate(A.duplicated(spark, sf_dir)))

"""Named queries (Spark builder + DuckDB oracle SQL) over the test data set."""

from ledger_spark.plans import (  # noqa: F401  (each module registers its queries)
    eval_queries, header_queries, ingest_queries, ledger_queries, research_queries,
    linear_queries, workflow_queries,
)
from ledger_spark.plans import folder_queries, model_queries  # noqa: F401,E402  (rows-only model queries)
from ledger_spark.plans.registry import REGISTRY

__all__ = ["REGISTRY"]

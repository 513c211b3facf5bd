"""Ledger Spark: ledger reconciliation, point-in-time features, evaluation and
follow-up workflow as Spark DataFrame jobs."""

__version__ = "0.1.0"

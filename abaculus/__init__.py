"""Ledger analytics and data preparation as declarative Spark jobs."""

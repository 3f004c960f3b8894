"""Ledger analytics and data processing as Spark DataFrame jobs."""

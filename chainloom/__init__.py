"""Chainloom: block-ledger analytics as PySpark DataFrame jobs."""

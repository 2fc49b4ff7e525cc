"""Audit analytics for large invoice ledgers, written as PySpark DataFrame jobs."""

"""Execution-evidence analytics on Spark."""

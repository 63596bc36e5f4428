"""Audit-log provenance analytics on Spark DataFrames."""

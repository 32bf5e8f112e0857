"""Larkspan: record linkage, conflation and corpus preparation as Spark jobs."""

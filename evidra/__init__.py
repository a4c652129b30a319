"""Evidra: evidence synthesis and corpus preparation as Spark jobs."""

"""Exact ranked retrieval over changing, sharded collections, as Spark jobs."""

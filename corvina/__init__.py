"""Corvina: retrieval and knowledge-graph analytics as plain Spark jobs."""

"""Corvine: code-graph, vector and text analytics as Spark jobs."""

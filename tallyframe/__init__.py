"""Evaluation analytics as Spark jobs."""

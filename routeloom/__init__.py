"""Spark-first engine that discovers and documents HTTP APIs from traffic and source code."""

"""Spark-first engine for typed data-parallel steps and the analytics over their execution state."""

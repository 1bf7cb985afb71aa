"""Spark jobs that audit recorded agent sessions, and training-data operators."""

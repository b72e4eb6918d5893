"""Interval, sparse-matrix and training-corpus analytics written as Spark jobs."""

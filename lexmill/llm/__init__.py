"""Operators of a training-data pipeline.

Every operator takes and returns DataFrames, keeps no state on one machine, and
reads the shared folder for materialised steps from ``spark.checkpoint.dir``.
"""

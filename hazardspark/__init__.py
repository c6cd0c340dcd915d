"""Batch jobs for area-level hazard risk, written as PySpark DataFrame programs."""

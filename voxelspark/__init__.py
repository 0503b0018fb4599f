"""Voxel and time-series analytics as PySpark DataFrame operators.

Every operator takes DataFrames and a ``keys`` list (normally ``["patient"]``),
so one call covers a whole cohort.
"""

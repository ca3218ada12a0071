"""Operators: DataFrames in, one DataFrame out, all entities and all dates in one job."""

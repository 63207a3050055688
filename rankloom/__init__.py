"""Retrieval-evaluation analytics as Spark jobs.

Every operator takes DataFrames and returns a DataFrame; every helper in
``functions`` takes Columns and returns a Column.
"""

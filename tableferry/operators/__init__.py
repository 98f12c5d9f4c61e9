"""Table operators: DataFrames in, DataFrames out.

They are lazy, except that ``ordering`` and what builds on it writes a sorted table first.
"""

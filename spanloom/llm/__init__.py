"""Operators for building training corpora: filtering, deduplication, mixing and formatting.

Nothing else in the library imports this subpackage. Each operator is a function from
DataFrames to a DataFrame; ``queries`` applies each of them to its whole test table.
"""

"""Operators for training-data pipelines over text tables.

Nothing outside this package imports it. Every operator reads DataFrames and
returns DataFrames; ``queries`` registers one query for each.
"""

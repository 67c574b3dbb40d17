"""Operators of a training-data pipeline: deduplication, scoring, tokens, packing, search, chat text.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` applies each one to its whole table.
"""

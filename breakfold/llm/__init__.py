"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
column names, selects the columns it needs under private names (so extra columns
with clashing names do no harm) and documents what nulls, empty texts, ties,
repeated rows and empty tables give.
"""

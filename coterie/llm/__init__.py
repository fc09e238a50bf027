"""Operators for large-scale training-data pipelines (text, pages, media).

Nothing else in the library imports this subpackage.  Every operator works on
DataFrames; the thin ``opN_*`` queries that digest their results are in
``coterie.llm.registry``.
"""

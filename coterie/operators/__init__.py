"""Relational graph operators: accessors, objectives, metrics, Pareto sets, variation, codecs, reports."""

"""Incremental graph maintenance for streams of edges (see ``edges``)."""

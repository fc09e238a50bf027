"""Detectors, and the derived graphs and queries of the registry."""

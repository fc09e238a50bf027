"""Scalar functions: hash randomness, log-gamma, rate rules."""

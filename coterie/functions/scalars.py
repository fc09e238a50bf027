"""Closed forms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0, by Stirling's series after a shift of eight."""
    z = x + 8
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7)) + 1 / (1188 * F.pow(z, 9))
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def ln_factorial(n: Column) -> Column:
    return ln_gamma(n.cast("double") + 1)


def centre_ceiling(n: int, cap: float = 1.0) -> int:
    """Most centres of a macro individual: the cap times the root of n, within 1 and n."""
    cap = 1.0 if math.isnan(cap) else min(max(cap, 1e-6), 1e6)
    return max(1, min(n, math.ceil(cap * math.sqrt(n))))


def node_rate(rate: float, n: int) -> float:
    """Mutation rate of a node: one node on average if not positive."""
    return 1.0 / max(n, 1) if rate <= 0 else min(rate, 1.0)


def objective_sets(mode: int) -> tuple[str, str]:
    """Micro and macro objective sets of a numeric mode.

    Below 100 it names the set of both sides; from 100, less 100, its last digit
    is the macro set and the rest the micro set; from 1000, less 1000, its last
    two digits.  Set 6 is intra and inter, any other KKM and RC.
    """
    name = lambda d: "intra_inter" if d == 6 else "kkm_rc"
    if mode < 100:
        return name(mode), name(mode)
    rest, base = (mode - 100, 10) if mode < 1000 else (mode - 1000, 100)
    return name(rest // base), name(rest % base)


def topology_operators(mode: int) -> tuple[bool, bool]:
    """Whether a topology mask has majority mutation and ensemble crossover; other bits do nothing."""
    return bool(mode & 2), bool(mode & 128)

"""Benchmark-layer operators: task grids, resuming, pivots, ranks, paired tests."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def task_grid(spark: SparkSession, axes: dict[str, list], caps: dict[str, int] | None = None, size: str = "n", algorithm: str = "alg") -> DataFrame:
    """All combinations of the axes, without algorithms beyond their size cap."""
    frames = [spark.createDataFrame([(v,) for v in values], [name]).coalesce(1) for name, values in axes.items()]
    grid = reduce(DataFrame.crossJoin, frames)  # the axes are short lists
    for name, cap in (caps or {}).items():
        grid = grid.where(~((F.col(algorithm) == name) & (F.col(size) > cap)))
    return grid


def resume(tasks: DataFrame, done: DataFrame, key: list[str], digits: int = 6) -> DataFrame:
    """Tasks that are not done; keys are compared as text, numbers with fractions after rounding."""

    def normal(df: DataFrame) -> list[Column]:
        kinds = dict(df.dtypes)
        return [F.coalesce(F.round(F.col(c), digits).cast("string") if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit("")).alias(f"__{c}") for c in key]

    keyed = tasks.select("*", *normal(tasks))
    return keyed.join(done.select(*normal(done)).distinct(), [f"__{c}" for c in key], "left_anti").select(tasks.columns)


def prune_timeouts(tasks: DataFrame, done: DataFrame, family: str = "family", size: str = "n", status: str = "status") -> DataFrame:
    """``tasks`` with ``skipped``: whether a smaller task of the same family has run out of time.

    ``done`` holds the finished runs' family, size and status; only ``timeout`` counts.  A task of the
    size that timed out is tried again with other seeds, larger ones are skipped.
    """
    least = done.where(F.col(status) == "timeout").groupBy(family).agg(F.min(size).alias("__least"))
    return tasks.join(least, family, "left").select(*[F.col(f"`{c}`") for c in tasks.columns], F.coalesce(F.col(size) > F.col("__least"), F.lit(False)).alias("skipped"))


def pivot(rows: DataFrame, cell: list[str], algorithm: str, value: str, algorithms: list[str], status: Column | None = None) -> DataFrame:
    """Mean and standard deviation by cell and algorithm, a pair of columns for each algorithm."""
    good = rows if status is None else rows.where(status)
    return good.groupBy(*cell).pivot(algorithm, algorithms).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``mean, std`` of each group; a single row has deviation 0."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def average_rank(rows: DataFrame, cell: list[str], algorithm: str, value: str) -> DataFrame:
    """Mean over cells of each algorithm's rank by descending value; ties share the mean of their places."""
    order = Window.partitionBy(*cell).orderBy(F.desc(value))
    ties = Window.partitionBy(*cell, value)
    ranked = rows.select(*cell, algorithm, value, (F.rank().over(order) + (F.count("*").over(ties) - 1) / 2).alias("r"))
    return ranked.groupBy(algorithm).agg(F.avg("r").alias("average_rank"))


def ordered(rows: DataFrame, column: str, order: list[str], then: list[str]) -> DataFrame:
    """Sorted by a custom order of one column's values (others last), then by further columns."""
    place = reduce(lambda c, i: c.when(F.col(column) == order[i], i), range(1, len(order)), F.when(F.col(column) == order[0], 0)).otherwise(len(order))
    return rows.orderBy(place, *then)


def signed_rank_p(x: np.ndarray) -> float:
    """Two-sided p of Wilcoxon's signed-rank test; exact for up to 50 untied differences, else normal with tie correction."""
    x = x[x != 0]
    n = len(x)
    if not n:
        return 1.0
    sizes, back, counts = np.unique(np.abs(x), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[back]
    plus = ranks[x > 0].sum()
    least = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and len(sizes) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return min(1.0, 2 * ways[: int(least) + 1].sum() / 2.0**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    return math.erfc(abs(plus - mean) / math.sqrt(2 * var)) if var > 0 else 1.0


def paired_test(rows: DataFrame, cell: list[str], algorithm: str, seed: str, value: str, ours: str, least: int = 5) -> DataFrame:
    """Wilcoxon tests of ``ours`` against each other algorithm over shared seeds, Bonferroni-corrected within a cell.

    ``cell, other, n, difference, p``; cells with fewer than ``least`` pairs are left out.
    """
    own = rows.where(F.col(algorithm) == ours).select(*cell, seed, F.col(value).alias("own"))
    other = rows.where(F.col(algorithm) != ours).select(*cell, seed, F.col(algorithm).alias("other"), F.col(value).alias("theirs"))
    pairs = own.join(other, [*cell, seed])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in cell)

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for name, group in frame.groupby("other"):
            gap = (group["own"] - group["theirs"]).dropna().to_numpy()
            if len(gap) >= least:
                found.append((name, len(gap), gap.mean(), signed_rank_p(gap)))
        return pd.DataFrame([[*frame[cell].iloc[0], o, n, d, min(1.0, p * len(found))] for o, n, d, p in found], columns=[*cell, "other", "n", "difference", "p"])

    # a cell holds a benchmark's runs: algorithms x seeds
    return pairs.groupBy(*cell).applyInPandas(test, f"{kinds}, other string, n long, difference double, p double")


def evaluate(partition: DataFrame, graph, truth: DataFrame) -> DataFrame:
    """One row ``q, nmi, ami`` of a partition."""
    from coterie.operators.metrics import gt_metrics
    from coterie.operators.objectives import modularity

    return modularity(partition, graph).select("q").crossJoin(gt_metrics(partition, truth).select("nmi", "ami"))


def front_scatter(front: DataFrame, graph) -> DataFrame:
    """``ind, intra, inter, q, k`` of each partition of a front ``(ind, node, label)``."""
    from coterie.operators.objectives import objectives

    return objectives(front, graph).select("ind", "intra", "inter", "q", "k")

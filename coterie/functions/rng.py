"""Counter-based randomness: a hash of what is drawn, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(seed: int, *of: Column) -> Column:
    """A number in [0, 1) for each combination of ``of``."""
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), *of), F.lit(1 << 53)) / F.lit(float(1 << 53))


def pick(seed: int, choices: Column, *of: Column) -> Column:
    """One element of a non-empty array."""
    return F.element_at(choices, (F.floor(uniform(seed, *of) * F.size(choices)) + 1).cast("int"))


def check_probability(p: float, name: str = "rate") -> float:
    if not 0 <= p <= 1:
        raise ValueError(f"{name} must be within [0, 1], not {p}")
    return float(p)


def lowest(rows: DataFrame, by: list[str], draw: Column, wanted: Column, order: list[str], buckets: int) -> DataFrame:
    """Of each group ``by`` the ``wanted`` rows of least ``draw`` (in [0, 1)), ties by ``order``.

    Draws are cut into ``buckets``; only the bucket in which the last wanted row falls is sorted,
    so no window holds a whole group.
    """
    cut = rows.withColumn("__draw", draw).withColumn("__wanted", wanted).withColumn("__bucket", F.floor(F.col("__draw") * buckets).cast("int"))
    sizes = cut.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    # a row for each group and bucket
    before = sizes.select(*by, "__bucket", "__n", (F.sum("__n").over(Window.partitionBy(*by).orderBy("__bucket")) - F.col("__n")).alias("__before"))
    placed = cut.join(before, [*by, "__bucket"]).where(F.col("__before") < F.col("__wanted"))
    whole = placed.where(F.col("__before") + F.col("__n") <= F.col("__wanted"))
    rank = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__draw", *order))
    part = placed.where(F.col("__before") + F.col("__n") > F.col("__wanted")).withColumn("__rank", rank).where(F.col("__before") + F.col("__rank") <= F.col("__wanted"))
    return whole.select(rows.columns).union(part.select(rows.columns))

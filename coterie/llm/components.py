"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm.common import drop_path, scratch_path


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` (the smallest node of its component) for every node of ``edges(a, b)``.

    Each round hooks every node's larger neighbours, then its smaller ones, to
    the smallest node around it.  Edges live in scratch tables; a hot node costs
    a join on its key, never a list of its neighbours.  Ends when a round
    changes nothing.
    """
    spark = edges.sparkSession
    schema = "a long, b long"

    def keep(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path), path

    def directed(df: DataFrame) -> DataFrame:
        return df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def sums(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, path = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = sums(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = directed(now)
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, large_path = keep(large)
        # every edge now points from the larger to the smaller node
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        after, after_path = keep(small)
        drop_path(spark, path)
        drop_path(spark, large_path)
        now, path, before = after, after_path, state
        state = sums(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

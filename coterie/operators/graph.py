"""Graph accessors, and partitions in canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.sources.graphs import Graph, dense_ids, numbered


def neighbours(graph: Graph, nodes: DataFrame) -> DataFrame:
    """``node, neighbour`` of the given nodes."""
    return nodes.join(graph.adj, nodes.node == graph.adj.u).select("node", F.col("v").alias("neighbour"))


def degrees(graph: Graph, nodes: DataFrame) -> DataFrame:
    """``node, deg`` of the given nodes, 0 for unknown ones."""
    return nodes.join(graph.deg, "node", "left").select("node", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def stats(graph: Graph) -> DataFrame:
    """One row: nodes, edges, isolated nodes, largest, total and average degree, and the node of largest degree (lowest id)."""
    top = F.max_by("node", F.struct("deg", -F.col("node")))
    return graph.deg.agg(
        F.count("*").alias("n"),
        (F.coalesce(F.sum("deg"), F.lit(0)) / 2).cast("long").alias("m"),
        F.count_if(F.col("deg") == 0).alias("isolated"),
        F.coalesce(F.max("deg"), F.lit(0)).alias("max_degree"),
        F.coalesce(F.sum("deg"), F.lit(0)).alias("total_degree"),
        F.coalesce(F.avg("deg"), F.lit(0.0)).alias("avg_degree"),
        top.alias("max_degree_node"),
    )


def isolated(graph: Graph) -> DataFrame:
    """``node, isolated`` of every node."""
    return graph.deg.select("node", (F.col("deg") == 0).alias("isolated"))


def by_degree(graph: Graph) -> DataFrame:
    """Nodes by descending degree, then id."""
    return graph.deg.orderBy(F.desc("deg"), "node")


def mixing(graph: Graph, truth: DataFrame) -> DataFrame:
    """One row ``mu``: the share of edges, with both ends labelled, that cross communities."""
    a, b = (truth.select(F.col("node").alias(end), F.col("community").alias(c)) for end, c in (("src", "ca"), ("dst", "cb")))
    return graph.edges.join(a, "src").join(b, "dst").agg(F.avg((F.col("ca") != F.col("cb")).cast("int")).alias("mu"))


def normalize(partition: DataFrame, graph: Graph) -> DataFrame:
    """Communities numbered from 0 by their smallest connected node; isolated nodes get -1."""
    labelled = partition.join(graph.deg, "node").select("node", "community", "deg")
    least = labelled.where("deg > 0").groupBy("community").agg(F.min("node").alias("least"))
    places = dense_ids(least.select(F.col("least").alias("node"))).select(F.col("node").alias("least"), F.col("idx"))
    ids = least.join(places, "least").select("community", "idx")
    return labelled.join(ids, "community", "left").select("node", F.when(F.col("deg") == 0, -1).otherwise(F.col("idx")).cast("long").alias("community"))


def canonical_labels(pop: DataFrame) -> DataFrame:
    """``ind, node, label`` with each label the smallest node that bears it: equal for equal partitions."""
    least = pop.groupBy("ind", "label").agg(F.min("node").alias("least"))
    return pop.join(least, ["ind", "label"]).select("ind", "node", F.col("least").alias("label"))


def single_community(pop: DataFrame) -> DataFrame:
    """``ind, single``: whether all nodes bear one label."""
    return pop.groupBy("ind").agg((F.min("label") == F.max("label")).alias("single"))


def partition_hash(pop: DataFrame) -> DataFrame:
    """``ind, h``: equal for equal partitions whatever their labels (an order-free sum of hashes)."""
    piece = F.xxhash64("node", "label").cast("decimal(38,0)")
    return canonical_labels(pop).groupBy("ind").agg(F.sum(piece).alias("h"))


def duplicates(pop: DataFrame) -> DataFrame:
    """``ind, first_ind``: the first individual with the same partition."""
    hashed = partition_hash(pop)
    first = hashed.groupBy("h").agg(F.min("ind").alias("first_ind"))
    return hashed.join(first, "h").select("ind", "first_ind")


def by_size(partition: DataFrame) -> DataFrame:
    """Communities numbered from 0 by descending size, then smallest node."""
    sizes = partition.groupBy("community").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    ids = numbered(sizes.orderBy(F.desc("size"), "least")).select("community", F.col("idx").alias("new"))
    return partition.join(ids, "community").select("node", F.col("new").alias("community"))


def singletons_for_isolated(partition: DataFrame, n: int | Column) -> DataFrame:
    """-1 becomes a community of its own, ``node + n``."""
    return partition.select("node", F.when(F.col("community") == -1, F.col("node") + n).otherwise(F.col("community")).alias("community"))

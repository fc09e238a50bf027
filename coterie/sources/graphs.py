"""Graphs as DataFrames: ``nodes(node)`` and canonical ``edges(src < dst)``.

Self-loops and duplicates (also reversed ones) are dropped once, here; end points
that the node table lacks are added; isolated nodes stay.  Null ends are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.scratch import materialize


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges with ``src < dst`` of any table with ``src, dst``."""
    ends = edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")).where("a <> b")
    return ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_tables(cls, edges: DataFrame, nodes: DataFrame | None = None) -> Graph:
        """From ``edges(src, dst)`` and optional ``nodes(node)``, neither canonical."""
        canonical = canonical_edges(edges)
        ends = canonical.select(F.explode(F.array("src", "dst")).alias("node"))
        known = ends if nodes is None else nodes.select(F.col("node").cast("long").alias("node")).where("node is not null").union(ends)
        return cls(known.distinct(), canonical)

    @classmethod
    def from_python(cls, spark: SparkSession, graph) -> Graph:
        """From an object with ``nodes()`` and ``edges()``, or with ``vs`` and ``get_edgelist()``."""
        if hasattr(graph, "nodes"):
            nodes, edges = list(graph.nodes()), list(graph.edges())
        elif hasattr(graph, "vs"):
            nodes, edges = [v.index for v in graph.vs], list(graph.get_edgelist())
        else:
            raise ValueError("a graph needs nodes() and edges(), or vs and get_edgelist()")
        if not all(isinstance(x, int) for x in nodes):
            raise ValueError("node ids must be integers")
        return cls.from_tables(spark.createDataFrame([(e[0], e[1]) for e in edges], "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "node long"))

    def add_edges(self, edges: DataFrame) -> Graph:
        """With further edges; known ones change nothing."""
        return Graph.from_tables(self.edges.unionByName(edges.select("src", "dst")), self.nodes)

    @cached_property
    def adj(self) -> DataFrame:
        """Both directions ``u, v`` of every edge."""
        return self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("e")).select("e.u", "e.v")

    @cached_property
    def deg(self) -> DataFrame:
        """``node, deg`` of every node, 0 if isolated."""
        counts = self.adj.groupBy("u").agg(F.count("*").alias("deg"))
        return self.nodes.join(counts, self.nodes.node == counts.u, "left").select("node", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def neighbour_lists(graph: Graph) -> DataFrame:
    """``node, neighbours``: sorted, empty for isolated nodes."""
    lists = graph.adj.groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("neighbours"))
    return graph.nodes.join(lists, graph.nodes.node == lists.u, "left").select("node", F.coalesce("neighbours", F.array().cast("array<long>")).alias("neighbours"))


def locus_candidates(graph: Graph, with_self: bool = False) -> DataFrame:
    """``node, candidates``: neighbours, and the node itself always (``with_self``) or if isolated."""
    lists = neighbour_lists(graph)
    own = F.array("node")
    return lists.select("node", (F.concat(own, "neighbours") if with_self else F.when(F.size("neighbours") == 0, own).otherwise(F.col("neighbours"))).alias("candidates"))


def dense_ids(nodes: DataFrame, buckets: int | None = None) -> DataFrame:
    """``node, idx``: places from 0 in node order.

    Nodes are sorted into ranges; the ranges' sizes are summed, so no window
    spans the table.
    """
    return numbered(nodes.select("node").distinct().sort("node")).select("node", "idx")


def numbered(rows: DataFrame) -> DataFrame:
    """Sorted ``rows`` with ``idx``, their places from 0."""
    # stored, because a sort may cut other ranges when it runs again; the increasing id is partition << 33 plus the place in it
    placed = materialize(rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")), "numbered")
    before, table = 0, []
    for part, n in sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        table.append((part, before))
        before += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(table, "__part int, __before long"))  # one row for each partition
    return placed.join(offsets, "__part").select(*rows.columns, (F.col("__at") + F.col("__before")).alias("idx"))


def partition_from_dict(spark: SparkSession, labels: dict) -> DataFrame:
    """``node, community`` from a Python mapping."""
    return spark.createDataFrame([(int(k), int(v)) for k, v in labels.items()], "node long, community long")


def partition_from_lists(communities: DataFrame) -> DataFrame:
    """``node, community`` from ``members array`` rows with their ``community``."""
    return communities.select(F.explode("members").alias("node"), "community")


def to_dict(partition: DataFrame) -> dict[int, int]:
    """A partition as a Python mapping, for graphs that fit the driver."""
    return {r["node"]: r["community"] for r in partition.select("node", "community").toLocalIterator()}

"""File sources, generators and sinks."""

from __future__ import annotations

import csv
import os
import re
import time
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions.rng import lowest, uniform
from coterie.sources.graphs import Graph, canonical_edges


def read_edge_list(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """``src, dst`` of a text file, gzipped or not; lines that begin with ``#`` are comments."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+" if sep.isspace() else re.escape(sep))
    return lines.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``node, community`` of a text file of pairs."""
    pairs = read_edge_list(spark, path)
    return pairs.select(F.col("src").alias("node"), F.col("dst").alias("community"))


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """``node, community`` of a file with the members of one community a line.

    A node in several communities is left out; a community is named by its
    smallest member.
    """
    members = spark.read.text(path).select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("long")).alias("m"))
    named = members.select(F.array_min("m").alias("community"), F.explode(F.array_distinct("m")).alias("node"))
    return named.groupBy("node").agg(F.min("community").alias("community"), F.max("community").alias("other")).where("community = other").select("node", "community")


def read_gml_zip(spark: SparkSession, path: str, member: str | None = None) -> tuple[Graph, DataFrame]:
    """A graph and its ``value`` labels from a GML file inside a zip (a small file, read by the driver)."""
    with zipfile.ZipFile(path) as z:
        text = z.read(member or next(n for n in z.namelist() if n.endswith(".gml"))).decode("utf-8", "replace")
    nodes, labels, edges = [], [], []
    for kind, body in re.findall(r"\b(node|edge)\s*\[([^\]]*)\]", text):
        fields = dict(re.findall(r"(\w+)\s+(\"[^\"]*\"|\S+)", body))
        if kind == "node":
            nodes.append((int(fields["id"]),))
            if "value" in fields:
                labels.append((int(fields["id"]), fields["value"].strip('"')))
        else:
            edges.append((int(fields["source"]), int(fields["target"])))
    order = {v: i for i, v in enumerate(dict.fromkeys(v for _, v in labels))}
    graph = Graph.from_tables(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(nodes, "node long"))
    return graph, spark.createDataFrame([(n, order[v]) for n, v in labels], "node long, community long")


#: The ties of the karate club and the members of its first faction (Zachary 1977).
KARATE_TIES = (
    (0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (0, 6), (0, 7), (0, 8), (0, 10), (0, 11), (0, 12), (0, 13), (0, 17),
    (0, 19), (0, 21), (0, 31), (1, 2), (1, 3), (1, 7), (1, 13), (1, 17), (1, 19), (1, 21), (1, 30), (2, 3), (2, 7),
    (2, 8), (2, 9), (2, 13), (2, 27), (2, 28), (2, 32), (3, 7), (3, 12), (3, 13), (4, 6), (4, 10), (5, 6), (5, 10),
    (5, 16), (6, 16), (8, 30), (8, 32), (8, 33), (9, 33), (13, 33), (14, 32), (14, 33), (15, 32), (15, 33), (18, 32), (18, 33),
    (19, 33), (20, 32), (20, 33), (22, 32), (22, 33), (23, 25), (23, 27), (23, 29), (23, 32), (23, 33), (24, 25), (24, 27), (24, 31),
    (25, 31), (26, 29), (26, 33), (27, 33), (28, 31), (28, 33), (29, 32), (29, 33), (30, 32), (30, 33), (31, 32), (31, 33), (32, 33),
)
KARATE_FIRST = frozenset((0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 16, 17, 19, 21))


def karate_club(spark: SparkSession) -> tuple[Graph, DataFrame]:
    """The 34 members, their 78 ties and their factions."""
    graph = Graph.from_tables(spark.createDataFrame(KARATE_TIES, "src long, dst long"))
    return graph, spark.createDataFrame([(n, 0 if n in KARATE_FIRST else 1) for n in range(34)], "node long, community long")


def random_graph(spark: SparkSession, n: int, m: int, seed: int = 0) -> Graph:
    """A simple uniform graph G(n, m).

    Random pairs are drawn in excess, deduplicated, and the ``m`` of least hash kept.
    """
    most = n * (n - 1) // 2
    if m > most:
        raise ValueError(f"{n} nodes have at most {most} edges")
    if m > most // 2:  # dense: rank all pairs
        pairs = spark.range(n).withColumnRenamed("id", "src").select("src", F.explode(F.sequence(F.col("src") + 1, F.lit(n - 1))).alias("dst")) if n > 1 else spark.createDataFrame([], "src long, dst long")
        pairs = pairs.where("src < dst")
    else:
        draws = spark.range(4 * m + 64)
        pick = lambda purpose: F.floor(uniform(seed, F.lit(purpose), F.col("id")) * n).cast("long")
        pairs = canonical_edges(draws.select(pick("src").alias("src"), pick("dst").alias("dst")))
    draw = uniform(seed, F.lit("keep"), F.col("src"), F.col("dst"))
    edges = lowest(pairs.withColumn("__all", F.lit(0)), ["__all"], draw, F.lit(m), ["src", "dst"], max(1, m // 1000)).select("src", "dst")
    return Graph(spark.range(n).withColumnRenamed("id", "node"), edges)


def planted_partition(spark: SparkSession, n: int, communities: int, degree: float, mixing: float, seed: int = 0) -> tuple[Graph, DataFrame]:
    """A graph with planted communities (``node mod communities``) and a share ``mixing`` of edges across them."""
    truth = spark.range(n).select(F.col("id").alias("node"), (F.col("id") % communities).alias("community"))
    draws = spark.range(int(n * degree / 2))
    u = lambda purpose: uniform(seed, F.lit(purpose), F.col("id"))
    size = n // communities
    src = F.floor(u("src") * n).cast("long")
    inside = F.floor(u("in") * size).cast("long") * communities + F.pmod("src", F.lit(communities))
    across = F.floor(u("out") * n).cast("long")
    edges = draws.withColumn("src", src).select("src", F.when(u("mix") < mixing, across).otherwise(inside).alias("dst")).where(f"dst < {n}")
    return Graph.from_tables(edges, truth.select("node")), truth


def lfr_graph(spark: SparkSession, n: int, tau1: float = 2.5, tau2: float = 1.5, degree: int = 20, most_degree: int = 50, least: int = 20, most: int = 100, mixing: float = 0.3, seed: int = 0) -> tuple[Graph, DataFrame]:
    """Power-law degrees and community sizes after Lancichinetti, Fortunato and Radicchi, by random pairing of stubs.

    Sizes are drawn on the driver (``n / least`` numbers); stubs are paired by
    rank within salted hash order, inside communities or across all.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    sizes: list[int] = []
    while sum(sizes) < n:
        u = rng.random()
        sizes.append(int((least ** (1 - tau2) + u * (most ** (1 - tau2) - least ** (1 - tau2))) ** (1 / (1 - tau2))))
    sizes[-1] -= sum(sizes) - n
    if len(sizes) > 1 and sizes[-1] < least:
        sizes[-2] += sizes.pop()
    starts = np.cumsum([0, *sizes[:-1]]).tolist()
    communities = spark.createDataFrame([(i, s, n_) for i, (s, n_) in enumerate(zip(starts, sizes, strict=True))], "community long, start long, size long")
    truth = communities.select("community", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("node"))
    shape = 1 - tau1
    low = max(1.0, degree * (tau1 - 2) / (tau1 - 1))
    draw = F.pow(F.lit(low**shape) + uniform(seed, F.lit("degree"), F.col("node")) * F.lit(most_degree**shape - low**shape), F.lit(1 / shape))
    stubs = truth.withColumn("degree", F.greatest(F.lit(1), F.round(draw).cast("int"))).select("node", "community", F.explode(F.sequence(F.lit(1), F.col("degree"))).alias("stub"))
    outside = uniform(seed, F.lit("mix"), F.col("node"), F.col("stub")) < mixing
    # stubs of one pool meet in pairs: neighbours in hash order within small pools
    pool = F.when(outside, -1 - F.pmod(F.xxhash64(F.lit(seed), "node", "stub"), F.lit(max(1, n // 2000)))).otherwise(F.col("community"))
    from pyspark.sql import Window

    order = Window.partitionBy("pool").orderBy(F.xxhash64(F.lit(seed + 1), "node", "stub"), "node", "stub")
    placed = stubs.withColumn("pool", pool).withColumn("rn", F.row_number().over(order))
    pairs = placed.groupBy("pool", F.floor((F.col("rn") - 1) / 2).alias("pair")).agg(F.min("node").alias("src"), F.max("node").alias("dst"))
    return Graph.from_tables(pairs.select("src", "dst"), truth.select("node")), truth.select("node", "community")


#: The columns of a benchmark's result rows; the first six are a run's key.
RESULT_KEY = ("alg", "kind", "net", "n_cfg", "mu", "seed")
RESULT_FIELDS = (*RESULT_KEY, "status", "n", "m", "k", "time", "nmi", "ami", "ari", "hom", "cmp", "vm", "gt_k", "mu_real", "modularity", "part", "threads", "stamp")


class ResultSink:
    """A CSV file of result rows on the driver, each forced to disk before the next run begins."""

    def __init__(self, path: str):
        new = not os.path.exists(path) or not os.path.getsize(path)
        self.file = open(path, "a", newline="", encoding="utf-8")
        self.rows = csv.DictWriter(self.file, RESULT_FIELDS, restval="")
        if new:
            self.rows.writeheader()

    def write(self, task: dict, status: str, **found) -> None:
        """One row: the task's key, its status, the time, and what was found; unknown names raise ``ValueError``."""
        key = {k: task.get(k, "") for k in RESULT_KEY}
        self.rows.writerow(key | {"status": status, "stamp": time.strftime("%Y-%m-%dT%H:%M:%S")} | found)
        self.file.flush()
        os.fsync(self.file.fileno())

    def close(self) -> None:
        self.file.close()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a result file, all as text."""
    return spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in RESULT_FIELDS)).csv(path)


def write_results(rows: DataFrame, path: str) -> None:
    """Append a table of result rows as CSV files with a header; missing result columns are empty."""
    known = [F.col(c) if c in rows.columns else F.lit("").alias(c) for c in RESULT_FIELDS]
    rows.select(*known).write.mode("append").option("header", True).csv(path)


def write_partition(partition: DataFrame, path: str, **run_key) -> None:
    """Store a partition under its run's key, replacing that run only."""
    keyed = partition.select("node", "community", *[F.lit(v).alias(k) for k, v in run_key.items()])
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*run_key).parquet(path)


def cached_graph(spark: SparkSession, path: str, make) -> Graph:
    """The graph stored at ``path``; made and stored first if absent (``mode=ignore`` keeps what another run stored)."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/edges/_SUCCESS")
    if not hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath):
        graph = make()
        graph.nodes.write.mode("ignore").parquet(f"{path}/nodes")
        graph.edges.write.mode("ignore").parquet(f"{path}/edges")
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

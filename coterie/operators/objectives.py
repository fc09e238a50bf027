"""Partition objectives of a whole population ``pop(ind, node, label)`` at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.sources.graphs import Graph


def internal_edges(pop: DataFrame, graph: Graph) -> DataFrame:
    """``ind, label, internal``: edges inside each community that has any."""
    src = pop.select("ind", F.col("node").alias("src"), F.col("label").alias("ls"))
    dst = pop.select("ind", F.col("node").alias("dst"), F.col("label").alias("ld"))
    return graph.edges.join(src, "src").join(dst, ["ind", "dst"]).where("ls = ld").groupBy("ind", F.col("ls").alias("label")).agg(F.count("*").alias("internal"))


def community_stats(pop: DataFrame, graph: Graph) -> DataFrame:
    """``ind, label, size, degsum, internal`` of every community."""
    sizes = pop.join(graph.deg, "node").groupBy("ind", "label").agg(F.count("*").alias("size"), F.sum("deg").alias("degsum"))
    return sizes.join(internal_edges(pop, graph), ["ind", "label"], "left").select("ind", "label", "size", "degsum", F.coalesce("internal", F.lit(0)).alias("internal"))


def objectives(pop: DataFrame, graph: Graph) -> DataFrame:
    """``ind, n, k, intra, inter, kkm, rc, q``; intra and inter are 0 without edges.

    ``m`` counts the edges of the whole graph, also where a partition covers a part of its nodes only.
    ``intra = 1 - sum internal / m``, ``inter = sum (degsum / 2m)^2``,
    ``q = 1 - intra - inter`` (0 without edges), ``kkm = 2 (n - k) - sum 2 internal / size``,
    ``rc = sum (degsum - 2 internal) / size``.
    """
    sums = community_stats(pop, graph).groupBy("ind").agg(
        F.sum("size").alias("n"),
        F.count("*").alias("k"),
        F.sum("internal").alias("inside"),
        F.sum(F.pow(F.col("degsum").cast("double"), 2)).alias("squares"),
        F.sum(2 * F.col("internal") / F.col("size")).alias("density"),
        F.sum((F.col("degsum") - 2 * F.col("internal")) / F.col("size")).alias("rc"),
    )
    sums = sums.crossJoin(F.broadcast(graph.edges.agg(F.count("*").alias("m"))))  # one row
    some = F.col("m") > 0
    intra = F.when(some, 1 - F.col("inside") / F.col("m")).otherwise(0.0)
    inter = F.when(some, F.col("squares") / F.pow(2.0 * F.col("m"), 2)).otherwise(0.0)
    return sums.select("ind", "n", "k", intra.alias("intra"), inter.alias("inter"), (2.0 * (F.col("n") - F.col("k")) - F.col("density")).alias("kkm"), F.col("rc"), F.when(some, 1 - intra - inter).otherwise(0.0).alias("q"))


def community_score(pop: DataFrame, graph: Graph, r: float = 1.0, alpha: float = 1.0) -> DataFrame:
    """``ind, cs, cf``, both to be maximised.

    With ``k_in`` the neighbours of a node in its community and ``mu = k_in / size``:
    ``cs = sum over communities of mean(mu^r) * sum k_in``, ``cf = sum k_in / deg^alpha``.
    """
    own = pop.select("ind", F.col("node").alias("u"), F.col("label").alias("lu"))
    other = pop.select("ind", F.col("node").alias("v"), F.col("label").alias("lv"))
    inside = graph.adj.join(own, "u").join(other, ["ind", "v"]).where("lu = lv").groupBy("ind", F.col("u").alias("node")).agg(F.count("*").alias("k_in"))
    rows = pop.join(inside, ["ind", "node"], "left").join(graph.deg, "node").select("ind", "label", F.coalesce("k_in", F.lit(0)).cast("double").alias("k_in"), F.col("deg").cast("double").alias("deg"))
    fit = F.when(F.col("deg") > 0, F.col("k_in") / F.pow("deg", F.lit(alpha))).otherwise(0.0)
    # mean((k_in / size)^r) = sum(k_in^r) / size^(r + 1)
    grouped = rows.groupBy("ind", "label").agg(F.count("*").cast("double").alias("size"), F.sum("k_in").alias("inside"), F.sum(F.pow("k_in", F.lit(r))).alias("powers"), F.sum(fit).alias("cf"))
    return grouped.groupBy("ind").agg(F.sum(F.col("powers") / F.pow("size", F.lit(r + 1.0)) * F.col("inside")).alias("cs"), F.sum("cf").alias("cf"))


#: Objective vectors that are minimised: columns and signs.
SETS = {
    "intra_inter": (("intra", 1), ("inter", 1)),
    "kkm_rc": (("kkm", 1), ("rc", 1)),
    "cs_cf": (("cs", -1), ("cf", -1)),
    "cs_cf_q": (("cs", -1), ("cf", -1), ("q", -1)),
    "kkm_rc_q": (("kkm", 1), ("rc", 1), ("q", -1)),
}


def evaluate(pop: DataFrame, graph: Graph, name: str, r: float = 1.0, alpha: float = 1.0) -> DataFrame:
    """``ind, f array<double>`` of a named set, always minimised."""
    if name not in SETS:
        raise ValueError(f"objective set must be one of {sorted(SETS)}")
    columns = SETS[name]
    wants = {c for c, _ in columns}
    found = objectives(pop, graph) if wants - {"cs", "cf"} else None
    if wants & {"cs", "cf"}:
        scores = community_score(pop, graph, r, alpha)
        found = scores if found is None else found.join(scores, "ind")
    return found.select("ind", F.array(*[(F.col(c) * sign).cast("double") for c, sign in columns]).alias("f"))


def q_score(f: Column) -> Column:
    """Number of objectives less their sum: modularity plus one for intra and inter."""
    return F.size(f) - F.aggregate(f, F.lit(0.0), lambda a, x: a + x)


def modularity(partition: DataFrame, graph: Graph) -> DataFrame:
    """One row ``n, m, k, intra, inter, q`` of a partition."""
    pop = partition.select(F.lit(0).alias("ind"), "node", F.col("community").alias("label"))
    edges = graph.edges.agg(F.count("*").alias("m"))
    return objectives(pop, graph).crossJoin(F.broadcast(edges)).select("n", "m", "k", "intra", "inter", "q")

"""Iterative graph operators: components, codecs, label propagation, refinement.

Populations are ``(ind, node, label)``; ``wadj(u, v, w)`` holds both directions
of every edge with its weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.scratch import drop_path, materialize, store
from coterie.sources.graphs import Graph


def components(links: DataFrame, nodes: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``ind, node, label``: the smallest node reachable over ``links(ind, a, b)``, for all of ``nodes(ind, node)``.

    Each round every node takes the least label around it and then the label of
    its label, so paths halve; ends when nothing changes.
    """
    spark = links.sparkSession
    both, both_path = store(links.where("a <> b").select("ind", F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("ind", "e.x", "e.y").distinct(), "links")
    now, path = store(nodes.select("ind", "node", F.col("node").alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(now.select("ind", F.col("node").alias("y"), "label"), ["ind", "y"]).groupBy("ind", F.col("x").alias("node")).agg(F.min("label").alias("near"))
        hooked = now.join(near, ["ind", "node"], "left").select("ind", "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = now.select("ind", F.col("node").alias("label"), F.col("label").alias("far"))
        # the label is a node of the same component; its own label is at most as large
        new, new_path = store(hooked.join(jump, ["ind", "label"], "left").select("ind", "node", F.least("label", F.coalesce("far", "label")).alias("label"), "old"), "labels")
        moved = not new.where("label <> old").isEmpty()
        drop_path(spark, path)
        now, path = new.drop("old"), new_path
        if not moved:
            drop_path(spark, both_path)
            return now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def decode_locus(locus: DataFrame) -> DataFrame:
    """Labels of ``locus(ind, node, target)``: the components of its links, each named by its smallest node."""
    return components(locus.select("ind", F.col("node").alias("a"), F.col("target").alias("b")), locus.select("ind", "node"))


def split_components(pop: DataFrame, graph: Graph) -> DataFrame:
    """Every community's connected parts as communities, named by their smallest node."""
    own = pop.select("ind", F.col("node").alias("src"), F.col("label").alias("ls"))
    other = pop.select("ind", F.col("node").alias("dst"), F.col("label").alias("ld"))
    same = graph.edges.join(own, "src").join(other, ["ind", "dst"]).where("ls = ld").select("ind", F.col("src").alias("a"), F.col("dst").alias("b"))
    return components(same, pop.select("ind", "node"))


def fill_unset(pop: DataFrame, graph: Graph) -> DataFrame:
    """Null labels become the smallest node of their component among unset nodes."""
    unset = materialize(pop.where("label is null").select("ind", "node"), "unset")
    a, b = (unset.select("ind", F.col("node").alias(x)) for x in ("src", "dst"))
    links = graph.edges.join(a, "src").join(b, ["ind", "dst"]).select("ind", F.col("src").alias("a"), F.col("dst").alias("b"))
    filled = components(links, unset)
    return pop.where("label is not null").select("ind", "node", "label").union(filled.select("ind", "node", "label"))


def unit_weights(graph: Graph) -> DataFrame:
    return graph.adj.select("u", "v", F.lit(1.0).alias("w"))


def weighted_votes(pop: DataFrame, wadj: DataFrame) -> DataFrame:
    """``ind, node, label, weight``: the weight of each label around each node."""
    around = pop.select("ind", F.col("node").alias("v"), "label")
    return wadj.join(around, "v").groupBy("ind", F.col("u").alias("node"), "label").agg(F.round(F.sum("w"), 9).alias("weight"))


def majority_step(pop: DataFrame, wadj: DataFrame) -> DataFrame:
    """All nodes at once take the heaviest label around them (the least on ties); nodes without neighbours keep theirs."""
    best = weighted_votes(pop, wadj).groupBy("ind", "node").agg(F.max(F.struct("weight", (-F.col("label")).alias("minus"))).alias("best"))
    return pop.join(best, ["ind", "node"], "left").select("ind", "node", F.coalesce(-F.col("best.minus"), F.col("label")).alias("label"))


def propagate(centres: DataFrame, graph: Graph, wadj: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Labels spread from ``centres(ind, node)`` in synchronous rounds.

    Centres keep their own label.  A node takes the heaviest set label around it
    and keeps its own on ties.  A node with a label moves in a random half of the
    rounds, which stops pairs from swapping for ever.  Ends when no node wants to
    move; by default after at most 100 rounds more than there are nodes, which
    any path needs at most to be spread over.  What no centre reaches is filled by
    component.
    """
    spark = graph.nodes.sparkSession
    most_rounds = graph.nodes.count() + 100 if most_rounds is None else most_rounds
    wadj, wadj_path = store(wadj, "adjacency")
    inds = centres.select("ind").distinct()
    marked = inds.crossJoin(graph.nodes).join(centres.select("ind", "node", F.lit(True).alias("centre")), ["ind", "node"], "left")
    now, path = store(marked.select("ind", "node", F.when(F.col("centre"), F.col("node")).alias("label"), F.coalesce("centre", F.lit(False)).alias("centre")), "spread")
    for round_ in range(most_rounds):
        votes = weighted_votes(now.where("label is not null").select("ind", "node", "label"), wadj)
        # a node's votes in one group: the best, and that of its own label
        met = now.join(votes.withColumnRenamed("label", "vote"), ["ind", "node"], "left")
        best = F.max(F.struct("weight", (-F.col("vote")).alias("minus"))).alias("best")
        tally = met.groupBy("ind", "node").agg(F.first("label").alias("label"), F.first("centre").alias("centre"), best, F.max(F.when(F.col("vote") == F.col("label"), F.col("weight"))).alias("own"))
        wants = ~F.col("centre") & F.col("best.weight").isNotNull() & (F.col("best.weight") > F.coalesce("own", F.lit(0.0)))
        turn = F.col("label").isNull() | (F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(2)) == 0)
        new, new_path = store(tally.select("ind", "node", F.when(wants & turn, -F.col("best.minus")).otherwise(F.col("label")).alias("label"), "centre", wants.alias("wanted")), "spread")
        settled = new.where("wanted").isEmpty()
        drop_path(spark, path)
        now, path = new.drop("wanted"), new_path
        if settled:
            drop_path(spark, wadj_path)
            return fill_unset(now.select("ind", "node", "label"), graph)
    raise RuntimeError(f"labels did not settle in {most_rounds} rounds")


def encode_centres(pop: DataFrame, wadj: DataFrame) -> DataFrame:
    """``ind, label, node``: of each community the node of largest weight to its own (lowest id on ties)."""
    own = pop.select("ind", F.col("node").alias("u"), F.col("label").alias("lu"))
    other = pop.select("ind", F.col("node").alias("v"), F.col("label").alias("lv"))
    inside = wadj.join(own, "u").join(other, ["ind", "v"]).where("lu = lv").groupBy("ind", F.col("u").alias("node")).agg(F.sum("w").alias("weight"))
    scored = pop.join(inside, ["ind", "node"], "left").select("ind", "label", "node", F.round(F.coalesce("weight", F.lit(0.0)), 9).alias("weight"))
    best = scored.groupBy("ind", "label").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("best"))
    return best.select("ind", "label", (-F.col("best.minus")).alias("node"))


def consensus_weights(wadj: DataFrame, elites: DataFrame, rho: float) -> DataFrame:
    """``(1 - rho) w + rho`` times the share of elites in which both ends agree; unchanged without elites."""
    if elites.isEmpty():
        return wadj
    own = elites.select("ind", F.col("node").alias("u"), F.col("label").alias("lu"))
    other = elites.select("ind", F.col("node").alias("v"), F.col("label").alias("lv"))
    share = wadj.join(own, "u").join(other, ["ind", "v"]).groupBy("u", "v").agg(F.avg((F.col("lu") == F.col("lv")).cast("double")).alias("share"))
    return wadj.join(share, ["u", "v"], "left").select("u", "v", ((1 - rho) * F.col("w") + rho * F.coalesce("share", F.lit(0.0))).alias("w"))


def absorb_tiny(pop: DataFrame, wadj: DataFrame, most_size: int = 2, rounds: int = 5) -> DataFrame:
    """Communities of up to ``most_size`` nodes join their heaviest neighbour, for at most ``rounds`` rounds."""
    for _ in range(rounds):
        new = materialize(absorb_round(pop, wadj, most_size), "absorb")
        if new.where("moved").isEmpty():
            return new.select("ind", "node", "label")
        pop = new.select("ind", "node", "label")
    return pop


def absorb_round(pop: DataFrame, wadj: DataFrame, most_size: int = 2) -> DataFrame:
    """One synchronous round: ``ind, node, label, moved``.

    A tiny community moves if it is one node, has no internal weight, or is drawn
    outside more than inside.  Equal weights go to the larger, then to the least
    label; of two tiny communities that choose each other, only the larger label moves.
    """
    sizes = pop.groupBy("ind", "label").agg(F.count("*").alias("size"))
    tiny = sizes.where(F.col("size") <= most_size)
    own = pop.join(tiny, ["ind", "label"]).select("ind", F.col("node").alias("u"), "label", "size")
    other = pop.select("ind", F.col("node").alias("v"), F.col("label").alias("target"))
    pull = own.join(wadj, "u").join(other, ["ind", "v"]).groupBy("ind", "label", "size", "target").agg(F.round(F.sum("w"), 9).alias("weight"))
    inside = F.col("label") == F.col("target")
    named = pull.join(sizes.select("ind", F.col("label").alias("target"), F.col("size").alias("target_size")), ["ind", "target"])
    best = F.max(F.when(~inside, F.struct("weight", "target_size", (-F.col("target")).alias("minus"))))
    drawn = named.groupBy("ind", "label", "size").agg(F.coalesce(F.sum(F.when(inside, F.col("weight"))), F.lit(0.0)).alias("twice"), best.alias("best"))
    goes = drawn.where(F.col("best").isNotNull() & ((F.col("size") == 1) | (F.col("twice") == 0) | (F.col("best.weight") > F.col("twice") / 2))).select("ind", "label", (-F.col("best.minus")).alias("target"))
    back = goes.select("ind", F.col("label").alias("target"), F.col("target").alias("returns"))
    goes = goes.join(back, ["ind", "target"], "left").where("returns is null or returns <> label or label > target").select("ind", "label", "target")
    return pop.join(goes, ["ind", "label"], "left").select("ind", "node", F.coalesce("target", "label").alias("label"), F.col("target").isNotNull().alias("moved"))


def dense_decode(similarity: DataFrame, centres: DataFrame) -> DataFrame:
    """Every node ``i`` of ``similarity(i, j, s)`` takes its most similar centre (the least on ties)."""
    near = similarity.join(centres.select("ind", F.col("node").alias("j")), "j").groupBy("ind", F.col("i").alias("node")).agg(F.max(F.struct("s", (-F.col("j")).alias("minus"))).alias("best"))
    labels = near.select("ind", "node", (-F.col("best.minus")).alias("label"))
    own = centres.select("ind", "node", F.col("node").alias("self"))
    return labels.join(own, ["ind", "node"], "left").select("ind", "node", F.coalesce("self", "label").alias("label"))


def dense_encode(similarity: DataFrame, pop: DataFrame) -> DataFrame:
    """``ind, label, node``: of each community the node of largest similarity to its own (lowest id on ties)."""
    return encode_centres(pop, similarity.select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("s").alias("w")))

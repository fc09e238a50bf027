"""Initialisation, selection and variation as DataFrame operators with hash randomness.

``seed`` names the run and ``gen`` the generation; the same arguments give the
same draws on any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions.rng import check_probability, lowest, pick, uniform
from coterie.functions.scalars import centre_ceiling
from coterie.sources.graphs import Graph, numbered


def individuals(graph: Graph, size: int) -> DataFrame:
    return graph.nodes.sparkSession.range(size).select(F.col("id").cast("int").alias("ind"))


def random_labels(graph: Graph, size: int, seed: int) -> DataFrame:
    """Each node's label is uniform over the nodes' number."""
    n = graph.nodes.agg(F.count("*").alias("n"))
    draw = F.floor(uniform(seed, F.lit("labels"), F.col("ind"), F.col("node")) * F.col("n")).cast("long")
    return graph.nodes.crossJoin(F.broadcast(individuals(graph, size))).crossJoin(F.broadcast(n)).select("ind", "node", draw.alias("label"))


def one_neighbour(asked: DataFrame, graph: Graph, seed: int, *purpose: Column) -> DataFrame:
    """``ind, node, whom``: a random neighbour of each ``(ind, node)`` that has any.

    The neighbour of least hash, so partial minima meet and no node's neighbours are ever listed.
    """
    draw = F.struct(F.xxhash64(F.lit(seed).cast("long"), *purpose, F.col("ind"), F.col("node"), F.col("v")).alias("h"), F.col("v"))
    near = asked.select("ind", "node").join(graph.adj, F.col("node") == F.col("u"))
    return near.groupBy("ind", "node").agg(F.min(draw).alias("x")).select("ind", "node", F.col("x.v").alias("whom"))


def neighbour_labels(graph: Graph, size: int, seed: int) -> DataFrame:
    """Each node's label is a random neighbour, or itself if isolated."""
    asked = graph.nodes.crossJoin(F.broadcast(individuals(graph, size)))
    drawn = one_neighbour(asked, graph, seed, F.lit("neighbour"))
    return asked.join(drawn, ["ind", "node"], "left").select("ind", "node", F.coalesce("whom", "node").alias("label"))


def random_locus(candidates: DataFrame, size: int, seed: int) -> DataFrame:
    """``ind, node, target`` with a random candidate for each gene."""
    inds = candidates.sparkSession.range(size).select(F.col("id").cast("int").alias("ind"))
    return candidates.crossJoin(F.broadcast(inds)).select("ind", "node", pick(seed, F.col("candidates"), F.lit("locus"), F.col("ind"), F.col("node")).alias("target"))


def centres(graph: Graph, size: int, seed: int, cap: float = 1.0) -> DataFrame:
    """``ind, node``: from 1 to the ceiling centres each.

    The first half of the individuals draws c centres from the 3c nodes of
    largest degree, the others from all nodes.
    """
    n = graph.nodes.count()
    most = centre_ceiling(n, cap)
    ranked = numbered(graph.deg.sort(F.desc("deg"), "node")).select("node", "idx")
    wanted = individuals(graph, size).select("ind", (1 + F.floor(uniform(seed, F.lit("centres"), F.col("ind")) * most)).cast("long").alias("c"))
    pool = F.when(F.col("ind") < size // 2, F.least(3 * F.col("c"), F.lit(n))).otherwise(F.lit(n))
    pools = ranked.crossJoin(F.broadcast(wanted)).where(F.col("idx") < pool).select("ind", "node", "c")
    draw = uniform(seed, F.lit("centre"), F.col("ind"), F.col("node"))
    return lowest(pools, ["ind"], draw, F.col("c"), ["node"], max(1, n // 1000)).select("ind", "node")


def parents_of(size: int, ranked: DataFrame, children: DataFrame, seed: int, gen: int, count: int = 2, strict: bool = True) -> DataFrame:
    """``child, slot, ind``: winners of binary tournaments by rank, then larger crowding.

    A challenger wins only if strictly better; without ``strict`` the tie rule is
    the same, as the first drawn keeps ties in both.  ``ranked`` is a population's
    ``ind, rank, crowd``.
    """
    draw = lambda purpose: F.floor(uniform(seed, F.lit(purpose), F.lit(gen), F.col("child"), F.col("slot")) * size).cast("int")
    slots = children.select("child", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("slot")).select("child", "slot", draw("first").alias("x"), draw("second").alias("y"))
    a, b = (ranked.select(F.col("ind").alias(k), F.col("rank").alias(f"r{k}"), F.col("crowd").alias(f"c{k}")) for k in "xy")
    met = slots.join(F.broadcast(a), "x").join(F.broadcast(b), "y")
    better = (F.col("ry") < F.col("rx")) | ((F.col("ry") == F.col("rx")) & (F.col("cy") > F.col("cx")))
    return met.select("child", "slot", F.when(better, F.col("y")).otherwise(F.col("x")).alias("ind"))


def distinct_parents(size: int, ranked: DataFrame, children: DataFrame, seed: int, gen: int, count: int = 4, draws: int = 32) -> DataFrame:
    """``child, parents``: the first ``count`` distinct winners of up to ``draws`` binary tournaments.

    ``ranked`` is a population's ``ind, rank, crowd``.  Where tournaments name too few
    individuals the first others fill up; a smaller population gives all it has.
    """
    won = parents_of(size, ranked, children, seed, gen, draws).groupBy("child").agg(F.array_sort(F.collect_list(F.struct("slot", "ind"))).alias("won"))
    everyone = F.sequence(F.lit(0), F.lit(size - 1))
    named = F.concat(F.transform("won", lambda x: x["ind"].cast("int")), everyone)
    return won.select("child", F.slice(F.array_distinct(named), 1, min(count, size)).alias("parents"))


def ensemble_majority(votes: DataFrame, seed: int, gen: int) -> DataFrame:
    """``child, node, label`` from ``votes(child, node, labels)``, labels in parent order.

    The first label that reaches two votes wins; if all differ one is drawn.
    """
    labels = F.col("labels")
    at = F.filter(F.transform(labels, lambda x, i: F.struct((F.size(F.filter(F.slice(labels, F.lit(1), i + 1), lambda y: y == x)) >= 2).alias("second"), x.alias("label"))), lambda s: s["second"])
    winner = F.when(F.size(at) > 0, at[0]["label"]).otherwise(pick(seed, labels, F.lit("ensemble"), F.lit(gen), F.col("child"), F.col("node")))
    return votes.select("child", "node", winner.alias("label"))


def full_majority(votes: DataFrame, seed: int, gen: int) -> DataFrame:
    """As ``ensemble_majority`` with a full tally; a tie is drawn among its sorted labels."""
    labels = F.col("labels")
    counted = F.transform(F.array_sort(F.array_distinct(labels)), lambda x: F.struct(F.size(F.filter(labels, lambda y: y == x)).alias("n"), x.alias("label")))
    tallied = votes.select("child", "node", counted.alias("t"))
    most = F.array_max(F.transform("t", lambda s: s["n"]))
    tied = tallied.select("child", "node", "t", most.alias("most")).select("child", "node", F.transform(F.filter("t", lambda s: s["n"] == F.col("most")), lambda s: s["label"]).alias("tied"))
    return tied.select("child", "node", pick(seed, F.col("tied"), F.lit("tally"), F.lit(gen), F.col("child"), F.col("node")).alias("label"))


def parent_votes(pop: DataFrame, parents: DataFrame) -> DataFrame:
    """``child, node, labels`` of ``parents(child, parents)`` in their order."""
    slots = parents.select("child", F.posexplode("parents").alias("slot", "ind"))
    rows = pop.join(F.broadcast(slots), "ind").groupBy("child", "node").agg(F.array_sort(F.collect_list(F.struct("slot", "label"))).alias("s"))
    return rows.select("child", "node", F.transform("s", lambda x: x["label"]).alias("labels"))


def graft(receiver: DataFrame, donor: DataFrame, seed: int, gen: int) -> DataFrame:
    """``child, node, label``: the donor's community of a random node overwrites the receiver's labels there."""
    first = F.min(F.struct(F.xxhash64(F.lit(seed), F.lit("graft"), F.lit(gen), "child", "node").alias("h"), F.col("label")))
    chosen = donor.groupBy("child").agg(first.alias("x")).select("child", F.col("x.label").alias("chosen"))
    given = donor.withColumnRenamed("label", "donor").join(F.broadcast(chosen), "child").where("donor = chosen").select("child", "node", "donor")
    return receiver.join(given, ["child", "node"], "left").select("child", "node", F.coalesce("donor", "label").alias("label"))


def uniform_crossover(a: DataFrame, b: DataFrame, seed: int, gen: int) -> DataFrame:
    """``child, node, target``: each gene from either parent."""
    both = a.join(b.withColumnRenamed("target", "other"), ["child", "node"])
    coin = uniform(seed, F.lit("uniform"), F.lit(gen), F.col("child"), F.col("node")) < 0.5
    return both.select("child", "node", F.when(coin, F.col("target")).otherwise(F.col("other")).alias("target"))


def macro_crossover(a: DataFrame, b: DataFrame, nodes: DataFrame, rate: float, seed: int, gen: int) -> DataFrame:
    """``child, node``: centres from either parent, each bit flipped with ``rate``; a child without a centre gets one.

    Only set bits and flips are joined, not all nodes of all children.
    """
    check_probability(rate)
    children = a.select("child").union(b.select("child")).distinct()
    u = lambda purpose: uniform(seed, F.lit(purpose), F.lit(gen), F.col("child"), F.col("node"))
    taken = a.select("child", "node").where(u("side") < 0.5).union(b.select("child", "node").where(u("side") >= 0.5))
    flips = nodes.crossJoin(F.broadcast(children)).select("child", "node").where(u("flip") < rate)
    bits = taken.union(flips).groupBy("child", "node").agg(F.count("*").alias("n")).where("n = 1").select("child", "node")  # a set bit that flips goes
    bare = children.join(bits.select("child").distinct(), "child", "left_anti")
    first = F.min(F.struct(F.xxhash64(F.lit(seed), F.lit("repair"), F.lit(gen), "child", "node").alias("h"), "node"))
    rescue = nodes.crossJoin(F.broadcast(bare)).groupBy("child").agg(first.alias("first")).select("child", "first.node")
    return bits.union(rescue)


def majority_mutation(pop: DataFrame, wadj: DataFrame, rate: float, seed: int, gen: int, key: str = "ind") -> DataFrame:
    """Each node, with probability ``rate``, takes the heaviest label around it in the snapshot."""
    from coterie.operators.codec import majority_step

    check_probability(rate)
    rows = pop.select(F.col(key).alias("ind"), "node", "label")
    moved = majority_step(rows, wadj).withColumnRenamed("label", "major")
    hit = uniform(seed, F.lit("majority"), F.lit(gen), F.col("ind"), F.col("node")) < rate
    return rows.join(moved, ["ind", "node"]).select(F.col("ind").alias(key), "node", F.when(hit, F.col("major")).otherwise(F.col("label")).alias("label"))


def neighbour_mutation(pop: DataFrame, graph: Graph, rate: float, seed: int, gen: int) -> DataFrame:
    """Each node, with probability ``rate``, copies a random neighbour's label in the snapshot."""
    check_probability(rate)
    hit = uniform(seed, F.lit("copy"), F.lit(gen), F.col("ind"), F.col("node")) < rate
    asked = one_neighbour(pop.where(hit), graph, seed, F.lit("whom"), F.lit(gen))
    source = pop.select("ind", F.col("node").alias("whom"), F.col("label").alias("copied"))
    copied = asked.join(source, ["ind", "whom"]).select("ind", "node", "copied")
    return pop.join(copied, ["ind", "node"], "left").select("ind", "node", F.coalesce("copied", "label").alias("label"))


def locus_mutation(locus: DataFrame, candidates: DataFrame, rate: float, seed: int, gen: int) -> DataFrame:
    """Each gene, with probability ``rate``, is drawn again from its candidates."""
    check_probability(rate)
    hit = uniform(seed, F.lit("locus"), F.lit(gen), F.col("ind"), F.col("node")) < rate
    drawn = pick(seed, F.col("candidates"), F.lit("gene"), F.lit(gen), F.col("ind"), F.col("node"))
    return locus.join(candidates, "node").select("ind", "node", F.when(hit, drawn).otherwise(F.col("target")).alias("target"))


def roulette(ranked: DataFrame, draws: int, seed: int, gen: int) -> DataFrame:
    """``draw, ind``: places drawn with weight ``1 / sqrt(position)``; ``ranked(ind, pos)`` is a population, positions from 1."""
    from pyspark.sql import Window

    total = Window.orderBy("pos")
    weight = 1 / F.sqrt("pos")
    # one row for each individual of a population
    wheel = ranked.withColumn("high", F.sum(weight).over(total)).withColumn("low", F.col("high") - weight)
    top = wheel.agg(F.max("high").alias("top"))
    spins = ranked.sparkSession.range(draws).select(F.col("id").alias("draw"), uniform(seed, F.lit("roulette"), F.lit(gen), F.col("id")).alias("u")).crossJoin(F.broadcast(top)).select("draw", (F.col("u") * F.col("top")).alias("at"))
    return spins.join(F.broadcast(wheel), (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))).select("draw", "ind")

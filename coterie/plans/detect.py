"""Evolutionary detectors over a broadcast graph, populations held as tables.

The population is a scratch table ``(ind, genome, f, ...)``.  A generation
deals parents to children on the driver (it knows the objective matrix only),
builds and evaluates children in parallel on the executors, and keeps survivors.
Draws depend on ``(seed, generation, individual)`` alone.  The graph must fit a
worker: ``MOST_EDGES`` bounds what is broadcast.  For larger graphs
``edge_parallel`` runs the label-based detector as joins.

Results are ``(node, community)``: isolated nodes get -1, communities are
numbered by their smallest node.  Fronts are ``(sol_id, node, community)`` with
the objectives in ``front.objectives(sol_id, f)``.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions.rng import check_probability
from coterie.functions.scalars import centre_ceiling, node_rate, objective_sets, topology_operators
from coterie.operators import pareto
from coterie.plans import arrays
from coterie.plans.arrays import Csr
from coterie.scratch import drop_path, prepare, store
from coterie.sources.graphs import Graph

MOST_EDGES, MOST_NODES = 20_000_000, 20_000_000
MOST_DENSE = 2_000
SPREAD = 100_000  #: nodes and edges from which the children of a generation are dealt over tasks of their own
#: Progress of detectors: ``logging.getLogger("coterie").setLevel(logging.DEBUG)`` shows every generation.
log = logging.getLogger("coterie")
_CORES: list[int] = []
ROWS = "ind int, genome binary, labels binary, f array<double>, canon string"


def load(graph: Graph) -> Csr:
    """The graph as arrays on the driver, if it is small enough to broadcast."""
    m, n = graph.edges.count(), graph.nodes.count()
    if m > MOST_EDGES or n > MOST_NODES:
        raise ValueError(f"{n} nodes and {m} edges are more than {MOST_NODES} and {MOST_EDGES}; use edge_parallel")
    ids = np.sort(graph.nodes.toPandas()["node"].to_numpy(np.int64))
    edges = graph.edges.toPandas()
    return Csr.build(ids, np.searchsorted(ids, edges["src"].to_numpy(np.int64)), np.searchsorted(ids, edges["dst"].to_numpy(np.int64)))


def draws(seed: int, *of: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *of])))


@dataclass
class Engine:
    """Builds, evaluates and stores individuals of one kind.

    ``make(csr, extra, rng, parents)`` gives a genome (parents empty: a random
    one), ``decode(csr, extra, genome)`` its labels, ``evaluate(csr, labels)``
    the vector to minimise.
    """

    spark: SparkSession
    graph: object
    make: Callable
    decode: Callable
    evaluate: Callable
    seed: int
    salt: int
    extra: object = None
    tables: list = field(default_factory=list)

    def build(self, generation: int, parents: dict[int, list[int]], population: DataFrame | None) -> DataFrame:
        """Children ``ind`` of their parents' places, stored; without parents, random ones."""
        make, decode, evaluate, seed, salt, graph, extra = self.make, self.decode, self.evaluate, self.seed, self.salt, self.graph, self.extra

        def work(frame: pd.DataFrame) -> pd.DataFrame:
            g, more = graph.value, extra.value if extra is not None else None
            ind = int(frame["child"].iloc[0])
            given = [] if frame["genome"].isna().any() else [np.frombuffer(x, "<i4") for x in frame.sort_values("slot")["genome"]]
            genome = np.asarray(make(g, more, draws(seed, salt, generation, ind), given), "<i4")
            labels = arrays.canonical(decode(g, more, genome)).astype("<i4")
            return pd.DataFrame([[ind, genome.tobytes(), labels.tobytes(), evaluate(g, labels), hashlib.md5(labels.tobytes()).hexdigest()]], columns=["ind", "genome", "labels", "f", "canon"])

        specs = [(c, s, p) for c, ps in parents.items() for s, p in enumerate(ps or [-1])]
        slots = self.spark.createDataFrame(specs, "child int, slot int, ind int")
        if population is None:
            dealt = slots.select("child", "slot", F.lit(None).cast("binary").alias("genome"))
        else:
            dealt = slots.join(population.select("ind", "genome"), "ind", "left").select("child", "slot", "genome")
        # one group for each child: its parents' genomes, a handful
        tasks = _CORES[0] if _CORES else self.tasks(len(parents))
        dealt = dealt.repartition(tasks, "child") if tasks else dealt
        return self.keep(dealt.groupBy("child").applyInPandas(work, ROWS))

    def tasks(self, children: int) -> int:
        """Tasks that build children of a large graph: Spark joins partitions by their bytes, which tell nothing of the work."""
        if self.graph.value.n + self.graph.value.m < SPREAD:
            return 0
        return min(children, 4 * self.spark.sparkContext.defaultParallelism)

    def keep(self, rows: DataFrame) -> DataFrame:
        table, path = store(rows, "population")
        self.tables.append(path)
        return table

    def trim(self, keep: int = 3) -> None:
        """Drop all but the latest tables."""
        while len(self.tables) > keep:
            drop_path(self.spark, self.tables.pop(0))


def matrix(rows: DataFrame) -> tuple[list[int], np.ndarray, list[str]]:
    """Places, objectives and partition hashes of a population, by place: all that the driver reads."""
    found = sorted((r["ind"], r["f"], r["canon"]) for r in rows.select("ind", "f", "canon").collect())
    return [r[0] for r in found], np.array([r[1] for r in found], float).reshape(len(found), -1), [r[2] for r in found]


def chosen(rows: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of the given places (a population's at most)."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(int(i),) for i in ids], "ind int")), "ind", "left_semi")


def renumbered(rows: DataFrame, ids: list[int]) -> DataFrame:
    """The given places in order, numbered from 0."""
    places = rows.sparkSession.createDataFrame([(int(i), k) for k, i in enumerate(ids)], "ind int, new int")
    return rows.join(F.broadcast(places), "ind").drop("ind").withColumnRenamed("new", "ind").select("ind", "genome", "labels", "f", "canon")


def tournament(rng: np.random.Generator, rank: np.ndarray, crowd: np.ndarray) -> int:
    a, b = rng.integers(len(rank), size=2)
    return int(b if (rank[b], -crowd[b]) < (rank[a], -crowd[a]) else a)


def tournament_parents(rng, rank, crowd, count: int) -> list[int]:
    """Tournament winners, distinct while the population has enough."""
    found: list[int] = []
    for _ in range(64):
        p = tournament(rng, rank, crowd)
        if p not in found:
            found.append(p)
        if len(found) == count:
            return found
    return found + [i for i in range(len(rank)) if i not in found][: count - len(found)]


@dataclass
class Front:
    """Partitions of a front as a table, with their objectives."""

    partitions: DataFrame
    objectives: DataFrame


def as_front(rows: DataFrame, ids: list[int], graph) -> Front:
    """Rows ``(sol_id, node, community)`` of the given places, duplicates of a partition left out by the caller."""
    places = rows.sparkSession.createDataFrame([(int(i), k) for k, i in enumerate(ids)], "ind int, sol_id int")

    def explode(batches):
        g = graph.value
        for batch in batches:
            for _, r in batch.iterrows():
                labels = np.frombuffer(r["labels"], "<i4")
                linked = g.deg > 0
                names = np.full(g.n, -1)
                firsts = np.unique(labels[linked], return_inverse=True)
                _, order = np.unique(firsts[1], return_index=True)
                number = np.empty(len(order), int)
                number[np.argsort(order, kind="stable")] = np.arange(len(order))
                names[linked] = number[firsts[1]]
                yield pd.DataFrame({"sol_id": np.int32(r["sol_id"]), "node": g.ids, "community": names})

    kept = rows.join(F.broadcast(places), "ind")
    table, _ = store(kept.select("sol_id", "labels").mapInPandas(explode, "sol_id int, node long, community long"), "partitions")
    objs, _ = store(kept.select("sol_id", "f"), "objectives")
    return Front(table, objs)


def best(front: Front, sol_id: int) -> DataFrame:
    return front.partitions.where(F.col("sol_id") == sol_id).select("node", "community")


def first_front(ids: list[int], f: np.ndarray, canon: list[str]) -> list[int]:
    """Places on the first front, one of each partition."""
    rank = pareto.ranks(f)
    seen: dict[str, int] = {}
    for i, r, c in zip(ids, rank, canon, strict=True):
        if r == 1:
            seen.setdefault(c, i)
    return sorted(seen.values())


def nothing(spark: SparkSession) -> Front:
    return Front(spark.createDataFrame([], "sol_id int, node long, community long"), spark.createDataFrame([], "sol_id int, f array<double>"))


@dataclass
class Run:
    spark: SparkSession
    csr: Csr
    shared: object

    @classmethod
    def start(cls, graph: Graph) -> Run:
        spark = graph.nodes.sparkSession
        prepare(spark)
        csr = load(graph)
        return cls(spark, csr, spark.sparkContext.broadcast(csr))  # at most MOST_EDGES edges

    def engine(self, make, decode, evaluate, seed, salt=0, extra=None) -> Engine:
        return Engine(self.spark, self.shared, make, decode, evaluate, seed, salt, extra)

    def all_isolated(self) -> Front:
        rows = self.spark.createDataFrame([(0, int(i), -1) for i in self.csr.ids], "sol_id int, node long, community long")
        return Front(rows, self.spark.createDataFrame([(0, [0.0, 0.0])], "sol_id int, f array<double>"))


def plain_labels(g, extra, genome):
    return genome


def evaluator(name: str, r: float = 1.0, alpha: float = 1.0):
    return lambda g, labels: arrays.objective_vector(g, labels, name, r, alpha)


def check_sizes(pop_size: int, num_gens: int, **rates: float) -> None:
    if pop_size < 1 or num_gens < 0:
        raise ValueError("pop_size must be positive and num_gens not negative")
    for name, rate in rates.items():
        check_probability(rate, name)


# HP-MOCD: labels, ensemble crossover, majority mutation, NSGA-II


def hpmocd_front(graph: Graph, pop_size: int = 100, num_gens: int = 100, cross_rate: float = 0.7, mut_rate: float = 0.5, seed: int = 0, objectives: list[Callable] | None = None, on_generation: Callable[[int, int, int], None] | None = None, stepwise: bool = False) -> Front:
    """``objectives``: functions ``(graph, partition) -> float`` to minimise instead of intra and inter.

    They get an ``arrays.GraphView`` and a mapping of node ids to labels, on the executors.
    ``on_generation(generation, generations, front size)`` is called on the driver.
    Mutated nodes take the commonest label of a snapshot, or (``stepwise``) one after another.
    """
    check_sizes(pop_size, num_gens, cross_rate=cross_rate, mut_rate=mut_rate)
    run = Run.start(graph)
    if not run.csr.n:
        return nothing(run.spark)

    def make(g, extra, rng, parents):
        if not parents:
            return rng.integers(g.n, size=g.n)
        child = arrays.ensemble(parents, rng) if rng.random() < cross_rate else parents[rng.integers(len(parents))].copy()
        return arrays.majority(g, child, np.flatnonzero(rng.random(g.n) < mut_rate), stepwise=stepwise)

    def custom(g, labels):
        view = arrays.GraphView(g)
        partition = view.partition(labels)
        return [float(o(view, partition)) for o in objectives]

    evaluate = custom if objectives else evaluator("intra_inter")
    engine = run.engine(make, plain_labels, evaluate, seed)
    deal = lambda rng, rank, crowd: tournament_parents(rng, rank, crowd, 4)
    rows = nsga2(engine, pop_size, num_gens, deal, 2, on_generation)
    ids, f, canon = matrix(rows)
    return as_front(rows, first_front(ids, f, canon), run.shared)


def nsga2(engine: Engine, pop_size: int, num_gens: int, deal, small: int, on_generation=None) -> DataFrame:
    rows = engine.build(0, {i: [] for i in range(pop_size)}, None)
    for gen in range(1, num_gens + 1):
        _, f, _ = matrix(rows)
        rank = pareto.ranks(f)
        crowd = pareto.crowding_of(f, rank, small)
        rng = draws(engine.seed, 1000 + engine.salt, gen)
        children = engine.build(gen, {pop_size + i: deal(rng, rank, crowd) for i in range(pop_size)}, rows)
        both = rows.union(children)
        ids, f, _ = matrix(both)
        order, rank, _ = pareto.select_survivors(f, pop_size, small)
        rows = engine.keep(renumbered(both, [ids[i] for i in order]))
        engine.trim()
        log.debug("generation %d of %d: %d individuals on the front", gen, num_gens, int((rank == 1).sum()))
        if on_generation:
            on_generation(gen, num_gens, int((rank == 1).sum()))
    return rows


def max_q(front: Front) -> int | None:
    """The solution of largest ``count - sum`` of its objectives, the last on ties."""
    found = [(r["sol_id"], r["f"]) for r in front.objectives.collect()]
    return max(found, key=lambda x: (round(len(x[1]) - sum(x[1]), 12), x[0]))[0] if found else None


def pick(front: Front, sol_id: int | None) -> DataFrame:
    return best(front, -1 if sol_id is None else sol_id)


def hpmocd(graph: Graph, **params) -> DataFrame:
    front = hpmocd_front(graph, **params)
    return pick(front, max_q(front))


def hpmocd_fronts(graph: Graph, **params) -> DataFrame:
    return hpmocd_front(graph, **params).partitions


# locus genomes: a gene is the place of a neighbour or of the node itself


def locus_make(cross_rate: float, mut_rate: float, with_self: bool):
    def drawn(g: Csr, rng, where: np.ndarray) -> np.ndarray:
        width = g.deg[where] + with_self
        at = np.floor(rng.random(len(where)) * np.maximum(width, 1)).astype(int)
        own = (g.deg[where] == 0) | (at >= g.deg[where])
        out = where.copy()
        out[~own] = g.adj[g.start[where[~own]] + at[~own]]
        return out

    def make(g, extra, rng, parents):
        if not parents:
            return drawn(g, rng, np.arange(g.n))
        a, b = parents[0], parents[-1]
        child = np.where(rng.random(g.n) < 0.5, a, b) if rng.random() < cross_rate else (a if rng.random() < 0.5 else b).copy()
        hit = np.flatnonzero(rng.random(g.n) < mut_rate)
        child[hit] = drawn(g, rng, hit)
        return child

    return make


def locus_labels(g, extra, genome):
    return arrays.components_of(g.n, np.arange(g.n), genome)


def pesa2(engine: Engine, pop_size: int, num_gens: int, capacity: int) -> DataFrame:
    """An archive of the best; parents come from less crowded cells of its hyper-grid."""
    rows, following = engine.build(0, {i: [] for i in range(pop_size)}, None), None
    for gen in range(num_gens + 1):
        both = rows if following is None else rows.union(following)
        ids, f, _ = matrix(both)
        rng = draws(engine.seed, 2000 + engine.salt, gen)
        inside = np.flatnonzero(pareto.ranks(f) == 1)
        inside = inside[pareto.squeeze(f[inside], capacity, rng)]
        rows = engine.keep(renumbered(both, [ids[i] for i in inside]))
        engine.trim()
        if gen == num_gens:
            break
        cells: dict = {}
        for i, c in enumerate(pareto.cells_of(f[inside])):
            cells.setdefault(c, []).append(i)
        names = sorted(cells)

        def parent(rng=rng, names=names, cells=cells) -> int:
            a, b = (names[int(i)] for i in rng.integers(len(names), size=2))
            a = b if len(cells[b]) < len(cells[a]) or len(cells[b]) == len(cells[a]) and rng.random() < 0.5 else a
            return cells[a][int(rng.integers(len(cells[a])))]

        following = engine.build(gen + 1, {capacity + i: [parent(), parent()] for i in range(pop_size)}, rows)
    return rows


def mocd_front(graph: Graph, pop_size: int = 100, num_gens: int = 100, cross_rate: float = 0.9, mut_rate: float = 0.1, seed: int = 0) -> Front:
    check_sizes(pop_size, num_gens, cross_rate=cross_rate, mut_rate=mut_rate)
    run = Run.start(graph)
    if not run.csr.n:
        return nothing(run.spark)
    if not run.csr.m:
        return run.all_isolated()
    rows = pesa2(run.engine(locus_make(cross_rate, mut_rate, False), locus_labels, evaluator("intra_inter"), seed), pop_size, num_gens, min(pop_size, 100))
    ids, f, canon = matrix(rows)
    return as_front(rows, first_front(ids, f, canon), run.shared)


def mocd_q(graph: Graph, **params) -> DataFrame:
    """The front's partition of least intra + inter, the first on ties."""
    front = mocd_front(graph, **params)
    found = sorted((round(sum(r["f"]), 12), r["sol_id"]) for r in front.objectives.collect())
    return pick(front, found[0][1] if found else None)


def mocd_d(graph: Graph, rand_networks: int = 3, seed: int = 0, **params) -> DataFrame:
    """The front's partition farthest from the fronts of random graphs of the same size."""
    from coterie.sources.loaders import random_graph

    front = mocd_front(graph, seed=seed, **params)
    spark = graph.nodes.sparkSession
    n, m = graph.nodes.count(), graph.edges.count()
    controls = [mocd_front(random_graph(spark, n, m, seed + 1 + i), seed=seed + 1 + i, **params).objectives for i in range(rand_networks)] if m else []
    own = front.objectives.select(F.col("sol_id").alias("ind"), "f")
    if not controls:
        return pick(front, 0 if n else None)
    other = controls[0]
    for c in controls[1:]:
        other = other.union(c)
    return pick(front, pareto.max_min_distance(own, other).first()["ind"])


def moga_net_front(graph: Graph, pop_size: int = 300, num_gens: int = 30, cross_rate: float = 0.8, mut_rate: float = 0.2, r: float = 1.5, alpha: float = 1.0, seed: int = 0) -> Front:
    """Community score and fitness; a tenth of elites stays, parents by roulette over rank and crowding."""
    check_sizes(pop_size, num_gens, cross_rate=cross_rate, mut_rate=mut_rate)
    run = Run.start(graph)
    if not run.csr.n:
        return nothing(run.spark)
    engine = run.engine(locus_make(cross_rate, mut_rate, False), locus_labels, evaluator("cs_cf", r, alpha), seed)
    rows = engine.build(0, {i: [] for i in range(pop_size)}, None)
    elites = max(1, pop_size // 10)
    for gen in range(1, num_gens + 1):
        _, f, _ = matrix(rows)
        order, _, _ = pareto.select_survivors(f, pop_size, 2)
        weight = 1 / np.sqrt(np.arange(1, pop_size + 1))
        rng = draws(seed, 3000, gen)
        pairs = rng.choice(order, size=(pop_size - elites, 2), p=weight / weight.sum())
        children = engine.build(gen, {elites + i: [int(a), int(b)] for i, (a, b) in enumerate(pairs)}, rows)
        rows = engine.keep(renumbered(rows, order[:elites].tolist()).union(children))
        engine.trim()
    ids, f, canon = matrix(rows)
    return as_front(rows, first_front(ids, f, canon), run.shared)


def by_modularity(graph: Graph, front: Front) -> DataFrame:
    """The front's partition of largest modularity, the last on ties."""
    from coterie.operators.objectives import objectives

    pop = front.partitions.select(F.col("sol_id").alias("ind"), "node", F.when(F.col("community") < 0, -1 - F.col("node")).otherwise(F.col("community")).alias("label"))
    top = objectives(pop, graph).select("ind", F.round("q", 12).alias("q")).orderBy(F.desc("q"), F.desc("ind")).first()
    return pick(front, top["ind"] if top else None)


def moga_net(graph: Graph, **params) -> DataFrame:
    return by_modularity(graph, moga_net_front(graph, **params))


def moga_net_fronts(graph: Graph, **params) -> DataFrame:
    return moga_net_front(graph, **params).partitions


def nsga3_front(graph: Graph, objective_set: str, pop_size: int, num_gens: int, cross_rate: float, mut_rate: float, divisions: int, seed: int, r: float = 1.0, alpha: float = 1.0) -> Front:
    """NSGA-III over locus genomes; copies and one-community members are replaced by random ones each generation."""
    check_sizes(pop_size, num_gens, cross_rate=cross_rate, mut_rate=mut_rate)
    run = Run.start(graph)
    if not run.csr.n:
        return nothing(run.spark)
    engine = run.engine(locus_make(cross_rate, mut_rate, True), locus_labels, evaluator(objective_set, r, alpha), seed)
    points = pareto.simplex_points(3, divisions)
    whole = hashlib.md5(np.zeros(run.csr.n, "<i4").tobytes()).hexdigest()
    rows = engine.build(0, {i: [] for i in range(pop_size)}, None)
    for gen in range(1, num_gens + 1):
        rng = draws(seed, 4000, gen)
        children = engine.build(gen, {pop_size + i: rng.integers(pop_size, size=2).tolist() for i in range(pop_size)}, rows)
        both = rows.union(children)
        ids, f, canon = matrix(both)
        keep = [int(i) for i in pareto.reference_selection(f, pop_size, points, rng)]
        seen, stay = {whole}, []
        for i in keep:
            if canon[i] not in seen:
                seen.add(canon[i])
                stay.append(ids[i])
        kept = renumbered(both, stay)
        if len(stay) < pop_size:
            kept = kept.union(engine.build(10_000 + gen, {i: [] for i in range(len(stay), pop_size)}, None))
        rows = engine.keep(kept)
        engine.trim()
    ids, f, canon = matrix(rows)
    return as_front(rows, first_front(ids, f, canon), run.shared)


def ccm_front(graph: Graph, pop_size: int = 200, num_gens: int = 100, cross_rate: float = 0.8, mut_rate: float = 1 / 68, r: float = 1.0, alpha: float = 1.0, divisions: int = 12, seed: int = 0) -> Front:
    return nsga3_front(graph, "cs_cf_q", pop_size, num_gens, cross_rate, mut_rate, divisions, seed, r, alpha)


def ccm(graph: Graph, **params) -> DataFrame:
    return by_modularity(graph, ccm_front(graph, **params))


def ccm_fronts(graph: Graph, **params) -> DataFrame:
    return ccm_front(graph, **params).partitions


def krm_front(graph: Graph, pop_size: int = 100, num_gens: int = 100, cross_rate: float = 0.8, mut_rate: float = 1 / 34, divisions: int = 12, seed: int = 0) -> Front:
    return nsga3_front(graph, "kkm_rc_q", pop_size, num_gens, cross_rate, mut_rate, divisions, seed)


def krm(graph: Graph, **params) -> DataFrame:
    return by_modularity(graph, krm_front(graph, **params))


def krm_fronts(graph: Graph, **params) -> DataFrame:
    return krm_front(graph, **params).partitions


# macro and micro swarms


def bits_make(cross_rate: float, mut_rate: float, cap: float):
    """Centre genomes: a bit for each node."""

    def make(g, extra, rng, parents):
        if not parents:
            count = int(rng.integers(1, centre_ceiling(g.n, cap) + 1))
            pool = np.lexsort((np.arange(g.n), -g.deg))[: 3 * count] if rng.random() < 0.5 else np.arange(g.n)
            bits = np.zeros(g.n, int)
            bits[rng.choice(pool, min(count, len(pool)), replace=False)] = 1
            return bits
        a, b = parents[0], parents[-1]
        bits = np.where(rng.random(g.n) < 0.5, a, b) if rng.random() < cross_rate else a.copy()
        bits = bits ^ (rng.random(g.n) < mut_rate)
        if not bits.any():
            bits[rng.integers(g.n)] = 1
        return bits

    return make


def labels_make(cross_rate: float, rate: float, ensemble: bool, heaviest: bool):
    """Label genomes: graft or four-parent tally, then neighbour copies or heaviest labels."""

    def make(g, extra, rng, parents):
        if not parents:
            at = g.start[:-1] + np.floor(rng.random(g.n) * np.maximum(g.deg, 1)).astype(int)
            return np.where(g.deg > 0, g.adj[np.minimum(at, max(len(g.adj) - 1, 0))] if len(g.adj) else np.arange(g.n), np.arange(g.n))
        if rng.random() < cross_rate:
            child = arrays.tally(parents, rng) if ensemble else arrays.grafted(parents[0], parents[-1], rng)
        else:
            child = parents[0].copy()
        hit = np.flatnonzero((rng.random(g.n) < node_rate(rate, g.n)) & (g.deg > 0))
        if heaviest:
            return arrays.majority(g, child, hit, weights_of(extra, g), stepwise=True)
        for u in hit.tolist():
            child[u] = child[g.around(u)[rng.integers(g.deg[u])]]
        return child

    return make


def weights_of(extra, g: Csr) -> np.ndarray:
    return np.ones(len(g.adj)) if extra is None or "w" not in extra else extra["w"]


def spread_labels(g, extra, genome):
    return arrays.propagate_from(g, np.flatnonzero(genome), weights_of(extra, g))


def nearest_labels(g, extra, genome):
    """Each node's most similar centre, the first on ties; centres keep themselves."""
    centres = np.flatnonzero(genome)
    labels = centres[extra["s"][:, centres].argmax(axis=1)]
    labels[centres] = centres
    return labels


def medoid_bits(g: Csr, s: np.ndarray, labels: np.ndarray) -> np.ndarray:
    bits = np.zeros(g.n, int)
    for c in np.unique(labels):
        nodes = np.flatnonzero(labels == c)
        bits[nodes[s[np.ix_(nodes, nodes)].sum(axis=1).argmax()]] = 1
    return bits


def agreement(rows: DataFrame, graph, dense: bool) -> np.ndarray:
    """The share of the rows' partitions in which the ends of each directed edge (dense: each pair) agree.

    Summed on the executors; a task returns one array of the graph's size.
    """

    def add(batches):
        g, total, n = graph.value, None, 0
        for batch in batches:
            for raw in batch["labels"]:
                labels = np.frombuffer(raw, "<i4")
                same = (labels[:, None] == labels[None]) if dense else labels[g.rows()] == labels[g.adj]
                total, n = same.astype(float) if total is None else total + same, n + 1
        if n:
            yield pd.DataFrame({"total": [total.tobytes()], "n": [n]})

    parts = rows.select("labels").coalesce(4).mapInPandas(add, "total binary, n long").collect()
    return sum(np.frombuffer(p["total"]) for p in parts) / sum(p["n"] for p in parts)


@dataclass
class Swarms:
    """The micro (labels) and macro (centres) populations and their exchanges."""

    run: Run
    micro: Engine
    macro: Engine
    pop_size: int
    parents: int
    dense: bool

    def step(self, engine: Engine, rows: DataFrame, gen: int, count: int) -> DataFrame:
        _, f, _ = matrix(rows)
        rank = pareto.ranks(f)
        crowd = pareto.crowding_of(f, rank)
        rng = draws(engine.seed, 5000 + engine.salt, gen)
        return engine.build(gen, {self.pop_size + i: tournament_parents(rng, rank, crowd, count) for i in range(self.pop_size)}, rows)

    def select(self, engine: Engine, pool: DataFrame) -> DataFrame:
        ids, f, _ = matrix(pool)
        order, _, _ = pareto.select_survivors(f, self.pop_size)
        rows = engine.keep(renumbered(pool, [ids[i] for i in order]))
        engine.trim(4)
        return rows

    def first(self, rows: DataFrame) -> tuple[DataFrame, int]:
        ids, f, _ = matrix(rows)
        front = [i for i, r in zip(ids, pareto.ranks(f), strict=True) if r == 1]
        return chosen(rows, front), len(front)

    def recast(self, engine: Engine, rows: DataFrame, change, shift: int) -> DataFrame:
        """Rows whose genome is ``change(csr, extra, labels)``, evaluated by ``engine``; places from ``shift``."""
        decode, evaluate, graph, extra = engine.decode, engine.evaluate, engine.graph, engine.extra

        def work(batches):
            g, more = graph.value, extra.value if extra is not None else None
            for batch in batches:
                out = []
                for _, r in batch.iterrows():
                    genome = np.asarray(change(g, more, np.frombuffer(r["labels"], "<i4")), "<i4")
                    labels = arrays.canonical(decode(g, more, genome)).astype("<i4")
                    out.append([np.int32(r["ind"] + shift), genome.tobytes(), labels.tobytes(), evaluate(g, labels), hashlib.md5(labels.tobytes()).hexdigest()])
                yield pd.DataFrame(out, columns=["ind", "genome", "labels", "f", "canon"])

        return engine.keep(rows.mapInPandas(work, ROWS))


def evolve_swarms(swarms: Swarms, num_gens: int, gap: int, update: Callable, to_bits: Callable, climb: bool) -> tuple[DataFrame, DataFrame]:
    """``update(share, generation)`` blends the elites' agreement into what both engines see."""
    n = swarms.pop_size
    micro = swarms.micro.build(0, {i: [] for i in range(n)}, None)
    macro = swarms.macro.build(0, {i: [] for i in range(n)}, None)
    for gen in range(1, num_gens + 1):
        log.debug("generation %d of %d", gen, num_gens)
        micro_pool = micro.union(swarms.step(swarms.micro, micro, gen, swarms.parents))
        macro_pool = macro.union(swarms.step(swarms.macro, macro, gen, 2))
        if gap and gen % gap == 0:
            elites, _ = swarms.first(macro)
            guides = swarms.recast(swarms.micro, elites, lambda g, more, labels: labels, 2 * n)
            micro = swarms.select(swarms.micro, micro_pool.union(guides))
            if climb:
                ids, f, _ = matrix(micro)
                front = [i for i, r in zip(ids, pareto.ranks(f), strict=True) if r == 1]
                lifted = swarms.recast(swarms.micro, chosen(micro, front), lambda g, more, labels: arrays.climb(g, labels), 3 * n)
                micro = swarms.select(swarms.micro, micro.union(lifted))
            elites, count = swarms.first(micro)
            if count:
                update(agreement(elites, swarms.run.shared, swarms.dense), gen)
                leaders = swarms.recast(swarms.macro, elites, to_bits, 2 * n)
                macro_pool = macro_pool.union(leaders)
            macro = swarms.select(swarms.macro, macro_pool)
        else:
            micro, macro = swarms.select(swarms.micro, micro_pool), swarms.select(swarms.macro, macro_pool)
    return micro, macro


def smocc_pool(graph: Graph, pop_size: int = 100, num_gens: int = 100, cross_rate: float = 0.7, mut_rate: float = 0.5, gap: int = 10, refine: bool = True, topo_mode: int = 130, obj_mode: int = 160, macro_cap: float = 1.0, micro_mut: float = 0.5, seed: int = 0) -> tuple[Run, DataFrame | None, list[int]]:
    """Final partitions and the places of their front (no table for a graph without nodes)."""
    check_sizes(pop_size, num_gens, cross_rate=cross_rate, mut_rate=mut_rate)
    run = Run.start(graph)
    if not run.csr.n:
        return run, None, []
    heaviest, ensemble = topology_operators(topo_mode)
    micro_set, macro_set = objective_sets(obj_mode)
    sc = run.spark.sparkContext
    state = {"w": np.ones(len(run.csr.adj))}
    shared = sc.broadcast(state)  # a number for each directed edge of the broadcast graph
    micro = run.engine(labels_make(cross_rate, micro_mut, ensemble, heaviest), plain_labels, evaluator(micro_set), seed, 1, shared)
    macro = run.engine(bits_make(cross_rate, mut_rate, macro_cap), spread_labels, evaluator(macro_set), seed, 2, shared)
    swarms = Swarms(run, micro, macro, pop_size, 4 if ensemble else 2, False)

    def update(share: np.ndarray, gen: int) -> None:
        rho = 0.5 * gen / max(num_gens, 1)
        state["w"] = (1 - rho) * state["w"] + rho * share
        micro.extra.unpersist()  # what was made with it is stored
        micro.extra = macro.extra = sc.broadcast({"w": state["w"]})

    def to_bits(g, more, labels):
        bits = np.zeros(g.n, int)
        bits[arrays.encode(g, labels, weights_of(more, g))] = 1
        return bits

    own, centres = evolve_swarms(swarms, num_gens, gap, update, to_bits, False)
    keep = lambda g, more, labels: labels
    pool = own.union(swarms.recast(micro, centres, keep, pop_size))
    ids, f, canon = matrix(pool)
    front = first_front(ids, f, canon)
    if refine:
        rows = chosen(pool, front)
        size = 2 * pop_size
        split = swarms.recast(micro, rows, lambda g, more, labels: arrays.split_parts(g, labels), size)
        both = swarms.recast(micro, rows, lambda g, more, labels: arrays.absorb(g, arrays.split_parts(g, labels), weights_of(more, g)), 2 * size)
        absorbed = swarms.recast(micro, rows, lambda g, more, labels: arrays.absorb(g, labels, weights_of(more, g)), 3 * size)
        pool = rows.union(split).union(both).union(absorbed)
        ids, f, canon = matrix(pool)
        front = first_front(ids, f, canon)
    return run, pool, front


def smocc_front(graph: Graph, *args, **params) -> Front:
    """The parameters are those of ``smocc_pool``."""
    run, pool, front = smocc_pool(graph, *args, **params)
    return nothing(run.spark) if pool is None else as_front(pool, front, run.shared)


def label_free_scores(rows: DataFrame, ids: list[int], graph) -> DataFrame:
    """``ind, kkm, rc, intra, inter`` of the given places, evaluated on the executors; isolated nodes stand alone."""

    def score(batches):
        g = graph.value
        for batch in batches:
            out = []
            for ind, raw in zip(batch["ind"], batch["labels"], strict=True):
                labels = np.where(g.deg > 0, np.frombuffer(raw, "<i4"), g.n + np.arange(g.n))
                out.append([ind, *arrays.objective_vector(g, labels, "kkm_rc"), *arrays.objective_vector(g, labels, "intra_inter")])
            yield pd.DataFrame(out, columns=["ind", "kkm", "rc", "intra", "inter"])

    schema = "ind int, kkm double, rc double, intra double, inter double"
    found = chosen(rows, ids).select("ind", "labels").mapInPandas(score, schema).collect()  # a row for each partition of the front
    return rows.sparkSession.createDataFrame(found, schema)


def smocc(graph: Graph, *args, **params) -> DataFrame:
    """The front's partition of least total of its normalised KKM, RC, intra and inter; only that one becomes rows of nodes."""
    run, pool, front = smocc_pool(graph, *args, **params)
    if pool is None:
        return pick(nothing(run.spark), None)
    top = pareto.select_label_free(label_free_scores(pool, front, run.shared)).first()
    return pick(as_front(pool, [top["ind"]], run.shared), 0)


def smocc_fronts(graph: Graph, **params) -> DataFrame:
    return smocc_front(graph, **params).partitions


scale, scale_fronts = smocc, smocc_fronts  # deprecated names


def mmcomo_front(graph: Graph, pop_size: int = 100, num_gens: int = 50, cross_rate: float = 0.1, mut_rate: float = 0.1, gap: int = 10, beta: float = 0.05, seed: int = 0, most_nodes: int = MOST_DENSE) -> Front:
    """Dense similarities of all pairs of nodes are broadcast: 8 bytes each, 32 MB for ``MOST_DENSE`` nodes.

    A caller whose workers have the memory may raise ``most_nodes``; the kernel takes time with its cube.
    """
    check_sizes(pop_size, num_gens, cross_rate=cross_rate, mut_rate=mut_rate)
    if (n := graph.nodes.count()) > most_nodes:
        raise ValueError(f"{n} nodes are more than {most_nodes}, the most of a dense kernel")
    run = Run.start(graph)
    if not run.csr.n:
        return nothing(run.spark)
    sc = run.spark.sparkContext
    state = {"s": arrays.diffusion_kernel(run.csr, beta)}
    shared = sc.broadcast(state)  # most_nodes squared numbers at most
    micro = run.engine(labels_make(cross_rate, 0.0, False, False), plain_labels, evaluator("kkm_rc"), seed, 1, shared)
    macro = run.engine(bits_make(cross_rate, mut_rate, 1.0), nearest_labels, evaluator("kkm_rc"), seed, 2, shared)
    swarms = Swarms(run, micro, macro, pop_size, 2, True)

    def update(share: np.ndarray, gen: int) -> None:
        rho = 0.5 * gen / max(num_gens, 1)
        state["s"] = (1 - rho) * state["s"] + rho * share.reshape(run.csr.n, run.csr.n)
        micro.extra.unpersist()
        micro.extra = macro.extra = sc.broadcast({"s": state["s"]})

    own, centres = evolve_swarms(swarms, num_gens, gap, update, lambda g, more, labels: medoid_bits(g, more["s"], labels), True)
    pool = own.union(swarms.recast(micro, centres, lambda g, more, labels: labels, pop_size))
    ids, f, canon = matrix(pool)
    return as_front(pool, first_front(ids, f, canon), run.shared)


def mmcomo(graph: Graph, **params) -> DataFrame:
    return by_modularity(graph, mmcomo_front(graph, **params))


def mmcomo_fronts(graph: Graph, **params) -> DataFrame:
    return mmcomo_front(graph, **params).partitions


# any graph size


def edge_parallel(graph: Graph, pop_size: int = 20, num_gens: int = 10, cross_rate: float = 0.7, mut_rate: float = 0.5, seed: int = 0) -> DataFrame:
    """The label-based detector as joins alone: ``(node, community)`` of largest modularity.

    Parents win tournaments by rank and crowding, as in ``hpmocd``; mutation follows a snapshot.

    Only objective vectors reach the driver; labels live in scratch tables.
    """
    from coterie.functions.rng import uniform
    from coterie.operators import codec, graph as accessors, objectives, variation
    from coterie.scratch import materialize

    check_sizes(pop_size, num_gens, cross_rate=cross_rate, mut_rate=mut_rate)
    wadj = materialize(codec.unit_weights(graph), "adjacency")
    pop, path = store(variation.random_labels(graph, pop_size, seed), "labels")
    scores = {r["ind"]: r["f"] for r in objectives.evaluate(pop, graph, "intra_inter").collect()}
    spark = graph.nodes.sparkSession
    for gen in range(1, num_gens + 1):
        children = spark.range(pop_size, 2 * pop_size).select(F.col("id").cast("int").alias("child"))
        f = np.array([scores[i] for i in sorted(scores)])
        rank = pareto.ranks(f)
        crowd = pareto.crowding_of(f, rank, 2)
        # a row for each individual
        ranked = spark.createDataFrame([(i, int(r), float(c)) for i, r, c in zip(sorted(scores), rank, crowd, strict=True)], "ind int, rank int, crowd double")
        parents = variation.distinct_parents(pop_size, ranked, children, seed, gen)
        votes = variation.parent_votes(pop, parents)
        crossed = variation.ensemble_majority(votes, seed, gen)
        clone = votes.select("child", "node", F.col("labels")[0].alias("first"))
        coin = uniform(seed, F.lit("cross"), F.lit(gen), F.col("child")) < cross_rate
        mixed = crossed.join(clone, ["child", "node"]).select(F.col("child").alias("ind"), "node", F.when(coin, F.col("label")).otherwise(F.col("first")).alias("label"))
        young, young_path = store(variation.majority_mutation(mixed, wadj, mut_rate, seed, gen), "labels")
        scores |= {r["ind"]: r["f"] for r in objectives.evaluate(young, graph, "intra_inter").collect()}
        ids = sorted(scores)
        order, _, _ = pareto.select_survivors(np.array([scores[i] for i in ids]), pop_size, 2)
        keep = [ids[i] for i in order]
        places = F.broadcast(spark.createDataFrame([(i, k) for k, i in enumerate(keep)], "ind int, new int"))
        after, after_path = store(pop.union(young).join(places, "ind").select(F.col("new").alias("ind"), "node", "label"), "labels")
        drop_path(spark, path)
        drop_path(spark, young_path)
        pop, path, scores = after, after_path, {k: scores[i] for k, i in enumerate(keep)}
        log.debug("generation %d of %d: best sum of objectives %.6f", gen, num_gens, min(map(sum, scores.values())))
    top = max(sorted(scores), key=lambda i: (round(-sum(scores[i]), 12), i)) if scores else -1
    return accessors.normalize(pop.where(F.col("ind") == top).select("node", F.col("label").alias("community")), graph)


def max_cores(n: int) -> bool:
    """Build at most ``n`` individuals at a time from now on; the first call wins.

    Returns whether this call was the first.  ``n`` must be positive.
    """
    if n < 1:
        raise ValueError("n must be positive")
    if _CORES:
        return False
    _CORES.append(n)
    return True


DETECTORS = {f.__name__: f for f in (smocc, hpmocd, mmcomo, ccm, krm, mocd_q, mocd_d, moga_net)}
FRONTS = {f.__name__: f for f in (smocc_fronts, hpmocd_fronts, mmcomo_fronts, ccm_fronts, krm_fronts, moga_net_fronts)}

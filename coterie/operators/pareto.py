"""Pareto operators on ``objs(ind, f array<double>)``, all objectives minimised."""

from __future__ import annotations

from bisect import bisect_right
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dominates(a: Column, b: Column) -> Column:
    """Whether ``a`` is nowhere worse and somewhere better than ``b``."""
    both = F.zip_with(a, b, lambda x, y: F.struct((x <= y).alias("le"), (x < y).alias("lt")))
    return F.forall(both, lambda x: x["le"]) & F.exists(both, lambda x: x["lt"])


def local_front(f: np.ndarray) -> np.ndarray:
    """Whether each row is dominated by none of the others."""
    order = np.lexsort(f.T[::-1])
    kept: list[int] = []
    front = np.zeros((0, f.shape[1]))
    for i in order:
        if not len(front) or not ((front <= f[i]).all(axis=1) & (front < f[i]).any(axis=1)).any():
            kept.append(i)
            front = np.vstack([front, f[i]])
    out = np.zeros(len(f), bool)
    out[kept] = True
    return out


def rank_one(objs: DataFrame) -> DataFrame:
    """The rows that no row dominates.

    Each partition first keeps its own front, batch by batch, then the
    survivors' distinct vectors are compared with each other: what a vector
    dominates in its partition never meets the others.  The join's size is the
    fronts', not the table's; two objectives are better served by ``rank_one_of_two``.
    """

    def locally(batches):
        held = None
        for batch in batches:
            if len(batch):
                held = batch if held is None else pd.concat([held, batch])
                held = held[local_front(np.array(held["f"].tolist(), float))]
        if held is not None:
            yield held

    near = objs.mapInPandas(locally, objs.schema)
    vectors = near.select("f").distinct()
    front = vectors.alias("a").join(vectors.alias("b"), dominates(F.col("b.f"), F.col("a.f")), "left_anti").select("f")
    return near.join(front, "f").select(objs.columns)


def rank_one_of_two(objs: DataFrame) -> DataFrame:
    """``rank_one`` of two objectives by a sorted sweep, without comparing vectors in pairs.

    A vector is on the front if its second objective is below that of all vectors of a smaller first
    one and no larger than that of its equals.  Vectors are collapsed and sorted into ranges; each
    range needs the least second objective of the ranges before it, one number each.
    """
    from coterie.scratch import materialize

    # of each first objective only the least second one can be on the front
    least = objs.groupBy(F.col("f")[0].alias("x")).agg(F.min(F.col("f")[1]).alias("y"))
    sorted_ = materialize(least.sort("x").withColumn("part", F.spark_partition_id()), "front")
    below, seen = [], float("inf")
    for r in sorted(sorted_.groupBy("part").agg(F.min("y").alias("low")).collect()):  # a row for each range
        below.append((r["part"], seen))
        seen = min(seen, r["low"])
    before = F.broadcast(objs.sparkSession.createDataFrame(below, "part int, below double"))
    running = F.min("y").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    front = sorted_.withColumn("low", running).join(before, "part").where(F.col("y") < F.least(F.coalesce("low", F.lit(float("inf"))), "below")).select("x", "y")
    return objs.join(front, (F.col("f")[0] == F.col("x")) & (F.col("f")[1] == F.col("y")), "left_semi")


def ranks(f: np.ndarray) -> np.ndarray:
    """Front number of every row, from 1."""
    return sweep_ranks(f) if f.ndim == 2 and f.shape[1] == 2 else front_ranks(f)


def sweep_ranks(f: np.ndarray) -> np.ndarray:
    """Fronts of two objectives in O(n log n).

    In order of the first objective, a vector's front is the first one whose latest second objective lies
    above its own; those values increase from front to front, so a binary search finds it.
    """
    out = np.zeros(len(f), int)
    if not len(f):
        return out
    vectors, back = np.unique(f, axis=0, return_inverse=True)  # sorted by the first, then the second objective
    latest: list[float] = []
    rank = np.empty(len(vectors), int)
    for i, y in enumerate(vectors[:, 1].tolist()):
        at = bisect_right(latest, y)
        latest[at : at + 1] = [y]
        rank[i] = at + 1
    out[:] = rank[back.reshape(-1)]
    return out


def front_ranks(f: np.ndarray) -> np.ndarray:
    """Fronts of any number of objectives; memory follows the rows, not their pairs.

    In sorted order nothing dominates what came before it, and a vector's front is the first one that
    does not dominate it; fronts are searched by halves, as each dominates what the next one does.
    """
    out = np.zeros(len(f), int)
    if not len(f):
        return out
    vectors, back = np.unique(f, axis=0, return_inverse=True)
    fronts: list[np.ndarray] = []
    sizes: list[int] = []
    rank = np.empty(len(vectors), int)
    for i, v in enumerate(vectors):
        low, high = 0, len(fronts)
        while low < high:
            middle = (low + high) // 2
            if (fronts[middle][: sizes[middle]] <= v).all(axis=1).any():  # distinct, so somewhere better
                low = middle + 1
            else:
                high = middle
        if low == len(fronts):
            fronts.append(np.empty((4, f.shape[1])))
            sizes.append(0)
        if sizes[low] == len(fronts[low]):
            fronts[low] = np.concatenate([fronts[low], np.empty_like(fronts[low])])
        fronts[low][sizes[low]] = v
        sizes[low] += 1
        rank[i] = low + 1
    out[:] = rank[back.reshape(-1)]
    return out


#: Distinct vectors that one task ranks; above, fronts are peeled by jobs.  The ranks are the same.
MOST_VECTORS = 200_000


def non_dominated_sort(objs: DataFrame, most_vectors: int = MOST_VECTORS) -> DataFrame:
    """``ind, f, rank``: every row's front.

    A population's distinct vectors are ranked in one task; more than ``most_vectors`` are peeled front by front.
    """
    from coterie.scratch import materialize

    vectors = materialize(objs.select("f").distinct(), "vectors")
    if vectors.count() <= most_vectors:

        def rank(batches):
            frame = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({"f": []})])
            if len(frame):
                yield pd.DataFrame({"f": frame["f"], "rank": ranks(np.array(frame["f"].tolist(), float)).astype("int32")})

        ranked = vectors.coalesce(1).mapInPandas(rank, "f array<double>, rank int")
        return objs.join(ranked, "f").select(*objs.columns, "rank")
    left, out, rank = materialize(objs, "front"), None, 0
    while not left.isEmpty():
        rank += 1
        front = materialize(rank_one(left), "front")
        here = front.withColumn("rank", F.lit(rank))
        out = here if out is None else out.union(here)
        left = materialize(left.join(front.select("ind"), "ind", "left_anti"), "front")
    return out if out is not None else objs.withColumn("rank", F.lit(0))


def crowding(ranked: DataFrame, objectives: int, small: int = 1) -> DataFrame:
    """``ranked(ind, rank, f)`` with ``crowd``: infinite at the ends of any objective and in groups of up to ``small``."""
    infinite = F.lit(float("inf"))
    group = Window.partitionBy("rank")
    total = None
    frame = ranked.withColumn("__size", F.count("*").over(group))
    for k in range(objectives):
        value = F.col("f")[k]
        order = group.orderBy(value, "ind")
        span = F.max(value).over(group) - F.min(value).over(group)
        before, after = F.lag(value).over(order), F.lead(value).over(order)
        term = F.when(before.isNull() | after.isNull(), infinite).when(span > 0, (after - before) / span).otherwise(0.0)
        frame = frame.withColumn(f"__d{k}", term)
        total = F.col(f"__d{k}") if total is None else total + F.col(f"__d{k}")
    return frame.select(*ranked.columns, F.when(F.col("__size") <= small, infinite).otherwise(total).alias("crowd"))


def crowding_of(f: np.ndarray, rank: np.ndarray, small: int = 1) -> np.ndarray:
    """As ``crowding``, for a population's objective matrix."""
    out = np.zeros(len(f))
    for r in np.unique(rank):
        members = np.flatnonzero(rank == r)
        if len(members) <= small:
            out[members] = np.inf
            continue
        for k in range(f.shape[1]):
            order = members[np.argsort(f[members, k], kind="stable")]
            values = f[order, k]
            out[order[[0, -1]]] = np.inf
            if values[-1] > values[0]:
                out[order[1:-1]] += (values[2:] - values[:-2]) / (values[-1] - values[0])
    return out


def survivors(ranked: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` by rank, larger crowding and number."""
    return ranked.orderBy("rank", F.desc("crowd"), "ind").limit(keep)


def select_survivors(f: np.ndarray, keep: int, small: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, ranks and crowding of the survivors of a population."""
    rank = ranks(f)
    crowd = crowding_of(f, rank, small)
    order = np.lexsort((np.arange(len(f)), -crowd, rank))[:keep]
    return order, rank[order], crowd[order]


def simplex_points(m: int, divisions: int) -> np.ndarray:
    """All points of ``m`` multiples of ``1 / divisions`` that sum to one."""
    bars = combinations(range(divisions + m - 1), m - 1)
    rows = [np.diff([-1, *b, divisions + m - 1]) - 1 for b in bars]
    return np.array(rows, float) / divisions


def das_dennis(spark: SparkSession, m: int, divisions: int) -> DataFrame:
    """``point array<double>`` of the simplex lattice."""
    found = spark.range(1).select(F.array().cast("array<bigint>").alias("p"), F.lit(divisions).cast("long").alias("left"))
    for _ in range(m - 1):
        found = found.select("p", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("left"))).alias("x")).select(F.concat("p", F.array("x")).alias("p"), (F.col("left") - F.col("x")).alias("left"))
    return found.select(F.transform(F.concat("p", F.array("left")), lambda x: x / F.lit(float(divisions))).alias("point"))


def perpendicular(f: Column, direction: Column) -> Column:
    """Distance of a point from the line through the origin along ``direction``."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(dot(f, f) - F.pow(dot(f, direction), 2) / dot(direction, direction), F.lit(0.0)))


def associate(objs: DataFrame, points: DataFrame, ideal: list[float], intercepts: list[float]) -> DataFrame:
    """``ind, point, distance``: each normalised vector's nearest reference line (the least point on ties).

    ``points`` is a lattice of a few hundred rows at most.
    """
    norm = F.array(*[(F.col("f")[k] - ideal[k]) / (intercepts[k] if intercepts[k] else 1.0) for k in range(len(ideal))])
    near = objs.select("ind", norm.alias("z")).crossJoin(F.broadcast(points)).select("ind", "point", F.round(perpendicular(F.col("z"), F.col("point")), 12).alias("distance"))
    return near.groupBy("ind").agg(F.min(F.struct("distance", "point")).alias("best")).select("ind", "best.point", "best.distance")


def intercepts(f: np.ndarray, ideal: np.ndarray) -> np.ndarray:
    """Where the plane through the extreme points cuts the axes; the largest values if it does not."""
    shifted, m = f - ideal, f.shape[1]
    weights = np.where(np.eye(m, dtype=bool), 1.0, 1e-6)
    extreme = shifted[[int(np.argmin((shifted / w).max(axis=1))) for w in weights]]
    worst = shifted.max(axis=0)
    try:
        plane = np.linalg.solve(extreme, np.ones(m))
        cut = 1 / plane
        if not np.isfinite(cut).all() or (cut <= 1e-12).any():
            cut = worst
    except np.linalg.LinAlgError:
        cut = worst
    return np.where(cut > 1e-12, cut, 1.0)


def reference_selection(f: np.ndarray, keep: int, points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """NSGA-III survivors: whole fronts, then the reference lines with fewest members choose from the front that splits."""
    rank = ranks(f)
    counts = np.cumsum(np.bincount(rank)[1:])
    last = int(np.searchsorted(counts, keep)) + 1
    chosen = np.flatnonzero(rank < last).tolist()
    if len(chosen) == keep:
        return np.array(chosen)
    split = np.flatnonzero(rank == last)
    if len(chosen) + len(split) == keep:
        return np.array([*chosen, *split])
    pool = np.array([*chosen, *split])
    ideal = f[pool].min(axis=0)
    z = (f[pool] - ideal) / intercepts(f[pool], ideal)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    along = z @ unit.T
    distance = np.sqrt(np.maximum((z**2).sum(axis=1)[:, None] - along**2, 0))
    nearest, off = distance.argmin(axis=1), distance.min(axis=1)
    crowd = np.bincount(nearest[: len(chosen)], minlength=len(points))
    waiting: dict[int, list[int]] = {}
    for j in range(len(chosen), len(pool)):
        waiting.setdefault(int(nearest[j]), []).append(j)
    while len(chosen) < keep:
        lines = np.array(sorted(waiting))
        line = int(rng.choice(lines[crowd[lines] == crowd[lines].min()]))
        group = waiting[line]
        j = min(group, key=lambda x: off[x]) if crowd[line] == 0 else group[int(rng.integers(len(group)))]
        group.remove(j)
        if not group:
            del waiting[line]
        crowd[line] += 1
        chosen.append(int(pool[j]))
    return np.array(chosen)


def grid_cells(objs: DataFrame, objectives: int, divisions: int = 8) -> DataFrame:
    """``ind, f, cell, occupancy``: hyper-grid cells over the range of the table."""
    bounds = objs.agg(*[F.min(F.col("f")[k]).alias(f"lo{k}") for k in range(objectives)], *[F.max(F.col("f")[k]).alias(f"hi{k}") for k in range(objectives)])

    def place(k: int) -> Column:
        span = F.col(f"hi{k}") - F.col(f"lo{k}")
        return F.when(span > 0, F.least(F.floor((F.col("f")[k] - F.col(f"lo{k}")) / span * divisions), F.lit(divisions - 1))).otherwise(0).cast("int")

    placed = objs.crossJoin(F.broadcast(bounds)).select("ind", "f", F.array(*[place(k) for k in range(objectives)]).alias("cell"))
    return placed.join(placed.groupBy("cell").agg(F.count("*").alias("occupancy")), "cell").select("ind", "f", "cell", "occupancy")


def archive_insert(archive: DataFrame, new: DataFrame) -> DataFrame:
    """The front of both; equal vectors all stay."""
    return rank_one(archive.unionByName(new))


def cells_of(f: np.ndarray, divisions: int = 8) -> list[tuple[int, ...]]:
    low, high = f.min(axis=0), f.max(axis=0)
    span = np.where(high > low, high - low, 1.0)
    return [tuple(x) for x in np.minimum((f - low) / span * divisions, divisions - 1).astype(int).tolist()]


def squeeze(f: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Places that stay when a random member of the fullest cell goes until ``capacity`` fit; the grid follows each time."""
    kept = np.arange(len(f))
    while len(kept) > capacity:
        cells = cells_of(f[kept])
        count: dict = {}
        for c in cells:
            count[c] = count.get(c, 0) + 1
        fullest = max(sorted(count), key=count.__getitem__)
        members = [i for i, c in enumerate(cells) if c == fullest]
        kept = np.delete(kept, members[int(rng.integers(len(members)))])
    return kept


def max_min_distance(solutions: DataFrame, controls: DataFrame) -> DataFrame:
    """One row ``ind, distance``: the solution farthest from its nearest control vector (first on ties)."""
    gap = F.sqrt(F.aggregate(F.zip_with("s.f", "c.f", lambda a, b: F.pow(a - b, 2)), F.lit(0.0), lambda t, x: t + x))
    near = solutions.alias("s").crossJoin(controls.select("f").distinct().alias("c")).groupBy("s.ind").agg(F.min(gap).alias("distance"))
    return near.orderBy(F.desc("distance"), "ind").limit(1)


def select_max(objs: DataFrame, score: Column) -> DataFrame:
    """The row of largest score, the last on ties."""
    return objs.withColumn("score", score).orderBy(F.desc("score"), F.desc("ind")).limit(1)


def select_min(objs: DataFrame, score: Column) -> DataFrame:
    """The row of least score, the first on ties."""
    return objs.withColumn("score", score).orderBy("score", "ind").limit(1)


def select_label_free(front: DataFrame, columns: tuple[str, ...] = ("kkm", "rc", "intra", "inter")) -> DataFrame:
    """The row of least total of min-max normalised columns; a constant column adds nothing."""
    bounds = front.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    part = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0)
    return select_min(front.crossJoin(F.broadcast(bounds)), sum((part(c) for c in columns[1:]), part(columns[0]))).select(*front.columns, "score")


def scores_against(front: DataFrame, truth: DataFrame) -> DataFrame:
    """``ind, nmi, ari`` of every partition of ``front(ind, node, label)`` over the nodes it shares with ``truth``.

    Edges as in ``metrics``: NMI is 1 if both entropies are 0, ARI is 1 if its denominator vanishes and for one node.
    """
    cells = front.join(truth.select("node", F.col("community").alias("b")), "node").groupBy("ind", F.col("label").alias("a"), "b").agg(F.count("*").alias("nij"))
    double = lambda c: F.col(c).cast("double")
    pairs = lambda x: x * (x - 1) / 2

    def side(by: str, entropy: str, pair: str) -> DataFrame:
        # with n = sum x: entropy = ln n - sum x ln x / n
        sizes = cells.groupBy("ind", by).agg(F.sum("nij").cast("double").alias("x")).groupBy("ind")
        return sizes.agg(F.sum("x").alias(f"n_{by}"), F.sum(F.col("x") * F.log("x")).alias(entropy), F.sum(pairs(F.col("x"))).alias(pair))

    inner = cells.groupBy("ind").agg(F.sum(double("nij") * F.log(double("nij"))).alias("l_ab"), F.sum(pairs(double("nij"))).alias("tp"))
    one = inner.join(side("a", "l_a", "pa"), "ind").join(side("b", "l_b", "pb"), "ind")
    n = F.col("n_a")
    entropy = lambda c: F.log(n) - F.col(c) / n
    mean, mutual = (entropy("l_a") + entropy("l_b")) / 2, entropy("l_a") + entropy("l_b") - entropy("l_ab")
    expected = F.when(n > 1, F.col("pa") * F.col("pb") / pairs(n)).otherwise(0.0)
    spread = (F.col("pa") + F.col("pb")) / 2 - expected
    nmi = F.when(F.abs(mean) < 1e-12, 1.0).otherwise(mutual / mean)
    return one.select("ind", nmi.alias("nmi"), F.when(F.abs(spread) < 1e-15, 1.0).otherwise((F.col("tp") - expected) / spread).alias("ari"))


def select_best_against(front: DataFrame, truth: DataFrame, score: str = "ari") -> DataFrame:
    """The partition of a front with the largest ``ari`` or ``nmi`` against known communities (first on ties)."""
    if score not in ("ari", "nmi"):
        raise ValueError("score must be ari or nmi")
    return scores_against(front, truth).select("ind", F.round(score, 12).alias("score")).orderBy(F.desc("score"), "ind").limit(1)


def select_target_k(front: DataFrame, target: int) -> DataFrame:
    """The row whose number of communities is nearest to ``target`` (first on ties)."""
    return select_min(front, F.abs(F.col("k") - target))

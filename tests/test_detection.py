"""Detectors held to exact recovery, repetition and quality; operators on partial partitions, large ids and fronts."""

import csv
import itertools
import logging
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.functions.rng import lowest, uniform
from coterie.operators import metrics, objectives, pareto, report, variation
from coterie.plans import arrays, detect
from coterie.sources import graphs, loaders
from test_operators import TRIANGLES, check_partition, graph, labels_of


def cliques(count, size):
    """A ring of cliques, neighbours tied by one edge."""
    edges = [(size * c + a, size * c + b) for c in range(count) for a, b in itertools.combinations(range(size), 2)]
    return edges + [(size * c, size * ((c + 1) % count) + 1) for c in range(count)]


def plain_modularity(edges, partition):
    m, total = len(edges), 0.0
    for c in set(partition.values()):
        inside = sum(partition.get(u) == c == partition.get(v) for u, v in edges)
        degree = sum((partition.get(u) == c) + (partition.get(v) == c) for u, v in edges)
        total += inside / m - (degree / (2 * m)) ** 2
    return total


def test_partitions_of_part_of_a_graph(spark):
    g = graph(spark, TRIANGLES)
    for partition in ({0: 0, 1: 0, 2: 0}, {0: 0, 3: 0, 5: 1}, {n: n // 3 for n in range(6)}, {2: 7}):
        found = objectives.modularity(graphs.partition_from_dict(spark, partition), g).first()
        assert found["q"] == pytest.approx(plain_modularity(TRIANGLES, partition)) and found["m"] == 7
        front = spark.createDataFrame([(0, n, c) for n, c in partition.items()], "ind int, node long, label long")
        assert report.front_scatter(front, g).first()["q"] == pytest.approx(found["q"])
    assert objectives.modularity(graphs.partition_from_dict(spark, {0: 0}), graph(spark, [], [0])).first()["q"] == 0.0


def test_centres_follow_degree_whatever_the_ids(spark):
    far = 10**13
    star = [(far + 50, far + i) for i in range(20)] + [(far + 3, far + i) for i in range(4, 10)] + [(far + 5, far + 1), (2**62, far + 2)]
    g = graph(spark, star)
    degree = {r["node"]: r["deg"] for r in g.deg.collect()}
    order = sorted(degree, key=lambda n: (-degree[n], n))
    drawn = {}
    for r in variation.centres(g, 40, 3).collect():
        drawn.setdefault(r["ind"], []).append(r["node"])
    assert len(drawn) == 40
    for ind, nodes in drawn.items():
        assert len(nodes) == len(set(nodes)) <= math.ceil(math.sqrt(len(degree)))
        if ind < 20:
            assert set(nodes) <= set(order[: 3 * len(nodes)])


def test_lowest_equals_a_sort(spark):
    rows = spark.range(500).selectExpr("id % 3 g", "id", "id % 40 w")
    for buckets in (1, 7, 300):
        got = lowest(rows, ["g"], F.floor(uniform(5, F.col("id")) * 50) / 50, F.col("g") * 40 + 5, ["id"], buckets)
        draws = [(r["g"], r["u"], r["id"]) for r in rows.select("g", "id", (F.floor(uniform(5, F.col("id")) * 50) / 50).alias("u")).collect()]
        want = [x[2] for k in range(3) for x in sorted(d for d in draws if d[0] == k)[: 40 * k + 5]]
        assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_ranks_equal_peeling():
    rng = np.random.default_rng(1)
    for n, m, values in [(0, 2, 5), (1, 2, 5), (60, 2, 6), (80, 3, 4), (50, 4, 3), (70, 2, 1000), (40, 1, 5)]:
        f = rng.integers(values, size=(n, m)).astype(float)
        left, want, number = set(range(n)), np.zeros(n, int), 0
        while left:
            number += 1
            front = {i for i in left if not any((f[j] <= f[i]).all() and (f[j] < f[i]).any() for j in left)}
            want[list(front)] = number
            left -= front
        assert (pareto.ranks(f) == want).all() and (pareto.front_ranks(f) == want).all()


def test_fronts_of_tables(spark):
    rng = random.Random(2)
    for n, values in ((0, 1), (60, 6), (300, 1000)):
        vectors = [(i, [float(rng.randrange(values)), float(rng.randrange(values))]) for i in range(n)]
        objs = spark.createDataFrame(vectors, "ind int, f array<double>").repartition(5)
        beats = lambda a, b: a[0] <= b[0] and a[1] <= b[1] and a != b
        want = {i for i, f in vectors if not any(beats(g, f) for _, g in vectors)}
        assert {r["ind"] for r in pareto.rank_one_of_two(objs).collect()} == want == {r["ind"] for r in pareto.rank_one(objs).collect()}
        ranked = {r["ind"]: r["rank"] for r in pareto.non_dominated_sort(objs).collect()}
        assert n > 60 or ranked == {r["ind"]: r["rank"] for r in pareto.non_dominated_sort(objs, most_vectors=0).collect()}
        assert {i for i, r in ranked.items() if r == 1} == want and len(ranked) == n


def test_expected_mutual_information_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    p, g = ({n: rng.randrange(k) for n in range(300)} for k in (2, 5))
    tables = [graphs.partition_from_dict(spark, x) for x in (p, g)]
    whole = metrics.all_metrics(*tables).first()
    monkeypatch.setattr(metrics, "BLOCK", 7)
    cut = metrics.all_metrics(*tables).first()
    assert cut["emi"] == pytest.approx(whole["emi"], rel=1e-9)
    n, lf = 300, lambda x: math.lgamma(x + 1)
    sizes = [[list(x.values()).count(c) for c in set(x.values())] for x in (p, g)]
    want = 0.0
    for a in sizes[0]:
        for b in sizes[1]:
            for x in range(max(1, a + b - n), min(a, b) + 1):
                want += x / n * math.log(n * x / (a * b)) * math.exp(lf(a) + lf(b) + lf(n - a) + lf(n - b) - lf(n) - lf(x) - lf(a - x) - lf(b - x) - lf(n - a - b + x))
    assert whole["emi"] == pytest.approx(want, rel=1e-9)


def test_selection_against_known_communities(spark):
    g, truth = loaders.karate_club(spark)
    members = {r["node"]: r["community"] for r in truth.collect()}
    rows = [(0, n, 0) for n in members] + [(1, n, n % 2) for n in members] + [(2, n, c + 5 if n != 9 else 5) for n, c in members.items()] + [(3, n, n) for n in members]
    front = spark.createDataFrame(rows, "ind int, node long, label long")
    for r in pareto.scores_against(front, truth).collect():
        own = front.where(F.col("ind") == r["ind"]).select("node", F.col("label").alias("community"))
        want = metrics.all_metrics(own, truth).select("nmi", "ari").first()
        assert (r["nmi"], r["ari"]) == (pytest.approx(want["nmi"], abs=1e-9), pytest.approx(want["ari"], abs=1e-9))
    assert pareto.select_best_against(front, truth, "ari").first()["ind"] == 2 == pareto.select_best_against(front, truth, "nmi").first()["ind"]
    with pytest.raises(ValueError):
        pareto.select_best_against(front, truth, "f1")


@pytest.mark.parametrize("name", ["hpmocd", "smocc", "krm", "ccm", "mocd_q", "moga_net", "mmcomo"])
def test_exact_recovery_of_two_cliques(spark, name):
    edges = [*itertools.combinations(range(5), 2), *itertools.combinations(range(5, 10), 2), (4, 5)]
    found = detect.DETECTORS[name](graph(spark, edges, [20]), pop_size=30, num_gens=6, seed=2)
    assert labels_of(found, "community") == [0] * 5 + [1] * 5 + [-1]


def test_quality_on_the_karate_club(spark):
    g, truth = loaders.karate_club(spark)
    faction = objectives.modularity(truth, g).first()["q"]
    assert faction == pytest.approx(0.358234714003945, abs=1e-12)
    for name in ("smocc", "hpmocd"):
        found = detect.DETECTORS[name](g, pop_size=30, num_gens=8, gap=4, seed=1) if name == "smocc" else detect.hpmocd(g, pop_size=40, num_gens=12, seed=1)
        check_partition(found, g)
        assert objectives.modularity(found, g).first()["q"] > 0.25
        assert list(metrics.gt_metrics(found, found).first()) == pytest.approx([1.0] * 4)


def test_ring_of_cliques_and_repetition(spark):
    g = graph(spark, cliques(8, 5))
    runs = [sorted(map(tuple, detect.smocc_fronts(graphs.Graph(g.nodes.repartition(k), g.edges.repartition(k)), pop_size=20, num_gens=3, gap=1, seed=9).collect())) for k in (1, 5)]
    assert runs[0] == runs[1]
    q = objectives.modularity(detect.smocc(g, pop_size=30, num_gens=4, gap=2, seed=1), g).first()["q"]
    assert q > 0.6  # the cliques themselves: 0.784


def test_smocc_scores_its_front_as_the_relational_side_and_expands_one_partition(spark, monkeypatch):
    g = graph(spark, cliques(4, 4), [90, 91])
    params = {"pop_size": 8, "num_gens": 1, "gap": 1, "seed": 2}
    front = detect.smocc_front(g, **params).partitions
    label = F.when(F.col("community") < 0, -1 - F.col("node")).otherwise(F.col("community"))
    objs = objectives.objectives(front.select(F.col("sol_id").alias("ind"), "node", label.alias("label")), g)
    run, pool, ids = detect.smocc_pool(g, **params)
    assert len(ids) > 1
    found = {ids.index(r["ind"]): [r["kkm"], r["rc"], r["intra"], r["inter"]] for r in detect.label_free_scores(pool, ids, run.shared).collect()}
    assert found == {r["ind"]: pytest.approx([r["kkm"], r["rc"], r["intra"], r["inter"]], abs=1e-9) for r in objs.collect()}
    expanded, as_front = [], detect.as_front
    monkeypatch.setattr(detect, "as_front", lambda rows, places, graph: expanded.append(len(places)) or as_front(rows, places, graph))
    top = pareto.select_label_free(objs).first()["ind"]
    assert labels_of(detect.smocc(g, **params), "community") == labels_of(front.where(F.col("sol_id") == top), "community")
    assert expanded == [1]


def test_complete_graph_and_old_names(spark):
    complete = graph(spark, list(itertools.combinations(range(6), 2)))
    for f in (detect.smocc, detect.scale):
        assert {r["node"] for r in f(complete, pop_size=10, num_gens=2, seed=3).collect()} == set(range(6))
    assert detect.scale_fronts(complete, pop_size=6, num_gens=1).select("sol_id").distinct().count() >= 1


def test_stepwise_mutation_is_a_parameter_at_any_size(spark):
    g = graph(spark, cliques(30, 6))  # 180 nodes
    for stepwise in (False, True):
        check_partition(detect.hpmocd(g, pop_size=8, num_gens=2, seed=1, stepwise=stepwise), g)


def test_custom_objectives_see_graph_and_partition(spark):
    g = graph(spark, [(10**12 + a, 10**12 + b) for a, b in TRIANGLES])

    def crossing(view, partition):
        assert set(view.nodes()) == set(partition) and len(view.edges()) == 7
        node = view.nodes()[0]
        assert view.degree(node) == len(view.neighbors(node))
        with pytest.raises(KeyError):
            view.degree(5)
        return sum(partition[u] != partition[v] for u, v in view.edges())

    found = detect.hpmocd(g, pop_size=16, num_gens=4, seed=1, objectives=[crossing, lambda view, partition: -len(set(partition.values()))])
    check_partition(found, g)


def test_tournament_parents_prefer_the_front(spark):
    ranked = spark.createDataFrame([(i, 1 if i < 10 else 5, 1.0) for i in range(40)], "ind int, rank int, crowd double")
    children = spark.range(200).selectExpr("cast(id as int) child")
    parents = [r["parents"] for r in variation.distinct_parents(40, ranked, children, 1, 1).collect()]
    assert all(len(set(p)) == 4 for p in parents) and sum(x < 10 for p in parents for x in p) > 1.5 * 0.25 * 800
    few = spark.createDataFrame([(0, 1, 1.0), (1, 1, 1.0)], "ind int, rank int, crowd double")
    assert all(sorted(r["parents"]) == [0, 1] for r in variation.distinct_parents(2, few, children, 1, 1).collect())


def test_logging_and_cores(spark, caplog, monkeypatch):
    monkeypatch.setattr(detect, "_CORES", [])
    assert detect.max_cores(2) and not detect.max_cores(4) and detect._CORES == [2]
    with pytest.raises(ValueError):
        detect.max_cores(0)
    with caplog.at_level(logging.DEBUG, logger="coterie"):
        detect.hpmocd(graph(spark, TRIANGLES), pop_size=4, num_gens=2)
    assert sum("generation" in r.getMessage() for r in caplog.records) == 2


def test_result_sink_and_pruning(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    for seed in (1, 2):  # the second sink appends
        sink = loaders.ResultSink(path)
        sink.write({"alg": "smocc", "kind": "lfr", "n_cfg": 1000, "mu": 0.3, "seed": seed, "_n": 1000}, "ok" if seed == 1 else "timeout", nmi=0.5)
        sink.close()
    with open(path, newline="") as f:
        rows = list(csv.DictReader(f))
    assert [(r["alg"], r["seed"], r["status"], r["nmi"], r["net"]) for r in rows] == [("smocc", "1", "ok", "0.5", ""), ("smocc", "2", "timeout", "0.5", "")] and all(r["stamp"] for r in rows)
    with pytest.raises(ValueError):
        loaders.ResultSink(path).write({"alg": "x"}, "ok", unknown=1)
    done = loaders.read_results(spark, path)
    tasks = spark.createDataFrame([("smocc", "1000", "1"), ("smocc", "1000", "3")], "alg string, n_cfg string, seed string")
    assert [r["seed"] for r in report.resume(tasks, done, ["alg", "n_cfg", "seed"]).collect()] == ["3"]
    loaders.write_results(done.select("alg", "status"), str(tmp_path / "csv"))
    assert loaders.read_results(spark, str(tmp_path / "csv")).where("status = 'ok' and alg = 'smocc'").count() == 1
    runs = spark.createDataFrame([("a", 10, "ok"), ("a", 20, "timeout"), ("a", 40, "timeout"), ("b", 5, "error")], "family string, n int, status string")
    todo = spark.createDataFrame([("a", 20), ("a", 30), ("b", 99), ("c", 1)], "family string, n int")
    assert {(r["family"], r["n"]): r["skipped"] for r in report.prune_timeouts(todo, runs).collect()} == {("a", 20): False, ("a", 30): True, ("b", 99): False, ("c", 1): False}


def test_partitions_from_and_to_python(spark, tmp_path):
    labels = {5: 1, 7: 1, 2**50: -1}
    table = graphs.partition_from_dict(spark, labels)
    assert graphs.to_dict(table) == labels and graphs.to_dict(graphs.partition_from_dict(spark, {})) == {}
    (tmp_path / "l.txt").write_text("1 3\n2 3\n")
    assert graphs.to_dict(loaders.read_labels(spark, str(tmp_path / "l.txt"))) == {1: 3, 2: 3}


def test_stepwise_majority_equals_one_snapshot_per_node():
    edges = cliques(5, 4)
    csr = arrays.Csr.build(np.arange(20), np.array([min(e) for e in edges]), np.array([max(e) for e in edges]))
    rng = np.random.default_rng(5)
    for weights in (None, rng.integers(1, 4, len(csr.adj)).astype(float)):
        labels = rng.integers(5, size=20)
        want = labels.copy()
        for u in range(20):
            want[u] = arrays.majority(csr, want, np.array([u]), weights)[u]
        assert (arrays.majority(csr, labels, np.arange(20), weights, stepwise=True) == want).all()


def test_macro_crossover_bit_by_bit(spark):
    g = graph(spark, cliques(6, 5), [40, 41])
    nodes = [r["node"] for r in g.nodes.collect()]
    rng = random.Random(6)
    parents = [[(c, n) for c in range(4) for n in nodes if rng.random() < 0.2 and c != 3] + [(3, 1)] * (i == 0) for i in range(2)]
    a, b = (spark.createDataFrame(x, "child int, node long") for x in parents)
    for rate in (0.0, 0.1, 1.0):
        got = {(r["child"], r["node"]) for r in variation.macro_crossover(a, b, g.nodes, rate, 1, 2).collect()}
        draws = spark.range(4).selectExpr("cast(id as int) child").crossJoin(g.nodes)
        u = lambda what: uniform(1, F.lit(what), F.lit(2), F.col("child"), F.col("node"))
        want = set()
        for r in draws.select("child", "node", u("side").alias("side"), u("flip").alias("flip")).collect():
            bit = (r["child"], r["node"]) in parents[r["side"] >= 0.5]
            if bit != (r["flip"] < rate):
                want.add((r["child"], r["node"]))
        bare = set(range(4)) - {c for c, _ in want}
        assert {x for x in got if x[0] not in bare} == want and all(sum(c == x for c, _ in got) == 1 for x in bare)


def test_array_routines(spark):
    edges = cliques(4, 4)
    n = 16
    csr = arrays.Csr.build(np.arange(n), np.array([min(e) for e in edges]), np.array([max(e) for e in edges]))
    kernel = arrays.diffusion_kernel(csr, 0.1)
    assert np.allclose(kernel, kernel.T) and (kernel > 0).all() and np.allclose(arrays.diffusion_kernel(csr, 0.0), np.eye(n))
    climbed = arrays.climb(csr, np.arange(n))
    q = lambda labels: plain_modularity(edges, dict(enumerate(labels.tolist())))
    assert q(climbed) > q(np.arange(n)) and q(climbed) == pytest.approx(q(np.arange(n) // 4), abs=0.1)
    rng = np.random.default_rng(3)
    f = rng.random((60, 3))
    kept = pareto.squeeze(f, 20, rng)
    assert len(kept) == len(set(kept.tolist())) == 20
    chosen = pareto.reference_selection(f, 25, pareto.simplex_points(3, 4), rng)
    assert len(set(chosen.tolist())) == 25 and set(np.flatnonzero(pareto.ranks(f) == 1).tolist()) <= set(chosen.tolist()) or (pareto.ranks(f) == 1).sum() > 25
    cut = pareto.intercepts(np.array([[2.0, 0.0], [0.0, 4.0], [1.0, 1.0]]), np.zeros(2))
    assert cut == pytest.approx([2.0, 4.0])

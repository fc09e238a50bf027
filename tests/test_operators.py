"""Relational operators against small exact cases and array-side brute force."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.functions.rng import check_probability
from coterie.functions.scalars import centre_ceiling, ln_factorial, node_rate, objective_sets, topology_operators
from coterie.operators import codec, graph as accessors, metrics, objectives, pareto, report, variation
from coterie.plans import arrays, detect
from coterie.sources import graphs, loaders
from coterie.sources.graphs import Graph

TRIANGLES = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]


def graph(spark, edges, nodes=()):
    return Graph.from_tables(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "node long"))


def pop(spark, *labels):
    return spark.createDataFrame([(i, n, c) for i, row in enumerate(labels) for n, c in enumerate(row)], "ind int, node long, label long")


def part(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "node long, community long")


def labels_of(df, key="label"):
    return [r[key] for r in df.orderBy("node").collect()]


@pytest.fixture(scope="module")
def triangles(spark):
    return graph(spark, TRIANGLES)


def test_ingestion_rules(spark):
    g = graph(spark, [(0, 1), (1, 0), (0, 1), (0, 2), (1, 2), (2, 2), (5, None)], [3])
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1), (0, 2), (1, 2)]
    assert {r["node"]: r["deg"] for r in g.deg.collect()} == {0: 2, 1: 2, 2: 2, 3: 0}
    assert g.add_edges(spark.createDataFrame([(3, 0), (1, 0)], "src long, dst long")).edges.count() == 4
    empty = graph(spark, [])
    assert accessors.stats(empty).first()["m"] == 0 and graphs.dense_ids(empty.nodes).count() == 0

    class Nx:
        nodes = staticmethod(lambda: [0, 1, 7])
        edges = staticmethod(lambda: [(0, 1, {"weight": 3})])

    class Ig:
        vs = [type("V", (), {"index": i}) for i in range(3)]
        get_edgelist = staticmethod(lambda: [(0, 2)])

    assert Graph.from_python(spark, Nx()).nodes.count() == 3 and Graph.from_python(spark, Ig()).edges.count() == 1
    with pytest.raises(ValueError):
        Graph.from_python(spark, object())


def test_objectives_of_two_triangles(spark, triangles):
    p = pop(spark, [0, 0, 0, 1, 1, 1], [0] * 6, list(range(6)))
    split, one, single = sorted(objectives.objectives(p, triangles).collect(), key=lambda r: r["ind"])
    assert split["kkm"] == pytest.approx(4) and split["rc"] == pytest.approx(2 / 3) and split["q"] == pytest.approx(6 / 7 - 1 / 2)
    assert one["rc"] == 0 and one["q"] == pytest.approx(0) and single["kkm"] == 0
    scores = {r["ind"]: r for r in objectives.community_score(p, triangles, r=2).collect()}
    assert scores[0]["cs"] == pytest.approx(16 / 3) and scores[2]["cf"] == 0 and scores[1]["cf"] > scores[0]["cf"]


def test_both_sides_agree_on_objectives(spark):
    g, _ = loaders.planted_partition(spark, 60, 4, 5.0, 0.3, 3)
    csr = detect.load(g)
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 6, 60).tolist() for _ in range(3)]
    for name in objectives.SETS:
        found = {r["ind"]: r["f"] for r in objectives.evaluate(pop(spark, *rows), g, name, 1.5, 0.8).collect()}
        for i, row in enumerate(rows):
            assert found[i] == pytest.approx(arrays.objective_vector(csr, np.array(row), name, 1.5, 0.8))
    with pytest.raises(ValueError):
        objectives.evaluate(pop(spark, rows[0]), g, "none")


def test_karate(spark):
    g, truth = loaders.karate_club(spark)
    assert g.nodes.count() == 34 and g.edges.count() == 78
    assert objectives.modularity(truth, g).first()["q"] == pytest.approx(0.358234714003945, abs=1e-12)


CASES = [
    ([0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 2, 2], {"ari": 8 / 33, "f1": 4 / 9, "h_a": math.log(2), "h_b": math.log(3)}),
    ([0, 0, 1, 1, 2, 2, 3, 3], [1, 1, 0, 0, 3, 3, 2, 2], {"nmi": 1, "ami": 1, "ari": 1, "f1": 1, "mi": math.log(4)}),
    ([0, 1, 0, 1, 0, 1, 0, 1], [0, 0, 1, 1, 2, 2, 3, 3], {"mi": 0, "f1": 0}),
    ([0] * 6, list(range(6)), {"nmi": 0, "ami": 0, "ari": 0, "f1": 0}),
    ([0] * 3, [5] * 3, {"nmi": 1, "ami": 1, "f1": 1}),
    ([0], [4], {"ari": 1}),
]


@pytest.mark.parametrize("a, b, want", CASES)
def test_metrics(spark, a, b, want):
    row = metrics.all_metrics(part(spark, a), part(spark, b)).first()
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-9), name


def test_metrics_below_chance_and_without_overlap(spark):
    row = metrics.gt_metrics(part(spark, [0, 1, 2, 0, 1, 2, 0, 1, 2, 0]), part(spark, [0, 0, 0, 1, 1, 1, 2, 2, 2, 2])).first()
    assert row["ami"] < 0 and row["ari"] < 0
    none = part(spark, [0, 1]).where("false")
    assert list(metrics.gt_metrics(none, none).first()) == [0.0] * 4
    assert [metrics.metric(m, none, none).first()[0] for m in ("nmi", "ami", "ari", "f1")] == [1.0, 1.0, 0.0, 1.0]


def test_scalars(spark):
    row = spark.range(200).select("id", ln_factorial(F.col("id")).alias("x")).collect()
    assert all(r["x"] == pytest.approx(math.lgamma(r["id"] + 1), abs=1e-9) for r in row)
    assert [centre_ceiling(n, c) for n, c in ((100, 1.0), (100, float("nan")), (100, 99.0), (1, 0.0))] == [10, 10, 100, 1]
    assert node_rate(0, 50) == 0.02 and node_rate(2, 5) == 1.0
    assert objective_sets(160) == ("intra_inter", "kkm_rc") and objective_sets(6) == ("intra_inter",) * 2 and objective_sets(1006) == ("kkm_rc", "intra_inter") and objective_sets(99) == ("kkm_rc",) * 2
    assert topology_operators(130) == (True, True) and topology_operators(125) == (False, False)
    with pytest.raises(ValueError):
        check_probability(1.5)


def objs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "ind int, f array<double>")


def test_pareto(spark):
    rows = objs(spark, [(1, 4), (2, 2), (4, 1), (3, 3)])
    assert sorted(r["ind"] for r in pareto.rank_one(rows).collect()) == [0, 1, 2]
    ranked = pareto.non_dominated_sort(rows)
    assert {r["ind"]: r["rank"] for r in ranked.collect()} == {0: 1, 1: 1, 2: 1, 3: 2}
    crowd = {r["ind"]: r["crowd"] for r in pareto.crowding(ranked, 2).collect()}
    assert crowd[0] == crowd[2] == math.inf and math.isfinite(crowd[1])
    assert [r["ind"] for r in pareto.survivors(pareto.crowding(ranked, 2), 3).collect()] == [0, 2, 1]
    same = objs(spark, [(1, 2), (1, 2), (0.5, 3)])
    assert pareto.rank_one(same).count() == 3
    assert pareto.ranks(np.array([[0, 0], [1, 1], [2, 2.0]])).tolist() == [1, 2, 3]
    assert pareto.das_dennis(spark, 3, 12).count() == 91 == len(pareto.simplex_points(3, 12)) and len(pareto.simplex_points(2, 4)) == 5
    assert pareto.non_dominated_sort(rows.where("false")).count() == 0


def test_array_and_table_pareto_agree(spark):
    rng = np.random.default_rng(5)
    f = rng.integers(0, 6, (60, 3)).astype(float)
    rank = pareto.ranks(f)
    got = {r["ind"]: r for r in pareto.crowding(pareto.non_dominated_sort(objs(spark, f)), 3).collect()}
    assert [got[i]["rank"] for i in range(60)] == rank.tolist()
    assert [got[i]["crowd"] for i in range(60)] == pytest.approx(pareto.crowding_of(f, rank).tolist())
    kept = pareto.reference_selection(f, 20, pareto.simplex_points(3, 4), rng)
    assert len(set(kept.tolist())) == 20 and set(np.flatnonzero(rank == 1)[:20].tolist()) & set(kept.tolist())
    assert len(pareto.squeeze(f, 7, rng)) == 7


def test_codecs(spark, triangles):
    locus = spark.createDataFrame([(0, i, t) for i, t in enumerate([1, 2, 0, 4, 5, 3])], "ind int, node long, target long")
    assert labels_of(codec.decode_locus(locus)) == [0, 0, 0, 3, 3, 3]
    w = codec.unit_weights(triangles)
    p = pop(spark, [0, 0, 0, 1, 1, 1])
    assert sorted((r["label"], r["node"]) for r in codec.encode_centres(p, w).collect()) == [(0, 0), (1, 3)]
    path = graph(spark, [(i, i + 1) for i in range(30)])
    centre = spark.createDataFrame([(0, 0)], "ind int, node long")
    assert set(labels_of(codec.propagate(centre, path, codec.unit_weights(path)))) == {0}
    two = graph(spark, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)])
    assert labels_of(codec.split_components(pop(spark, [0] * 6), two)) == [0, 0, 0, 3, 3, 3]
    assert labels_of(codec.propagate(centre, two, codec.unit_weights(two))) == [0, 0, 0, 3, 3, 3]
    half = codec.consensus_weights(w, p, 0.5)
    assert {(r["u"], r["v"]): r["w"] for r in half.collect()}[2, 3] == 0.5
    assert codec.consensus_weights(w, p.where("false"), 0.5).count() == w.count()


@pytest.fixture
def plain_plans(spark):
    """Many rounds over few rows: plans without adaptive steps and compiled stages start faster."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_propagation_ends_between_nodes_that_want_each_others_label(spark, plain_plans):
    odd = [r["id"] for r in spark.range(2, 20).where(F.pmod(F.xxhash64("id"), F.lit(2)) == 1).collect()]
    a, b = odd[:2]
    g = graph(spark, [(0, a), (a, b), (1, b)])
    w = g.adj.withColumn("w", F.when(F.col("u").isin(a, b) & F.col("v").isin(a, b), 3.0).otherwise(1.0))
    got = {r["node"]: r["label"] for r in codec.propagate(spark.createDataFrame([(0, 0), (0, 1)], "ind int, node long"), g, w).collect()}
    assert got[0] == 0 and got[1] == 1 and got[a] == got[b]


def test_propagation_that_is_not_settled_raises(spark, plain_plans):
    short = graph(spark, [(i, i + 1) for i in range(9)])
    with pytest.raises(RuntimeError):
        codec.propagate(spark.createDataFrame([(0, 0)], "ind int, node long"), short, codec.unit_weights(short), 6)


def test_propagation_spreads_over_a_long_path(spark, plain_plans):
    path = graph(spark, [(i, i + 1) for i in range(199)])
    assert set(labels_of(codec.propagate(spark.createDataFrame([(0, 0)], "ind int, node long"), path, codec.unit_weights(path)))) == {0}


def test_tiny_communities_follow_the_heavier_edge(spark):
    g = graph(spark, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 6), (3, 6)])
    p = pop(spark, [0, 0, 0, 3, 3, 3, 6])
    for heavy, want in (((3, 6), 3), ((2, 6), 0)):
        w = g.adj.withColumn("w", F.when((F.least("u", "v") == heavy[0]) & (F.greatest("u", "v") == heavy[1]), 5.0).otherwise(1.0))
        assert labels_of(codec.absorb_tiny(p, w))[6] == want
        csr = detect.load(g)
        weights = np.where((np.minimum(csr.rows(), csr.adj) == heavy[0]) & (np.maximum(csr.rows(), csr.adj) == heavy[1]), 5.0, 1.0)
        assert arrays.absorb(csr, np.array([0, 0, 0, 3, 3, 3, 6]), weights)[6] == want


def test_absorbing_takes_time_with_the_graph_not_with_communities_times_nodes():
    n, pairs = 400_000, np.arange(0, 200_000, 2)  # half of the nodes are isolated
    g = arrays.Csr.build(np.arange(n), pairs, pairs + 1)
    began = time.monotonic()
    found = arrays.absorb(g, np.arange(n), np.ones(len(g.adj)))
    assert time.monotonic() - began < 15
    want = np.arange(n)
    want[pairs] += 1
    assert (found == want).all()


def test_spreading_takes_time_with_what_changes_not_with_sweeps_times_nodes():
    n, path = 4_000_000, np.arange(9_999)
    g = arrays.Csr.build(np.arange(n), path, path + 1)
    began = time.monotonic()
    found = arrays.propagate_from(g, np.array([9_999]), np.ones(len(g.adj)))  # each ascending sweep moves down by one node
    assert time.monotonic() - began < 6
    assert (found[:10_000] == 9_999).all() and (found[10_000:] == np.arange(10_000, n)).all()


def test_children_of_large_graphs_have_tasks_of_their_own_and_the_same_result(spark, triangles, monkeypatch):
    def build():
        engine = detect.Run.start(triangles).engine(detect.locus_make(0.5, 0.5, False), detect.locus_labels, detect.evaluator("intra_inter"), 1)
        rows = engine.build(0, {i: [] for i in range(8)}, None)
        return rows.select(F.input_file_name()).distinct().count(), sorted(map(tuple, rows.select("ind", "labels").collect()))

    few, labels = build()
    monkeypatch.setattr(detect, "SPREAD", 0)
    many, same = build()
    assert few == 1 < many and labels == same


def test_absorbing_does_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    ends = np.unique(np.sort(rng.integers(60, size=(50, 2))), axis=0)
    ends = ends[ends[:, 0] < ends[:, 1]]
    g = arrays.Csr.build(np.arange(60), ends[:, 0], ends[:, 1])
    labels, weights = rng.integers(-20, 20, size=60) * 3, rng.random(len(g.adj))
    whole = arrays.absorb(g, labels, weights)
    monkeypatch.setattr(arrays, "BLOCK", 1)
    assert (arrays.absorb(g, labels, weights) == whole).all() and (whole != labels).any()


def test_both_sides_agree_on_codecs(spark):
    g, _ = loaders.planted_partition(spark, 60, 4, 5.0, 0.3, 3)
    csr = detect.load(g)
    labels = np.random.default_rng(2).integers(0, 5, 60)
    p, w = pop(spark, labels.tolist()), codec.unit_weights(g)
    assert labels_of(codec.split_components(p, g)) == arrays.split_parts(csr, labels).tolist()
    assert sorted(r["node"] for r in codec.encode_centres(p, w).collect()) == arrays.encode(csr, labels, np.ones(len(csr.adj))).tolist()


def test_dense_kernel(spark):
    csr = detect.load(graph(spark, [(0, 1), (1, 2), (2, 3)]))
    k = arrays.diffusion_kernel(csr, 0.3)
    assert np.allclose(k, k.T) and (k > 0).all() and np.allclose(arrays.diffusion_kernel(csr, 0.0), np.eye(4))
    s = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(4) for j in range(4)], "i long, j long, s double")
    centres = spark.createDataFrame([(0, 0), (0, 3)], "ind int, node long")
    assert labels_of(codec.dense_decode(s, centres)) == [0, 0, 3, 3]
    assert sorted(r["node"] for r in codec.dense_encode(s, pop(spark, [0, 0, 0, 3])).collect())[-1] == 3


def test_partition_forms(spark, triangles):
    p = pop(spark, [7, 7, 7, 2, 2, 2], [1, 1, 1, 9, 9, 9], [0] * 6)
    assert {r["ind"]: r["first_ind"] for r in accessors.duplicates(p).collect()} == {0: 0, 1: 0, 2: 2}
    assert {r["ind"] for r in accessors.single_community(p).where("single").collect()} == {2}
    g = graph(spark, TRIANGLES, [6])
    assert labels_of(accessors.normalize(part(spark, [5, 5, 5, 2, 2, 2, 2]), g), "community") == [0, 0, 0, 1, 1, 1, -1]
    assert labels_of(accessors.by_size(part(spark, [5, 5, 2, 2, 2, 9])), "community") == [1, 1, 0, 0, 0, 2]
    assert labels_of(accessors.singletons_for_isolated(part(spark, [-1, 3]), 10), "community") == [10, 3]


def test_variation(spark):
    g, _ = loaders.planted_partition(spark, 40, 4, 6.0, 0.2, 1)
    labels = variation.random_labels(g, 3, 1)
    assert labels.count() == 120 and labels.exceptAll(variation.random_labels(Graph(g.nodes.repartition(7), g.edges), 3, 1)).count() == 0
    near = variation.neighbour_labels(g, 2, 1)
    assert near.join(g.adj, (near.node == g.adj.u) & (near.label == g.adj.v), "left_anti").join(g.deg, "node").where("deg > 0").count() == 0
    assert variation.centres(g, 4, 1).groupBy("ind").count().where("count > 7").count() == 0 and variation.centres(g, 4, 1).select("ind").distinct().count() == 4
    candidates = graphs.locus_candidates(g, True)
    locus = variation.random_locus(candidates, 2, 1)
    again = variation.locus_mutation(locus, candidates, 0.5, 1, 1)
    assert again.count() == 80 and again.join(candidates, "node").where("not array_contains(candidates, target)").count() == 0
    children = spark.range(5).selectExpr("cast(id as int) child")
    ranked = spark.createDataFrame([(i, 1 + i % 2, float(i)) for i in range(6)], "ind int, rank int, crowd double")
    assert variation.parents_of(6, ranked, children, 1, 1).count() == 10
    assert all(len(set(r["parents"])) == 4 for r in variation.distinct_parents(6, ranked, children, 1, 1).collect())
    votes = spark.createDataFrame([(0, 1, [5, 3, 3, 5]), (0, 2, [1, 2, 2, 1]), (0, 3, [9, 9, 1, 1])], "child int, node long, labels array<long>")
    assert labels_of(variation.ensemble_majority(votes, 1, 1)) == [3, 2, 9]
    assert all(r["label"] in {1: (3, 5), 2: (1, 2), 3: (1, 9)}[r["node"]] for r in variation.full_majority(votes, 1, 1).collect())
    a = labels.where("ind = 0").withColumnRenamed("ind", "child")
    b = labels.where("ind = 1").select(F.lit(0).alias("child"), "node", "label")
    assert variation.graft(a, b, 1, 1).count() == 40
    bits = variation.centres(g, 2, 1)
    x, y = (bits.where(f"ind = {i}").select(F.lit(0).alias("child"), "node") for i in (0, 1))
    assert variation.macro_crossover(x, y, g.nodes, 0.0, 1, 1).count() >= 1
    assert variation.majority_mutation(labels, codec.unit_weights(g), 0.0, 1, 1).exceptAll(labels).count() == 0
    assert variation.neighbour_mutation(labels, g, 1.0, 1, 1).count() == 120
    spins = variation.roulette(spark.createDataFrame([(i, i + 1) for i in range(5)], "ind int, pos int"), 200, 1, 1)
    assert spins.count() == 200
    with pytest.raises(ValueError):
        variation.majority_mutation(labels, codec.unit_weights(g), 1.5, 1, 1)


def check_partition(p, g):
    rows = p.join(g.deg, "node").collect()
    assert len(rows) == g.nodes.count() == p.count()
    assert all((r["community"] == -1) == (r["deg"] == 0) for r in rows)
    named = {r["community"] for r in rows} - {-1}
    assert named == set(range(len(named)))


@pytest.mark.parametrize("name", sorted(detect.DETECTORS))
def test_detectors_give_partitions_and_repeat(spark, name):
    g = graph(spark, TRIANGLES, [6])
    params = {"pop_size": 10, "num_gens": 2, "seed": 4} | ({"gap": 1} if name in ("smocc", "mmcomo") else {}) | ({"rand_networks": 1} if name == "mocd_d" else {})
    first = detect.DETECTORS[name](g, **params)
    check_partition(first, g)
    if name in ("hpmocd", "smocc"):
        assert labels_of(first, "community") == labels_of(detect.DETECTORS[name](g, **params), "community")
        assert labels_of(first, "community") == [0, 0, 0, 1, 1, 1, -1]


@pytest.mark.parametrize("name", sorted(detect.FRONTS))
def test_fronts(spark, name):
    g = graph(spark, TRIANGLES)
    params = {"pop_size": 8, "num_gens": 1} | ({"gap": 1} if name in ("smocc_fronts", "mmcomo_fronts") else {})
    front = detect.FRONTS[name](g, **params)
    sizes = front.groupBy("sol_id").count().collect()
    assert sizes and all(r["count"] == 6 for r in sizes)


def test_detector_edges(spark):
    empty, lone = graph(spark, []), graph(spark, [], [1, 2])
    for name in ("smocc", "hpmocd", "mocd_q"):
        assert detect.DETECTORS[name](empty, pop_size=4, num_gens=0).count() == 0
        assert labels_of(detect.DETECTORS[name](lone, pop_size=4, num_gens=0), "community") == [-1, -1]
    with pytest.raises(ValueError):
        detect.hpmocd(lone, cross_rate=2.0)
    seen = []
    g = graph(spark, TRIANGLES)
    found = detect.hpmocd(g, pop_size=6, num_gens=2, objectives=[lambda graph, partition: len(set(partition.values())), lambda graph, partition: 0.0 * len(graph.edges())], on_generation=lambda *x: seen.append(x))
    assert len(set(labels_of(found, "community"))) <= 6 and [x[:2] for x in seen] == [(1, 2), (2, 2)]
    check_partition(detect.edge_parallel(g, 4, 1), g)


def test_generators_and_files(spark, tmp_path):
    g = loaders.random_graph(spark, 30, 100, 2)
    assert g.edges.count() == 100 and loaders.random_graph(spark, 5, 10, 1).edges.count() == 10
    with pytest.raises(ValueError):
        loaders.random_graph(spark, 4, 7)
    lfr, truth = loaders.lfr_graph(spark, 300, degree=8, most_degree=20, mixing=0.2, seed=1)
    assert truth.count() == 300 and 0.05 < accessors.mixing(lfr, truth).first()["mu"] < 0.4
    (tmp_path / "e.txt").write_text("# c\n1 2\n2 3\n\n")
    (tmp_path / "c.txt").write_text("1 2\n3 4 2\n")
    assert loaders.read_edge_list(spark, str(tmp_path / "e.txt")).count() == 2
    assert sorted(map(tuple, loaders.read_communities(spark, str(tmp_path / "c.txt")).collect())) == [(1, 1), (3, 2), (4, 2)]
    import zipfile

    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("g.gml", 'graph [ node [ id 0 value "a" ] node [ id 1 value "b" ] edge [ source 0 target 1 ] ]')
    small, labels = loaders.read_gml_zip(spark, str(tmp_path / "g.zip"))
    assert small.edges.count() == 1 and labels.count() == 2
    loaders.write_partition(labels, str(tmp_path / "p"), alg="x", seed=1)
    loaders.write_partition(labels, str(tmp_path / "p"), alg="y", seed=1)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4
    cached = loaders.cached_graph(spark, str(tmp_path / "cache"), lambda: small)
    assert loaders.cached_graph(spark, str(tmp_path / "cache"), lambda: g).edges.count() == cached.edges.count() == 1
    loaders.write_results(labels, str(tmp_path / "csv"))


def test_edge_stream(spark, tmp_path):
    from coterie.streaming.edges import append_edges

    source, out = tmp_path / "in", str(tmp_path / "out")
    for k, rows in enumerate([[(1, 2), (2, 1)], [(1, 2), (3, 1)]]):
        spark.createDataFrame(rows, "src long, dst long").coalesce(1).write.mode("append").parquet(str(source))
        append_edges(spark.readStream.schema("src long, dst long").parquet(str(source)), out, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(out).count() == k + 1


def test_reports(spark):
    x = np.array([1.1, 2.2, -0.3, 4.0, 5.0, 6.5])
    assert report.signed_rank_p(x) == pytest.approx(0.0625) and report.signed_rank_p(np.zeros(3)) == 1.0
    rows = spark.createDataFrame([("c", a, s, float(s + (a == "x") * (s + 1))) for a in "xy" for s in range(6)], "cell string, alg string, seed int, score double")
    p = report.paired_test(rows, ["cell"], "alg", "seed", "score", "x").first()
    assert p["n"] == 6 and p["p"] == pytest.approx(0.03125)
    done = spark.createDataFrame([(0.30000000001, "a")], "mu double, alg string")
    tasks = spark.createDataFrame([(0.3, "a"), (0.5, "a")], "mu double, alg string")
    assert [r["mu"] for r in report.resume(tasks, done, ["mu", "alg"]).collect()] == [0.5]

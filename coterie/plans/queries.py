"""The registered queries of the graph operators, with DuckDB SQL for their rows.

Graph: parts that share at least two orders; nodes are all parts.  The labels of
the population are brand, type, the key's remainder by 7 (twice, the second time
under other names), the key's remainder by 50, and one community.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coterie.operators import codec, graph as accessors, metrics, objectives, pareto, report, variation
from coterie.plans import detect
from coterie.scratch import materialize
from coterie.sources.graphs import Graph, dense_ids, locus_candidates, neighbour_lists, partition_from_lists
from coterie.sources.loaders import karate_club, planted_partition, random_graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def co_purchase(spark: SparkSession, sf_dir: str, least: int = 2) -> Graph:
    """Parts that share at least ``least`` orders.

    Pairs arise inside an order, which has a few lines; they are counted by pair
    with partial sums.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = (lines.select("l_orderkey", F.col("l_partkey").alias(x)) for x in ("src", "dst"))
    edges = a.join(b, "l_orderkey").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("orders")).where(F.col("orders") >= least).select("src", "dst")
    return Graph(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), materialize(edges, "edges"))


def customer_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and the suppliers of their orders; a supplier's node is ``-1 - key``."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"))
    return Graph.from_tables(pairs)


def by_column(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """``node, community``: parts by a column, each value named by its least part."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), column)
    least = parts.groupBy(column).agg(F.min("node").alias("community"))
    return parts.join(least, column).select("node", "community")


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand, kind = by_column(spark, sf_dir, "p_brand"), by_column(spark, sf_dir, "p_type")
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    made = [F.col("node") % 7, (F.col("node") + 3) % 7, F.col("node") % 50, F.lit(0).cast("long")]
    rows = brand.select(F.lit(0).alias("ind"), "node", F.col("community").alias("label")).union(kind.select(F.lit(1), "node", "community"))
    for i, label in enumerate(made):
        rows = rows.union(keys.select(F.lit(i + 2), "node", label))
    return rows


BASE = """
WITH RECURSIVE lines AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
edges AS (SELECT a.p AS src, b.p AS dst FROM lines a JOIN lines b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 2),
nodes AS (SELECT p_partkey AS node FROM part),
adj AS (SELECT src AS u, dst AS v FROM edges UNION ALL SELECT dst, src FROM edges),
deg AS (SELECT node, count(v) AS deg FROM nodes LEFT JOIN adj ON node = u GROUP BY node),
brand AS (SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_brand) AS community FROM part),
kind AS (SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_type) AS community FROM part),
pop AS (SELECT 0 AS ind, node, community AS label FROM brand UNION ALL SELECT 1, node, community FROM kind
  UNION ALL SELECT 2, node, node % 7 FROM nodes UNION ALL SELECT 3, node, (node + 3) % 7 FROM nodes
  UNION ALL SELECT 4, node, node % 50 FROM nodes UNION ALL SELECT 5, node, 0 FROM nodes),
internal AS (SELECT s.ind, s.label, count(*) AS internal FROM edges JOIN pop s ON s.node = src JOIN pop d ON d.node = dst AND d.ind = s.ind AND d.label = s.label GROUP BY 1, 2),
sizes AS (SELECT ind, label, count(*) AS size, sum(deg) AS degsum FROM pop JOIN deg USING (node) GROUP BY 1, 2),
stats AS (SELECT ind, label, size, degsum, coalesce(internal, 0) AS internal FROM sizes LEFT JOIN internal USING (ind, label)),
objs AS (SELECT ind, sum(size) AS n, count(*) AS k, 1 - 2 * sum(internal) / sum(degsum) AS intra, sum(CAST(degsum AS DOUBLE) * degsum) / (CAST(sum(degsum) AS DOUBLE) * sum(degsum)) AS inter,
  2.0 * (sum(size) - count(*)) - sum(2 * internal / size) AS kkm, sum((degsum - 2 * internal) / size) AS rc FROM stats GROUP BY ind),
cells AS (SELECT a.community AS a, b.community AS b, count(*) AS nij FROM brand a JOIN kind b USING (node) GROUP BY 1, 2),
ra AS (SELECT a, sum(nij) AS ai FROM cells GROUP BY a), rb AS (SELECT b, sum(nij) AS bj FROM cells GROUP BY b),
tot AS (SELECT CAST(sum(nij) AS DOUBLE) AS n FROM cells),
m1 AS (SELECT (SELECT -sum(ai / n * ln(ai / n)) FROM ra, tot) AS h_a, (SELECT -sum(bj / n * ln(bj / n)) FROM rb, tot) AS h_b,
  (SELECT sum(nij / n * ln(n * nij / (CAST(ai AS DOUBLE) * bj))) FROM cells JOIN ra USING (a) JOIN rb USING (b), tot) AS mi,
  (SELECT sum(nij * (nij - 1) / 2) FROM cells) AS tp, (SELECT sum(ai * (ai - 1) / 2) FROM ra) AS pa, (SELECT sum(bj * (bj - 1) / 2) FROM rb) AS pb, (SELECT n FROM tot) AS n,
  (SELECT sum(x / n * ln(n * x / (CAST(ai AS DOUBLE) * bj)) * exp(lgamma(ai + 1) + lgamma(bj + 1) + lgamma(n - ai + 1) + lgamma(n - bj + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(ai - x + 1) - lgamma(bj - x + 1) - lgamma(n - ai - bj + x + 1)))
    FROM (SELECT ai, bj, n, unnest(range(CAST(greatest(1, ai + bj - n) AS BIGINT), CAST(least(ai, bj) + 1 AS BIGINT))) AS x FROM ra, rb, tot)) AS emi),
m2 AS (SELECT *, mi / ((h_a + h_b) / 2) AS nmi, (mi - emi) / ((h_a + h_b) / 2 - emi) AS ami, (tp - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) AS ari, 2 * tp / (pa + pb) AS f1, mi / h_b AS homogeneity, mi / h_a AS completeness FROM m1),
points AS (SELECT s_suppkey AS ind, round(coalesce(sum(l_quantity), 0), 2) AS x, -round(coalesce(sum(l_extendedprice), 0), 2) AS y, round(s_acctbal, 2) AS z FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_acctbal),
front AS (SELECT * FROM points p WHERE NOT EXISTS (SELECT 1 FROM points q WHERE q.x <= p.x AND q.y <= p.y AND q.z <= p.z AND (q.x < p.x OR q.y < p.y OR q.z < p.z)))
"""

ROUND = 6


def rounded(df: DataFrame, digits: int = ROUND) -> DataFrame:
    """Fractions rounded for comparison, and without negative zeros."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ind, f``: suppliers by quantity, negative revenue and balance."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("x"), F.sum("l_extendedprice").alias("y"))
    number = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    return table(spark, sf_dir, "supplier").join(lines, "s_suppkey", "left").select(F.col("s_suppkey").alias("ind"), F.array(number(F.col("x")), -number(F.col("y")), F.round("s_acctbal", 2)).alias("f"))


def flat(objs: DataFrame, *more: str) -> DataFrame:
    return objs.select("ind", *[(F.col("f")[i] + F.lit(0.0)).alias(c) for i, c in enumerate("xyz")], *more)


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Register a function under its name, with its SQL after ``BASE``."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (BASE if base else "") + sql
        return f

    return register


# sources, accessors, partitions


@query("SELECT src, dst FROM edges")
def graph_edges(spark, sf):
    return co_purchase(spark, sf).edges


@query("SELECT node, deg FROM deg")
def graph_degree(spark, sf):
    g = co_purchase(spark, sf)
    return accessors.degrees(g, g.nodes)


@query("SELECT u AS node, v AS neighbour FROM adj")
def graph_neighbours(spark, sf):
    g = co_purchase(spark, sf)
    return accessors.neighbours(g, g.nodes)


@query("SELECT node, coalesce(string_agg(v, ',' ORDER BY v), '') AS neighbours FROM nodes LEFT JOIN adj ON u = node GROUP BY node")
def graph_neighbour_lists(spark, sf):
    return neighbour_lists(co_purchase(spark, sf)).select("node", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query("SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS BIGINT) AS idx FROM nodes")
def graph_dense_ids(spark, sf):
    return dense_ids(co_purchase(spark, sf).nodes)


@query("SELECT count(*) AS n, CAST(sum(deg) / 2 AS BIGINT) AS m, count(*) FILTER (deg = 0) AS isolated, max(deg) AS max_degree, CAST(sum(deg) AS BIGINT) AS total_degree, round(avg(deg), 6) AS avg_degree, arg_max(node, deg * 1e9 - node) AS max_degree_node FROM deg")
def graph_stats(spark, sf):
    return rounded(accessors.stats(co_purchase(spark, sf)))


@query("SELECT node, deg = 0 AS isolated FROM deg")
def graph_isolated(spark, sf):
    return accessors.isolated(co_purchase(spark, sf))


@query("SELECT node, deg FROM deg ORDER BY deg DESC, node")
def graph_by_degree(spark, sf):
    return accessors.by_degree(co_purchase(spark, sf))


@query("SELECT count(*) AS edges, count(DISTINCT src) AS customers, count(DISTINCT dst) AS suppliers FROM (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)", base=False)
def graph_customer_supplier(spark, sf):
    return customer_supplier(spark, sf).edges.agg(F.count("*").alias("edges"), F.count_distinct("dst").alias("customers"), F.count_distinct("src").alias("suppliers"))


@query("SELECT count(*) AS m FROM (SELECT src, dst FROM edges UNION SELECT 0, node FROM nodes WHERE node > 0)")
def graph_add_edges(spark, sf):
    g = co_purchase(spark, sf)
    more = g.nodes.select(F.col("node").alias("src"), F.lit(0).cast("long").alias("dst"))
    return g.add_edges(more.union(more)).edges.agg(F.count("*").alias("m"))


@query("SELECT node, coalesce(string_agg(v, ',' ORDER BY v), CAST(node AS VARCHAR)) AS plain, concat_ws(',', node, string_agg(v, ',' ORDER BY v)) AS with_self FROM nodes LEFT JOIN adj ON u = node GROUP BY node")
def locus_candidate_lists(spark, sf):
    g = co_purchase(spark, sf)
    text = lambda df, name: df.select("node", F.array_join(F.col("candidates").cast("array<string>"), ",").alias(name))
    return text(locus_candidates(g), "plain").join(text(locus_candidates(g, True), "with_self"), "node")


@query("SELECT round(avg(CAST(a.community <> b.community AS INT)), 6) AS mu FROM edges JOIN brand a ON a.node = src JOIN brand b ON b.node = dst")
def edge_mixing(spark, sf):
    return rounded(accessors.mixing(co_purchase(spark, sf), by_column(spark, sf, "p_brand")))


@query("SELECT node, CAST(CASE WHEN deg = 0 THEN -1 ELSE dense_rank() OVER (ORDER BY CASE WHEN deg > 0 THEN least END NULLS LAST) - 1 END AS BIGINT) AS community FROM (SELECT node, deg, min(CASE WHEN deg > 0 THEN node END) OVER (PARTITION BY community) AS least FROM brand JOIN deg USING (node))")
def normalize_partition(spark, sf):
    return accessors.normalize(by_column(spark, sf, "p_brand"), co_purchase(spark, sf))


@query("SELECT node, c.new AS community FROM brand JOIN (SELECT community, CAST(row_number() OVER (ORDER BY count(*) DESC, min(node)) - 1 AS BIGINT) AS new FROM brand GROUP BY community) c USING (community)")
def relabel_by_size(spark, sf):
    return accessors.by_size(by_column(spark, sf, "p_brand"))


@query("SELECT ind, node, min(node) OVER (PARTITION BY ind, label) AS label FROM pop")
def canonical_labels(spark, sf):
    return accessors.canonical_labels(population(spark, sf))


@query("SELECT ind, min(ind) OVER (PARTITION BY s) AS first_ind FROM (SELECT ind, string_agg(node || ':' || label, ',' ORDER BY node) AS s FROM (SELECT ind, node, min(node) OVER (PARTITION BY ind, label) AS label FROM pop) GROUP BY ind)")
def duplicate_partitions(spark, sf):
    return accessors.duplicates(population(spark, sf))


@query("SELECT ind, count(DISTINCT label) = 1 AS single FROM pop GROUP BY ind")
def single_community(spark, sf):
    return accessors.single_community(population(spark, sf))


@query("SELECT node, CASE WHEN deg = 0 THEN node + (SELECT count(*) FROM nodes) ELSE community END AS community FROM brand JOIN deg USING (node)")
def singletons_for_isolated(spark, sf):
    g = co_purchase(spark, sf)
    marked = by_column(spark, sf, "p_brand").join(g.deg, "node").select("node", F.when(F.col("deg") == 0, -1).otherwise(F.col("community")).alias("community"))
    return accessors.singletons_for_isolated(marked, g.nodes.count())


@query("SELECT l_partkey AS node, l_orderkey AS community FROM lineitem", base=False)
def partition_of_lists(spark, sf):
    lists = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("community")).agg(F.collect_list("l_partkey").alias("members"))
    return partition_from_lists(lists)


# objectives

OBJECTIVES = "SELECT ind, CAST(n AS BIGINT) AS n, k, round(intra, 6) AS intra, round(inter, 6) AS inter, round(kkm, 6) AS kkm, round(rc, 6) AS rc, round(1 - intra - inter, 6) + 0.0 AS q FROM objs"


@query(OBJECTIVES)
def obj_all(spark, sf):
    return rounded(objectives.objectives(population(spark, sf), co_purchase(spark, sf)))


@query("SELECT ind, round(intra, 6) AS x, round(inter, 6) AS y, round(2 - intra - inter, 6) AS score FROM objs")
def obj_intra_inter(spark, sf):
    found = objectives.evaluate(population(spark, sf), co_purchase(spark, sf), "intra_inter")
    return rounded(found.select("ind", F.col("f")[0].alias("x"), F.col("f")[1].alias("y"), objectives.q_score(F.col("f")).alias("score")))


@query("SELECT ind, round(kkm, 6) AS x, round(rc, 6) AS y, round(intra + inter - 1, 6) + 0.0 AS z FROM objs")
def obj_kkm_rc(spark, sf):
    return rounded(flat(objectives.evaluate(population(spark, sf), co_purchase(spark, sf), "kkm_rc_q")))


@query(
    "SELECT ind, round(sum(mu * inside), 6) AS cs, round(sum(fit), 6) AS cf FROM (SELECT ind, label, avg(pow(k_in / size, 1.5)) AS mu, sum(k_in) AS inside, sum(CASE WHEN deg > 0 THEN k_in / deg ELSE 0 END) AS fit FROM "
    "(SELECT p.ind, p.label, p.node, size, deg, count(q.node) AS k_in FROM pop p JOIN sizes USING (ind, label) JOIN deg ON deg.node = p.node LEFT JOIN adj ON u = p.node LEFT JOIN pop q ON q.node = v AND q.ind = p.ind AND q.label = p.label GROUP BY ALL) GROUP BY 1, 2) GROUP BY ind"
)
def obj_cs_cf(spark, sf):
    return rounded(objectives.community_score(population(spark, sf), co_purchase(spark, sf), r=1.5))


@query("SELECT CAST(n AS BIGINT) AS n, (SELECT count(*) FROM edges) AS m, k, round(intra, 6) AS intra, round(inter, 6) AS inter, round(1 - intra - inter, 6) AS q FROM objs WHERE ind = 0")
def modularity(spark, sf):
    return rounded(objectives.modularity(by_column(spark, sf, "p_brand"), co_purchase(spark, sf)))


# metrics


def brand_and_type(spark, sf):
    return by_column(spark, sf, "p_brand"), by_column(spark, sf, "p_type")


@query("SELECT a, b, nij FROM cells")
def contingency(spark, sf):
    return metrics.contingency(*brand_and_type(spark, sf))


@query("SELECT round(h_a, 6) AS h_a, round(h_b, 6) AS h_b, round(mi, 6) AS mi, round(emi, 6) AS emi FROM m2")
def mutual_information(spark, sf):
    return rounded(metrics.all_metrics(*brand_and_type(spark, sf)).select("h_a", "h_b", "mi", "emi"))


@query("SELECT round(nmi, 6) AS nmi, round(ami, 6) + 0.0 AS ami, round(ari, 6) + 0.0 AS ari, round(f1, 6) AS f1 FROM m2")
def gt_metrics(spark, sf):
    return rounded(metrics.gt_metrics(*brand_and_type(spark, sf)))


def single_metric(name):
    def run(spark, sf):
        return rounded(metrics.metric(name, *brand_and_type(spark, sf)))

    run.__name__ = name
    query(f"SELECT round({name}, 6) + 0.0 AS {name} FROM m2")(run)


for _name in ("nmi", "ami", "ari", "f1"):
    single_metric(_name)


@query("SELECT round(homogeneity, 6) AS homogeneity, round(completeness, 6) AS completeness, round(2 * homogeneity * completeness / (homogeneity + completeness), 6) AS v_measure FROM m2")
def homogeneity_completeness(spark, sf):
    return rounded(metrics.all_metrics(*brand_and_type(spark, sf)).select("homogeneity", "completeness", "v_measure"))


@query("SELECT round((SELECT 1 - intra - inter FROM objs WHERE ind = 0), 6) AS q, round(nmi, 6) AS nmi, round(ami, 6) + 0.0 AS ami FROM m2")
def evaluate_partition(spark, sf):
    return rounded(report.evaluate(by_column(spark, sf, "p_brand"), co_purchase(spark, sf), by_column(spark, sf, "p_type")))


@query("SELECT ind, round(intra, 6) AS intra, round(inter, 6) AS inter, round(1 - intra - inter, 6) + 0.0 AS q, k FROM objs")
def front_scatter(spark, sf):
    return rounded(report.front_scatter(population(spark, sf), co_purchase(spark, sf)))


PARTIAL = """
, part_pop AS (SELECT node, community AS label FROM brand JOIN part ON p_partkey = node WHERE p_size <= 25),
part_in AS (SELECT a.label, count(*) AS internal FROM edges JOIN part_pop a ON a.node = src JOIN part_pop b ON b.node = dst AND b.label = a.label GROUP BY 1),
part_stats AS (SELECT s.label, size, degsum, coalesce(internal, 0) AS internal FROM (SELECT label, count(*) AS size, sum(deg) AS degsum FROM part_pop JOIN deg USING (node) GROUP BY 1) s LEFT JOIN part_in USING (label)),
part_objs AS (SELECT sum(size) AS n, count(*) AS k, (SELECT count(*) FROM edges) AS m, 1 - sum(internal) / (SELECT count(*) FROM edges) AS intra, sum(pow(degsum / (2.0 * (SELECT count(*) FROM edges)), 2)) AS inter FROM part_stats)
"""


def small_parts(spark, sf):
    """``node, community``: brands of the parts of size up to 25 only, so a partition of a part of the graph."""
    small = table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("node"))
    return by_column(spark, sf, "p_brand").join(small, "node")


@query(PARTIAL + "SELECT CAST(n AS BIGINT) AS n, m, k, round(intra, 6) AS intra, round(inter, 6) AS inter, round(1 - intra - inter, 6) + 0.0 AS q FROM part_objs")
def modularity_partial(spark, sf):
    return rounded(objectives.modularity(small_parts(spark, sf), co_purchase(spark, sf)))


@query(PARTIAL + "SELECT 0 AS ind, round(intra, 6) AS intra, round(inter, 6) AS inter, round(1 - intra - inter, 6) + 0.0 AS q, k FROM part_objs")
def front_scatter_partial(spark, sf):
    front = small_parts(spark, sf).select(F.lit(0).alias("ind"), "node", F.col("community").alias("label"))
    return rounded(report.front_scatter(front, co_purchase(spark, sf)))


SCORES = """
, fc AS (SELECT p.ind, p.label AS a, t.community AS b, count(*) AS nij FROM pop p JOIN kind t USING (node) GROUP BY 1, 2, 3),
fa AS (SELECT ind, a, sum(nij) AS x FROM fc GROUP BY 1, 2), fb AS (SELECT ind, b, sum(nij) AS x FROM fc GROUP BY 1, 2),
fs AS (SELECT ind, sum(nij * (nij - 1) / 2) AS tp, sum(nij) AS n, sum(nij * ln(nij)) AS lab FROM fc GROUP BY 1),
ga AS (SELECT ind, sum(x * (x - 1) / 2) AS pa, sum(x * ln(x)) AS la FROM fa GROUP BY 1), gb AS (SELECT ind, sum(x * (x - 1) / 2) AS pb, sum(x * ln(x)) AS lb FROM fb GROUP BY 1),
member AS (SELECT ind, CASE WHEN abs((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) < 1e-15 THEN 1 ELSE (tp - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) END AS ari,
  (2 * ln(n) - la / n - lb / n - (ln(n) - lab / n)) / ((2 * ln(n) - la / n - lb / n) / 2) AS nmi FROM fs JOIN ga USING (ind) JOIN gb USING (ind))
"""


@query(SCORES + "SELECT ind, round(nmi, 6) + 0.0 AS nmi, round(ari, 6) + 0.0 AS ari FROM member")
def scores_against(spark, sf):
    return rounded(pareto.scores_against(population(spark, sf), by_column(spark, sf, "p_type")))


@query(SCORES + "SELECT ind, round(ari, 6) AS score FROM member ORDER BY round(ari, 9) DESC, ind LIMIT 1")
def select_best_ari(spark, sf):
    return rounded(pareto.select_best_against(population(spark, sf), by_column(spark, sf, "p_type"), "ari"))


@query(SCORES + "SELECT ind, round(nmi, 6) AS score FROM member ORDER BY round(nmi, 9) DESC, ind LIMIT 1")
def select_best_nmi(spark, sf):
    return rounded(pareto.select_best_against(population(spark, sf), by_column(spark, sf, "p_type"), "nmi"))


# Pareto


def two_of(objs: DataFrame) -> DataFrame:
    return objs.select("ind", F.slice("f", 1, 2).alias("f"))


TWO = ", above2 AS (SELECT q.ind AS a, p.ind AS b FROM points q, points p WHERE q.x <= p.x AND q.y <= p.y AND (q.x < p.x OR q.y < p.y)) "


@query(TWO + ", chain AS (SELECT ind, 1 AS rank FROM points UNION SELECT above2.b, chain.rank + 1 FROM chain JOIN above2 ON above2.a = chain.ind) SELECT ind, max(rank) AS rank FROM chain GROUP BY ind")
def pareto_ranks_of_two(spark, sf):
    return pareto.non_dominated_sort(two_of(vectors(spark, sf))).select("ind", "rank")


@query(TWO + "SELECT ind, x, y + 0.0 AS y FROM points WHERE ind NOT IN (SELECT b FROM above2)")
def pareto_rank1_of_two(spark, sf):
    found = pareto.rank_one_of_two(two_of(vectors(spark, sf)))
    return found.select("ind", *[(F.col("f")[i] + F.lit(0.0)).alias(c) for i, c in enumerate("xy")])


@query("SELECT ind, CASE WHEN a IS NULL OR b IS NULL OR n <= 2 THEN -1 ELSE round((b - a) / r, 6) END AS crowd FROM (SELECT ind, lag(z) OVER w AS a, lead(z) OVER w AS b, max(z) OVER g - min(z) OVER g AS r, count(*) OVER g AS n FROM points WINDOW w AS (PARTITION BY x ORDER BY z, ind), g AS (PARTITION BY x))")
def crowding_of_pairs(spark, sf):
    """Groups of equal quantity as fronts, crowded by balance alone; groups of up to two are infinite throughout."""
    ranked = vectors(spark, sf).select("ind", F.col("f")[0].alias("rank"), F.slice("f", 3, 1).alias("f"))
    crowd = pareto.crowding(ranked, 1, small=2)
    return rounded(crowd.select("ind", F.when(F.col("crowd") == float("inf"), -1.0).otherwise(F.col("crowd")).alias("crowd")))


@query("SELECT ind, x, y + 0.0 AS y, z FROM front")
def pareto_rank1(spark, sf):
    return flat(pareto.rank_one(vectors(spark, sf)))


@query(
    ", above AS (SELECT q.ind AS a, p.ind AS b FROM points q, points p WHERE q.x <= p.x AND q.y <= p.y AND q.z <= p.z AND (q.x < p.x OR q.y < p.y OR q.z < p.z)), "
    "chain AS (SELECT ind, 1 AS rank FROM points UNION SELECT above.b, chain.rank + 1 FROM chain JOIN above ON above.a = chain.ind) SELECT ind, max(rank) AS rank FROM chain GROUP BY ind"
)
def pareto_ranks(spark, sf):
    return pareto.non_dominated_sort(vectors(spark, sf)).select("ind", "rank")


@query(
    "SELECT ind, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL OR d IS NULL OR e IS NULL OR f IS NULL THEN -1 ELSE round((b - a) / nullif(rx, 0) + (d - c) / nullif(ry, 0) + (f - e) / nullif(rz, 0), 6) END AS crowd FROM (SELECT ind, "
    "lag(x) OVER wx AS a, lead(x) OVER wx AS b, lag(y) OVER wy AS c, lead(y) OVER wy AS d, lag(z) OVER wz AS e, lead(z) OVER wz AS f, max(x) OVER () - min(x) OVER () AS rx, max(y) OVER () - min(y) OVER () AS ry, max(z) OVER () - min(z) OVER () AS rz FROM front "
    "WINDOW wx AS (ORDER BY x, ind), wy AS (ORDER BY y, ind), wz AS (ORDER BY z, ind))"
)
def crowding_distance(spark, sf):
    ranked = pareto.rank_one(vectors(spark, sf)).withColumn("rank", F.lit(1))
    crowd = pareto.crowding(ranked, 3)
    return rounded(crowd.select("ind", F.when(F.col("crowd") == float("inf"), -1.0).otherwise(F.col("crowd")).alias("crowd")))


@query(
    ", c AS (SELECT ind, x, y, z, lag(x) OVER wx IS NULL OR lead(x) OVER wx IS NULL OR lag(y) OVER wy IS NULL OR lead(y) OVER wy IS NULL OR lag(z) OVER wz IS NULL OR lead(z) OVER wz IS NULL AS outer_, "
    "(lead(x) OVER wx - lag(x) OVER wx) / (max(x) OVER () - min(x) OVER ()) + (lead(y) OVER wy - lag(y) OVER wy) / (max(y) OVER () - min(y) OVER ()) + (lead(z) OVER wz - lag(z) OVER wz) / (max(z) OVER () - min(z) OVER ()) AS d FROM front "
    "WINDOW wx AS (ORDER BY x, ind), wy AS (ORDER BY y, ind), wz AS (ORDER BY z, ind)) SELECT ind FROM c ORDER BY CASE WHEN outer_ THEN 1e300 ELSE round(d, 9) END DESC, ind LIMIT 8"
)
def survivors(spark, sf):
    ranked = pareto.rank_one(vectors(spark, sf)).withColumn("rank", F.lit(1))
    return pareto.survivors(pareto.crowding(ranked, 3).withColumn("crowd", F.round("crowd", 9)), 8).select("ind")


@query(
    ", g AS (SELECT ind, CAST(least(floor((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) * 8), 7) AS INT) AS a, CAST(least(floor((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) * 8), 7) AS INT) AS b, CAST(least(floor((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) * 8), 7) AS INT) AS c FROM points) "
    "SELECT ind, a, b, c, count(*) OVER (PARTITION BY a, b, c) AS occupancy FROM g"
)
def squeeze_cells(spark, sf):
    cells = pareto.grid_cells(vectors(spark, sf), 3)
    return cells.select("ind", *[F.col("cell")[i].alias(c) for i, c in enumerate("abc")], "occupancy")


@query("SELECT ind, x, y + 0.0 AS y, z FROM front")
def archive_insert(spark, sf):
    objs = vectors(spark, sf)
    return flat(pareto.archive_insert(pareto.rank_one(objs.where("ind % 2 = 0")), objs.where("ind % 2 = 1")))


@query("SELECT a / 12 AS a, b / 12 AS b, (12 - a - b) / 12 AS c FROM range(0, 13) r(a), range(0, 13) s(b) WHERE a + b <= 12", base=False)
def das_dennis(spark, sf):
    return pareto.das_dennis(spark, 3, 12).select(*[F.col("point")[i].alias(c) for i, c in enumerate("abc")])


@query(
    ", pts AS (SELECT a / 4 AS a, b / 4 AS b, (4 - a - b) / 4 AS c FROM range(0, 5) r(a), range(0, 5) s(b) WHERE a + b <= 4), nz AS (SELECT ind, x / 1000 AS x, (y + 1e8) / 1e8 AS y, (z + 1000) / 1e4 AS z FROM points), "
    "d AS (SELECT ind, a, b, c, round(sqrt(greatest(x * x + y * y + z * z - pow(x * a + y * b + z * c, 2) / (a * a + b * b + c * c), 0)), 12) AS distance FROM nz, pts) "
    "SELECT ind, a, b, c, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY ind ORDER BY distance, a, b, c) = 1"
)
def ref_point_association(spark, sf):
    found = pareto.associate(vectors(spark, sf), pareto.das_dennis(spark, 3, 4), [0.0, -1e8, -1000.0], [1000.0, 1e8, 1e4])
    return rounded(found.select("ind", *[F.col("point")[i].alias(c) for i, c in enumerate("abc")], "distance"))


@query("SELECT ind, round(distance, 6) AS distance FROM (SELECT p.ind, min(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2))) AS distance FROM front p, points q WHERE q.ind NOT IN (SELECT ind FROM front) GROUP BY p.ind) ORDER BY distance DESC, ind LIMIT 1")
def max_min_distance(spark, sf):
    objs = vectors(spark, sf)
    front = materialize(pareto.rank_one(objs), "front")
    return rounded(pareto.max_min_distance(front, objs.join(front.select("ind"), "ind", "left_anti")))


@query("SELECT ind, round(1 - intra - inter, 6) + 0.0 AS score FROM objs ORDER BY score DESC, ind DESC LIMIT 1")
def select_max_q(spark, sf):
    return rounded(pareto.select_max(objectives.objectives(population(spark, sf), co_purchase(spark, sf)), F.round("q", 6)).select("ind", "score"))


@query("SELECT ind, round(intra + inter, 6) AS score FROM objs ORDER BY score, ind LIMIT 1")
def select_min_sum(spark, sf):
    return rounded(pareto.select_min(objectives.objectives(population(spark, sf), co_purchase(spark, sf)), F.round(F.col("intra") + F.col("inter"), 6)).select("ind", "score"))


@query(
    "SELECT ind, round((kkm - min(kkm) OVER ()) / (max(kkm) OVER () - min(kkm) OVER ()) + (rc - min(rc) OVER ()) / (max(rc) OVER () - min(rc) OVER ()) + (intra - min(intra) OVER ()) / (max(intra) OVER () - min(intra) OVER ()) + (inter - min(inter) OVER ()) / (max(inter) OVER () - min(inter) OVER ()), 6) AS score FROM objs ORDER BY score, ind LIMIT 1"
)
def select_label_free(spark, sf):
    return rounded(pareto.select_label_free(objectives.objectives(population(spark, sf), co_purchase(spark, sf))).select("ind", "score"))


@query("SELECT ind, k FROM objs ORDER BY abs(k - 20), ind LIMIT 1")
def select_target_k(spark, sf):
    return pareto.select_target_k(objectives.objectives(population(spark, sf), co_purchase(spark, sf)), 20).select("ind", "k")


# codecs

REACH = ", reach AS (SELECT node, node AS r FROM nodes UNION SELECT reach.node, CASE WHEN links.a = reach.r THEN links.b ELSE links.a END FROM reach JOIN links ON links.a = reach.r OR links.b = reach.r) SELECT node, min(r) AS label FROM reach GROUP BY node"


@query(", links AS (SELECT u AS a, min(v) AS b FROM adj GROUP BY u)" + REACH)
def locus_decode(spark, sf):
    g = co_purchase(spark, sf)
    least = g.adj.groupBy("u").agg(F.min("v").alias("target"))
    locus = g.nodes.join(least, g.nodes.node == least.u, "left").select(F.lit(0).alias("ind"), "node", F.coalesce("target", "node").alias("target"))
    return codec.decode_locus(locus).select("node", "label")


@query(", links AS (SELECT src AS a, dst AS b FROM edges JOIN brand s ON s.node = src JOIN brand d ON d.node = dst WHERE s.community = d.community)" + REACH)
def split_components(spark, sf):
    pop = by_column(spark, sf, "p_brand").select(F.lit(0).alias("ind"), "node", F.col("community").alias("label"))
    return codec.split_components(pop, co_purchase(spark, sf)).select("node", "label")


@query(", links AS (SELECT src AS a, dst AS b FROM edges WHERE src % 3 = 0 AND dst % 3 = 0)" + REACH.replace("SELECT node, min(r) AS label FROM reach GROUP BY node", "SELECT node, CASE WHEN node % 3 = 0 THEN min(r) ELSE -5 END AS label FROM reach GROUP BY node"))
def leftover_fill(spark, sf):
    g = co_purchase(spark, sf)
    pop = g.nodes.select(F.lit(0).alias("ind"), "node", F.when(F.col("node") % 3 != 0, -5).cast("long").alias("label"))
    return codec.fill_unset(pop, g).select("node", "label")


WADJ = ", wadj AS (SELECT u, v, 1.0 + (u + v) % 5 AS w FROM adj) "


def weights(g: Graph) -> DataFrame:
    return g.adj.select("u", "v", (1.0 + (F.col("u") + F.col("v")) % 5).alias("w"))


@query(WADJ + ", i AS (SELECT p.ind, p.label, p.node, coalesce(sum(w) FILTER (q.label = p.label), 0) AS weight FROM pop p LEFT JOIN wadj ON u = p.node LEFT JOIN pop q ON q.ind = p.ind AND q.node = v GROUP BY 1, 2, 3) SELECT ind, label, node FROM i QUALIFY row_number() OVER (PARTITION BY ind, label ORDER BY weight DESC, node) = 1")
def encode_centres(spark, sf):
    return codec.encode_centres(population(spark, sf), weights(co_purchase(spark, sf)))


@query(WADJ + "SELECT u, v, round(0.75 * w + 0.25 * s, 6) AS w FROM wadj JOIN (SELECT u, v, avg(CAST(p.label = q.label AS INT)) AS s FROM adj JOIN pop p ON p.node = u JOIN pop q ON q.node = v AND q.ind = p.ind GROUP BY u, v) USING (u, v)")
def consensus_weights(spark, sf):
    return rounded(codec.consensus_weights(weights(co_purchase(spark, sf)), population(spark, sf), 0.25))


VOTES = ", votes AS (SELECT p.ind, u AS node, p.label, sum(w) AS weight FROM wadj JOIN pop p ON p.node = v GROUP BY 1, 2, 3), major AS (SELECT ind, node, label FROM votes QUALIFY row_number() OVER (PARTITION BY ind, node ORDER BY weight DESC, label) = 1) "


@query(WADJ + VOTES + "SELECT pop.ind, pop.node, coalesce(major.label, pop.label) AS label FROM pop LEFT JOIN major USING (ind, node)")
def majority_step(spark, sf):
    return codec.majority_step(population(spark, sf), weights(co_purchase(spark, sf)))


@query(
    ", tp AS (SELECT node, CASE WHEN node % 3 = 0 THEN node ELSE node - node % 3 END AS label FROM nodes), tsz AS (SELECT label, count(*) AS size FROM tp GROUP BY label), wadj AS (SELECT u, v, 1.0 + (u + v) % 5 AS w FROM adj), "
    "pull AS (SELECT p.label, s.size, q.label AS target, t.size AS tsize, sum(w) AS weight FROM tp p JOIN tsz s ON s.label = p.label JOIN wadj ON u = p.node JOIN tp q ON q.node = v JOIN tsz t ON t.label = q.label WHERE s.size <= 3 GROUP BY 1, 2, 3, 4), "
    "ins AS (SELECT label, coalesce(sum(weight) FILTER (target = label), 0) AS twice FROM pull GROUP BY label), "
    "goes AS (SELECT label, target FROM (SELECT * FROM pull WHERE target <> label QUALIFY row_number() OVER (PARTITION BY label ORDER BY weight DESC, tsize DESC, target) = 1) JOIN ins USING (label) WHERE size = 1 OR twice = 0 OR weight > twice / 2), "
    "kept AS (SELECT g.label, g.target FROM goes g LEFT JOIN goes b ON b.label = g.target WHERE b.target IS NULL OR b.target <> g.label OR g.label > g.target) "
    "SELECT node, coalesce(kept.target, tp.label) AS label FROM tp LEFT JOIN kept ON kept.label = tp.label"
)
def tiny_absorb_round(spark, sf):
    g = co_purchase(spark, sf)
    pop = g.nodes.select(F.lit(0).alias("ind"), "node", (F.col("node") - F.col("node") % 3).alias("label"))
    return codec.absorb_round(pop, weights(g), 3).select("node", "label")


@query(
    ", v AS (SELECT node, list(label ORDER BY ind) AS l FROM pop WHERE ind IN (0, 1, 2, 4) GROUP BY node) SELECT node, CASE WHEN l[1] = l[2] THEN l[1] WHEN l[3] IN (l[1], l[2]) THEN l[3] WHEN l[4] IN (l[1], l[2], l[3]) THEN l[4] ELSE -1 END AS label, true AS held FROM v"
)
def ensemble_majority(spark, sf):
    """All nodes; where four parents differ the label is drawn, so it shows as -1, and ``held`` says that a parent bears it."""
    parents = spark.createDataFrame([(0, [0, 1, 2, 4])], "child int, parents array<int>")
    votes = variation.parent_votes(population(spark, sf), parents)
    made = variation.ensemble_majority(votes, 1, 0).join(votes, ["child", "node"])
    return made.select("node", F.when(F.size(F.array_distinct("labels")) < 4, F.col("label")).otherwise(-1).alias("label"), F.array_contains("labels", F.col("label")).alias("held"))


# reports


def runs(spark, sf):
    """Orders as benchmark runs: customer group, priority as algorithm, total price as score."""
    return table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("cell"), F.col("o_orderpriority").alias("alg"), F.col("o_orderkey").alias("seed"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("status"))


RUNS = "WITH runs AS (SELECT o_custkey % 10 AS cell, o_orderpriority AS alg, o_orderkey AS seed, o_totalprice AS score, o_orderstatus AS status FROM orders) "


@query(RUNS + "SELECT cell, alg, seed FROM runs WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = seed AND l_returnflag = 'R')", base=False)
def resume_anti_join(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("seed"))
    return report.resume(runs(spark, sf).select("cell", "alg", "seed"), done, ["seed"])


@query(
    RUNS + "SELECT cell, round(avg(score) FILTER (alg = '1-URGENT'), 4) AS urgent_mean, round(stddev_samp(score) FILTER (alg = '1-URGENT'), 4) AS urgent_std, round(avg(score) FILTER (alg = '5-LOW'), 4) AS low_mean, round(stddev_samp(score) FILTER (alg = '5-LOW'), 4) AS low_std FROM runs WHERE status <> 'P' GROUP BY cell", base=False
)
def pivot_report(spark, sf):
    wide = report.pivot(runs(spark, sf), ["cell"], "alg", "score", ["1-URGENT", "5-LOW"], F.col("status") != "P")
    return rounded(wide.select("cell", *[F.col(f"`{a}_{m}`").alias(f"{n}_{m}") for a, n in (("1-URGENT", "urgent"), ("5-LOW", "low")) for m in ("mean", "std")]), 4)


@query(RUNS + "SELECT alg, round(avg(score), 4) AS mean, round(coalesce(stddev_samp(score), 0), 4) AS std FROM runs GROUP BY alg", base=False)
def mean_and_spread(spark, sf):
    return rounded(report.spread(runs(spark, sf), ["alg"], "score"), 4)


@query(RUNS + ", m AS (SELECT cell, alg, count(*) AS score FROM runs GROUP BY 1, 2), r AS (SELECT cell, alg, rank() OVER (PARTITION BY cell ORDER BY score DESC) + (count(*) OVER (PARTITION BY cell, score) - 1) / 2 AS r FROM m) SELECT alg, round(avg(r), 6) AS average_rank FROM r GROUP BY alg", base=False)
def average_rank(spark, sf):
    counts = runs(spark, sf).groupBy("cell", "alg").agg(F.count("*").alias("score"))
    return rounded(report.average_rank(counts, ["cell"], "alg", "score"))


@query("SELECT n, CAST(mu AS DOUBLE) AS mu, alg, seed FROM (VALUES (1000), (5000)) a(n), (VALUES (0.1), (0.3)) b(mu), (VALUES ('smocc'), ('mmcomo')) c(alg), range(0, 3) d(seed) WHERE NOT (alg = 'mmcomo' AND n > 2000)", base=False)
def task_grid(spark, sf):
    grid = report.task_grid(spark, {"n": [1000, 5000], "mu": [0.1, 0.3], "alg": ["smocc", "mmcomo"], "seed": [0, 1, 2]}, {"mmcomo": 2000})
    return grid.select(F.col("n").cast("int").alias("n"), "mu", "alg", "seed")


@query(
    RUNS + ", slow AS (SELECT cell, min(seed) AS least FROM runs WHERE status = 'P' GROUP BY cell) SELECT runs.cell, alg, seed, coalesce(seed > least, false) AS skipped FROM runs LEFT JOIN slow ON slow.cell = runs.cell", base=False
)
def prune_timeouts(spark, sf):
    """Cells as families and order keys as sizes; pending orders count as runs that timed out."""
    every = runs(spark, sf)
    done = every.select("cell", "seed", F.when(F.col("status") == "P", "timeout").otherwise("ok").alias("status"))
    return report.prune_timeouts(every.select("cell", "alg", "seed"), done, family="cell", size="seed")


@query(RUNS + "SELECT alg, count(*) AS runs FROM runs GROUP BY alg ORDER BY alg", base=False)
def ordered_report(spark, sf):
    counts = runs(spark, sf).groupBy("alg").agg(F.count("*").alias("runs"))
    return report.ordered(counts, "alg", ["5-LOW", "1-URGENT"], ["alg"])


@query()
def paired_wilcoxon(spark, sf):
    lines = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("cell"), F.col("l_returnflag").alias("alg"), "l_partkey", "l_discount")
    mean = lines.groupBy("cell", "alg", F.col("l_partkey").alias("seed")).agg(F.avg("l_discount").alias("score"))
    return rounded(report.paired_test(mean, ["cell"], "alg", "seed", "score", "A"))


# generators


@query()
def random_graph_degrees(spark, sf):
    g = random_graph(spark, 200, 600, 1)
    return g.deg.groupBy("deg").agg(F.count("*").alias("nodes"))


@query()
def planted_graph_mixing(spark, sf):
    g, truth = planted_partition(spark, 400, 8, 10.0, 0.2, 1)
    return accessors.mixing(g, truth)


@query("SELECT 34 AS n, 78 AS m, CAST(0.358235 AS DOUBLE) AS q", base=False)
def karate_modularity(spark, sf):
    g, truth = karate_club(spark)
    return rounded(objectives.modularity(truth, g)).select(F.col("n").cast("int").alias("n"), F.col("m").cast("int").alias("m"), "q")


# variation: draws have no SQL form, so each query counts its rows and what breaks its rule


def audit(rows: DataFrame, broken) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.count_if(broken).alias("broken"))


def with_neighbours(g: Graph, rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``near``: whether ``column`` is a neighbour of the node, or the node itself if isolated."""
    known = g.adj.select(F.col("u").alias("node"), F.col("v").alias(column), F.lit(True).alias("linked"))
    return rows.join(known, ["node", column], "left").join(g.deg, "node").withColumn("near", F.coalesce("linked", (F.col("deg") == 0) & (F.col(column) == F.col("node"))))


@query("SELECT 4 * count(*) AS rows, CAST(0 AS BIGINT) AS broken FROM nodes")
def var_random_labels(spark, sf):
    g = co_purchase(spark, sf)
    rows = variation.random_labels(g, 4, 1).crossJoin(F.broadcast(g.nodes.agg(F.count("*").alias("n"))))
    return audit(rows, (F.col("label") < 0) | (F.col("label") >= F.col("n")))


@query("SELECT 4 * count(*) AS rows, CAST(0 AS BIGINT) AS broken FROM nodes")
def var_neighbour_labels(spark, sf):
    g = co_purchase(spark, sf)
    return audit(with_neighbours(g, variation.neighbour_labels(g, 4, 1), "label"), ~F.col("near"))


@query("SELECT 4 * count(*) AS rows, CAST(0 AS BIGINT) AS broken FROM nodes")
def var_random_locus(spark, sf):
    g = co_purchase(spark, sf)
    return audit(with_neighbours(g, variation.random_locus(locus_candidates(g), 4, 1), "target"), ~F.col("near"))


@query("SELECT 4 * count(*) AS rows, CAST(0 AS BIGINT) AS broken FROM nodes")
def var_locus_mutation(spark, sf):
    g = co_purchase(spark, sf)
    candidates = locus_candidates(g)
    return audit(with_neighbours(g, variation.locus_mutation(variation.random_locus(candidates, 4, 1), candidates, 0.3, 1, 1), "target"), ~F.col("near"))


@query("SELECT CAST(6 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS broken", base=False)
def var_centres(spark, sf):
    g = co_purchase(spark, sf)
    each = variation.centres(g, 6, 1).groupBy("ind").agg(F.count("*").alias("c"), F.count_distinct("node").alias("d")).crossJoin(F.broadcast(g.nodes.agg(F.count("*").alias("n"))))
    return audit(each, (F.col("c") != F.col("d")) | (F.col("c") > F.ceil(F.sqrt("n"))))


@query("SELECT CAST(20 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS broken", base=False)
def var_tournament(spark, sf):
    ranked = spark.createDataFrame([(i, 1 + i % 3, float(i)) for i in range(12)], "ind int, rank int, crowd double")
    children = spark.range(10).select(F.col("id").cast("int").alias("child"))
    return audit(variation.parents_of(12, ranked, children, 1, 1), ~F.col("ind").between(0, 11))


@query("SELECT CAST(10 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS broken", base=False)
def var_distinct_parents(spark, sf):
    ranked = spark.createDataFrame([(i, 1 + i % 3, float(i)) for i in range(12)], "ind int, rank int, crowd double")
    children = spark.range(10).select(F.col("id").cast("int").alias("child"))
    return audit(variation.distinct_parents(12, ranked, children, 1, 1), F.size(F.array_distinct("parents")) != 4)


@query(
    "SELECT CAST(12 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS broken, (SELECT count(*) FROM deg WHERE deg = (SELECT max(deg) FROM deg)) AS top", base=True
)
def var_centres_large_ids(spark, sf):
    """Centres of a graph whose ids lie near 10^13: the first half draws from the 3c nodes of largest degree."""
    g, far = co_purchase(spark, sf), 10**13
    shifted = Graph(g.nodes.select((F.col("node") + far).alias("node")), g.edges.select((F.col("src") + far).alias("src"), (F.col("dst") + far).alias("dst")))
    order = shifted.deg.groupBy("deg").agg(F.count("*").alias("same")).withColumn("above", F.sum("same").over(Window.orderBy(F.desc("deg")).rowsBetween(Window.unboundedPreceding, -1)))
    drawn = variation.centres(shifted, 12, 1).join(shifted.deg, "node").join(order, "deg")
    each = drawn.groupBy("ind").agg(F.count("*").alias("c"), F.max(F.coalesce("above", F.lit(0))).alias("above"))
    top = shifted.deg.agg(F.max("deg").alias("deg")).join(order, "deg").select(F.col("same").alias("top"))
    return audit(each, (F.col("ind") < 6) & (F.col("above") >= 3 * F.col("c"))).crossJoin(F.broadcast(top))


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS broken FROM nodes")
def var_full_majority(spark, sf):
    votes = variation.parent_votes(population(spark, sf), spark.createDataFrame([(0, [0, 1, 2, 4])], "child int, parents array<int>"))
    return audit(variation.full_majority(votes, 1, 0).join(votes, ["child", "node"]), ~F.array_contains("labels", F.col("label")))


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS broken FROM nodes")
def var_graft(spark, sf):
    pop = population(spark, sf)
    a, b = (pop.where(F.col("ind") == i).select(F.lit(0).alias("child"), "node", "label") for i in (0, 2))
    made = variation.graft(a, b, 1, 1)
    both = made.join(a.withColumnRenamed("label", "la"), ["child", "node"]).join(b.withColumnRenamed("label", "lb"), ["child", "node"])
    return audit(both, (F.col("label") != F.col("la")) & (F.col("label") != F.col("lb")))


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS broken FROM nodes")
def var_uniform_crossover(spark, sf):
    g = co_purchase(spark, sf)
    locus = variation.random_locus(locus_candidates(g), 2, 1)
    a, b = (locus.where(F.col("ind") == i).select(F.lit(0).alias("child"), "node", "target") for i in (0, 1))
    both = variation.uniform_crossover(a, b, 1, 1).join(a.withColumnRenamed("target", "ta"), ["child", "node"]).join(b.withColumnRenamed("target", "tb"), ["child", "node"])
    return audit(both, (F.col("target") != F.col("ta")) & (F.col("target") != F.col("tb")))


@query("SELECT CAST(1 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS broken", base=False)
def var_macro_crossover(spark, sf):
    g = co_purchase(spark, sf)
    none = g.nodes.where("node < 0").select(F.lit(0).alias("child"), "node")
    one = g.nodes.where("node = 5").select(F.lit(0).alias("child"), "node")
    return audit(variation.macro_crossover(one, none, g.nodes, 0.0, 1, 1), F.col("node").isNull())


@query(WADJ + VOTES + "SELECT pop.ind, pop.node, coalesce(major.label, pop.label) AS label FROM pop LEFT JOIN major USING (ind, node)")
def var_majority_mutation(spark, sf):
    return variation.majority_mutation(population(spark, sf), weights(co_purchase(spark, sf)), 1.0, 1, 1)


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS broken FROM pop")
def var_neighbour_mutation(spark, sf):
    g, pop = co_purchase(spark, sf), population(spark, sf)
    moved = variation.neighbour_mutation(pop, g, 1.0, 1, 1)
    around = codec.weighted_votes(pop, codec.unit_weights(g)).select("ind", "node", "label", F.lit(True).alias("near"))
    return audit(moved.join(around, ["ind", "node", "label"], "left").join(g.deg, "node"), F.col("near").isNull() & (F.col("deg") > 0))


@query("SELECT CAST(500 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS broken", base=False)
def var_roulette(spark, sf):
    ranked = spark.createDataFrame([(i, i + 1) for i in range(20)], "ind int, pos int")
    return audit(variation.roulette(ranked, 500, 1, 1), ~F.col("ind").between(0, 19))


# label propagation and dense similarities


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS broken FROM nodes")
def propagate_labels(spark, sf):
    """Spread from every fiftieth part: each label is a part that bears it itself."""
    g = co_purchase(spark, sf)
    centres = g.nodes.where("node % 50 = 0").select(F.lit(0).alias("ind"), "node")
    found = codec.propagate(centres, g, codec.unit_weights(g))
    own = found.select(F.col("node").alias("label"), F.col("label").alias("label_of_label"))
    return audit(found.join(own, "label", "left"), F.col("label").isNull() | (F.col("label") != F.col("label_of_label")))


def nation_similarity(spark, sf):
    """``i, j, s``: a dense table of 25 x 25 made from the nations' keys."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    return n.select(F.col("k").alias("i")).crossJoin(F.broadcast(n.select(F.col("k").alias("j")))).select("i", "j", (1.0 / (1 + (F.col("i") * 7 + F.col("j") * 7) % 25) + F.when(F.col("i") == F.col("j"), 2.0).otherwise(0.0)).alias("s"))


NATIONS = "WITH s AS (SELECT CAST(a.n_nationkey AS BIGINT) AS i, CAST(b.n_nationkey AS BIGINT) AS j, 1.0 / (1 + (a.n_nationkey * 7 + b.n_nationkey * 7) % 25) + CASE WHEN a.n_nationkey = b.n_nationkey THEN 2.0 ELSE 0 END AS s FROM nation a, nation b) "


@query(NATIONS + "SELECT i AS node, j AS label FROM s WHERE j % 6 = 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY CASE WHEN i = j THEN 1e9 ELSE s END DESC, j) = 1", base=False)
def dense_decode(spark, sf):
    s = nation_similarity(spark, sf)
    centres = s.select(F.lit(0).alias("ind"), F.col("i").alias("node")).where("node % 6 = 0").distinct()
    return codec.dense_decode(s, centres).select("node", "label")


@query(NATIONS + "SELECT i % 4 AS label, i AS node FROM (SELECT i, round(sum(s), 9) AS t FROM s WHERE i % 4 = j % 4 GROUP BY i) QUALIFY row_number() OVER (PARTITION BY i % 4 ORDER BY t DESC, i) = 1", base=False)
def dense_encode(spark, sf):
    s = nation_similarity(spark, sf)
    pop = s.select(F.lit(0).alias("ind"), F.col("i").alias("node"), (F.col("i") % 4).alias("label")).distinct()
    return codec.dense_encode(s, pop).select("label", "node")


# detectors: their results have no SQL, so audits compare what must hold of any result


def groups(spark: SparkSession, sf_dir: str, least: int = 3) -> Graph:
    """Parts grouped by brand and size (at most 1,250 groups at any scale); groups that share at least ``least`` orders are tied."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.substring("p_brand", 7, 2).cast("long") * 100 + F.col("p_size")).alias("node"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey").select("l_orderkey", "node").distinct()
    a, b = (lines.select("l_orderkey", F.col("node").alias(x)) for x in ("src", "dst"))
    edges = a.join(b, "l_orderkey").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("orders")).where(F.col("orders") >= least).select("src", "dst")
    return Graph(parts.select("node").distinct(), materialize(edges, "edges"))


GROUPS = """
, gp AS (SELECT p_partkey, CAST(substr(p_brand, 7, 2) AS BIGINT) * 100 + p_size AS node FROM part), gl AS (SELECT DISTINCT l_orderkey AS o, node FROM lineitem JOIN gp ON p_partkey = l_partkey),
ge AS (SELECT a.node AS src, b.node AS dst FROM gl a JOIN gl b ON a.o = b.o AND a.node < b.node GROUP BY 1, 2 HAVING count(*) >= 3), gn AS (SELECT DISTINCT node FROM gp),
deg AS (SELECT node, count(v) AS deg FROM gn LEFT JOIN (SELECT src AS u, dst AS v FROM ge UNION ALL SELECT dst, src FROM ge) ON node = u GROUP BY node)
"""


def audited(partition: DataFrame, g: Graph) -> DataFrame:
    """One row: nodes, isolated ones, and what breaks the rules of a detected partition.

    Every node stands once; -1 marks just the isolated ones; communities are numbered from 0 in the order of
    their least nodes; modularity is that of some partition (at least -1/2, below 1).
    """
    rows = partition.join(g.deg, "node", "full")
    wrong = F.col("community").isNull() | F.col("deg").isNull() | ((F.col("community") == -1) != (F.col("deg") == 0)) | (F.col("community") < -1)
    named = partition.where("community >= 0").groupBy("community").agg(F.min("node").alias("least"))
    # a row for each community
    unordered = named.withColumn("place", F.row_number().over(Window.orderBy("least")) - 1).agg(F.count_if(F.col("place") != F.col("community")).alias("misnumbered"))
    q = objectives.modularity(partition.where("community >= 0"), g).select("q")
    one = rows.agg(F.count("*").alias("rows"), F.count_distinct("node").alias("nodes"), F.count_if(F.col("community") == -1).alias("isolated"), F.count_if(wrong).alias("broken"))
    return one.crossJoin(unordered).crossJoin(q).select("rows", "nodes", "isolated", "broken", "misnumbered", F.col("q").between(-0.5, 1.0).alias("q_valid"))


AUDITED = "SELECT count(*) AS rows, count(DISTINCT node) AS nodes, count(*) FILTER (deg = 0) AS isolated, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS misnumbered, true AS q_valid FROM deg"


def audited_front(front: DataFrame, g: Graph, names: tuple[str, ...]) -> DataFrame:
    """One row: whether every solution holds every node once, -1 just the isolated ones, and no solution dominates another."""
    solutions = front.select("sol_id").distinct()
    rows = front.join(g.deg, "node")
    wrong = (F.col("community") == -1) != (F.col("deg") == 0)
    expected = solutions.crossJoin(F.broadcast(g.nodes.agg(F.count("*").alias("n")))).agg(F.sum("n").alias("n"))
    held = rows.agg(F.count("*").alias("rows"), F.count_distinct("sol_id", "node").alias("distinct"), F.count_if(wrong).alias("broken")).crossJoin(expected)
    label = F.when(F.col("community") < 0, -1 - F.col("node")).otherwise(F.col("community"))
    objs = objectives.objectives(front.select(F.col("sol_id").alias("ind"), "node", label.alias("label")), g).withColumn("minus_q", -F.col("q"))
    objs = materialize(objs, "objectives")
    f = objs.select("ind", F.array(*[F.round(c, 9) for c in names]).alias("f"))
    # a front's solutions: a population's at most
    dominated = f.alias("a").join(F.broadcast(f.alias("b")), pareto.dominates(F.col("b.f"), F.col("a.f"))).agg(F.count("*").alias("dominated"))
    return held.crossJoin(dominated).select((F.col("rows") == F.col("n")).alias("whole"), (F.col("rows") == F.col("distinct")).alias("once"), "broken", "dominated")


WHOLE_FRONT = "SELECT true AS whole, true AS once, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS dominated"


def detector(name, f, params):
    dense = name.startswith("mmcomo")  # the dense kernel takes few nodes, so its graph has as many at any scale

    def run(spark, sf):
        return f(groups(spark, sf) if dense else co_purchase(spark, sf), **params)

    run.__name__ = f"detect_{name}"
    query()(run)
    if not name.endswith("_fronts"):

        def check(spark, sf):
            g = groups(spark, sf) if dense else co_purchase(spark, sf)
            return audited(f(g, **params), g)

        check.__name__ = f"audit_{name}"
        query((GROUPS.replace(", gp AS", "WITH gp AS", 1) if dense else "") + AUDITED, base=not dense)(check)


SMALL = {"pop_size": 12, "num_gens": 2}
for _name, _f in (detect.DETECTORS | detect.FRONTS).items():
    detector(_name, _f, SMALL | ({"gap": 2} if _name.startswith(("smocc", "mmcomo")) else {}) | ({"rand_networks": 1} if _name == "mocd_d" else {}))
detector("edge_parallel", detect.edge_parallel, {"pop_size": 6, "num_gens": 1})


def front_audit(name: str, objective_names: tuple[str, ...]):
    def check(spark, sf):
        g = groups(spark, sf) if name.startswith("mmcomo") else co_purchase(spark, sf)
        return audited_front(detect.FRONTS[name](g, **SMALL), g, objective_names)

    check.__name__ = f"audit_{name}"
    query(WHOLE_FRONT, base=False)(check)


for _name, _names in {"hpmocd_fronts": ("intra", "inter"), "krm_fronts": ("kkm", "rc", "minus_q"), "mmcomo_fronts": ("kkm", "rc")}.items():
    front_audit(_name, _names)


@query("SELECT * FROM (VALUES ('hpmocd', true, true), ('moga_net', true, true), ('smocc', true, true)) t(detector, above_floor, all_nodes)", base=False)
def karate_quality(spark, sf):
    """Modularity above 0.25 on the karate club by detectors run long enough to settle (40 individuals, 20 generations)."""
    g, _ = karate_club(spark)
    out = None
    for name in ("hpmocd", "moga_net", "smocc"):
        found = detect.DETECTORS[name](g, pop_size=40, num_gens=20, seed=1)
        row = objectives.modularity(found, g).select(F.lit(name).alias("detector"), (F.col("q") > 0.25).alias("above_floor"), (F.col("n") == 34).alias("all_nodes"))
        out = row if out is None else out.union(row)
    return out

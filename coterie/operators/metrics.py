"""Agreement of two partitions over their shared nodes.

Everything derives from the sparse contingency table.  The bundle gives zeros
without shared nodes; single metrics give the value of two trivial partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.functions.scalars import ln_factorial


def align(p: DataFrame, g: DataFrame) -> DataFrame:
    """``node, a, b`` of shared nodes."""
    return p.select("node", F.col("community").alias("a")).join(g.select("node", F.col("community").alias("b")), "node")


def contingency(p: DataFrame, g: DataFrame) -> DataFrame:
    """``a, b, nij`` of non-empty cells."""
    return align(p, g).groupBy("a", "b").agg(F.count("*").alias("nij"))


def marginals(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    return cells.groupBy("a").agg(F.sum("nij").alias("ai")), cells.groupBy("b").agg(F.sum("nij").alias("bj"))


def pairs(x: Column) -> Column:
    return x * (x - 1) / 2


#: Overlaps of two marginal sizes that one row sums.
BLOCK = 4096


def expected_mutual_information(cells: DataFrame) -> DataFrame:
    """One row ``emi``: exact under the hypergeometric model.

    A term depends on two marginal sizes only, so equal sizes are counted first:
    there are at most ``sqrt(2n)`` distinct ones on either side.  The possible
    overlaps of two sizes are cut into blocks, which are dealt to all tasks and
    summed inside a row.
    """
    rows, columns = marginals(cells)
    a = rows.groupBy("ai").agg(F.count("*").alias("ca"))
    b = columns.groupBy("bj").agg(F.count("*").alias("cb"))
    n = rows.agg(F.sum("ai").alias("n"))
    ai, bj, total = (F.col(c).cast("double") for c in ("ai", "bj", "n"))
    low = F.greatest(F.lit(1), F.col("ai") + F.col("bj") - F.col("n"))
    lf = ln_factorial
    fixed = lf(ai) + lf(bj) + lf(total - ai) + lf(total - bj) - lf(total)
    sizes = a.crossJoin(b).crossJoin(F.broadcast(n))
    blocks = sizes.select("ai", "ca", "bj", "cb", "n", fixed.alias("fixed"), F.explode(F.sequence(low, F.least("ai", "bj"), F.lit(BLOCK))).alias("first"))
    blocks = blocks.repartition(F.xxhash64("ai", "bj", "first"))

    def term(sum_: Column, x_: Column) -> Column:
        x = x_.cast("double")
        weight = F.exp(F.col("fixed") - lf(x) - lf(ai - x) - lf(bj - x) - lf(total - ai - bj + x))
        return sum_ + (x / total) * F.log(total * x / (ai * bj)) * weight

    overlaps = F.sequence(F.col("first"), F.least(F.col("ai"), F.col("bj"), F.col("first") + (BLOCK - 1)))
    return blocks.agg(F.coalesce(F.sum(F.col("ca") * F.col("cb") * F.aggregate(overlaps, F.lit(0.0), term)), F.lit(0.0)).alias("emi"))


def all_metrics(p: DataFrame, g: DataFrame) -> DataFrame:
    """One row: ``n, h_a, h_b, mi, emi, nmi, ami, ari, f1, homogeneity, completeness, v_measure``.

    ``a`` is ``p``, ``b`` is ``g``.  Defined at the edges: NMI is 1 if both
    entropies are 0; so is AMI, and 0 if its denominator vanishes; ARI is 1 for
    one node, 0 for none and 1 if its denominator vanishes; F1 is 1 without pairs.
    """
    cells = contingency(p, g)
    rows, columns = marginals(cells)
    n = F.col("n").cast("double")
    totals = rows.agg(F.coalesce(F.sum("ai"), F.lit(0)).alias("n"))
    entropy = lambda x: -F.sum(x / n * F.log(x / n))
    side = lambda df, x, h, c: df.crossJoin(F.broadcast(totals)).agg(F.coalesce(entropy(F.col(x)), F.lit(0.0)).alias(h), F.coalesce(F.sum(pairs(F.col(x).cast("double"))), F.lit(0.0)).alias(c))
    joined = cells.join(rows, "a").join(columns, "b").crossJoin(F.broadcast(totals))
    nij, ai, bj = (F.col(c).cast("double") for c in ("nij", "ai", "bj"))
    inner = joined.agg(F.coalesce(F.sum(nij / n * F.log(n * nij / (ai * bj))), F.lit(0.0)).alias("mi"), F.coalesce(F.sum(pairs(nij)), F.lit(0.0)).alias("tp"))
    one = totals.crossJoin(side(rows, "ai", "h_a", "pa")).crossJoin(side(columns, "bj", "h_b", "pb")).crossJoin(inner).crossJoin(expected_mutual_information(cells))
    mean = (F.col("h_a") + F.col("h_b")) / 2
    denominator = mean - F.col("emi")
    ami = F.when(mean == 0, 1.0).when(F.abs(denominator) < 1e-15, 0.0).otherwise((F.col("mi") - F.col("emi")) / denominator)
    expected = F.when(n > 1, F.col("pa") * F.col("pb") / pairs(n)).otherwise(0.0)
    spread = (F.col("pa") + F.col("pb")) / 2 - expected
    ari = F.when(n == 0, 0.0).when(F.abs(spread) < 1e-15, 1.0).otherwise((F.col("tp") - expected) / spread)
    f1 = F.when(F.col("pa") + F.col("pb") == 0, 1.0).otherwise(2 * F.col("tp") / (F.col("pa") + F.col("pb")))
    share = lambda h: F.when(F.col(h) == 0, 1.0).otherwise(F.col("mi") / F.col(h))
    done = one.select("n", "h_a", "h_b", "mi", "emi", F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean).alias("nmi"), ami.alias("ami"), ari.alias("ari"), f1.alias("f1"), share("h_b").alias("homogeneity"), share("h_a").alias("completeness"))
    both = F.col("homogeneity") + F.col("completeness")
    return done.withColumn("v_measure", F.when(both == 0, 0.0).otherwise(2 * F.col("homogeneity") * F.col("completeness") / both))


def gt_metrics(p: DataFrame, g: DataFrame) -> DataFrame:
    """One row ``nmi, ami, ari, f1``; zeros if no node is shared."""
    return all_metrics(p, g).select(*[F.when(F.col("n") == 0, 0.0).otherwise(F.col(c)).alias(c) for c in ("nmi", "ami", "ari", "f1")])


def metric(name: str, p: DataFrame, g: DataFrame) -> DataFrame:
    """One row with the one metric, without a guard for no shared nodes."""
    return all_metrics(p, g).select(name)


def nmi(p: DataFrame, g: DataFrame) -> DataFrame:
    return metric("nmi", p, g)


def ami(p: DataFrame, g: DataFrame) -> DataFrame:
    return metric("ami", p, g)


def ari(p: DataFrame, g: DataFrame) -> DataFrame:
    return metric("ari", p, g)


def f1(p: DataFrame, g: DataFrame) -> DataFrame:
    return metric("f1", p, g)

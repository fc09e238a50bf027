"""Document fingerprints by closed syncmers, in DataFrame functions only.

A text's words (cut at ASCII white space) form k-mers of ``K`` words; a k-mer is
an anchor if the least hash of its inner ``S``-word substrings stands at either
edge.  Whether a k-mer is an anchor depends on its own words alone, so equal
passages give equal anchors wherever they stand, and any run of ``K - S``
consecutive k-mers holds one.  A fingerprint is the sequence of anchor hashes in
text order; ``K - 1`` marks on either side give short texts anchors too.

Anchors keep their places, so two texts can be matched by position:
``likeness`` compares the sets of anchors, ``alignment`` counts the shared ones
that follow the shared one before them in both texts.

Defined results: null and empty texts (and white space alone) have no anchors
and an empty fingerprint; two empty fingerprints are alike and aligned (1.0), an
empty and another one are not (0.0); an anchor that a text holds several times
counts once, at its first place; rows with a null id come last in descending
order; rows of one id follow a hash of their texts, equal ones any order; an
empty table gives none; columns besides the key and the text are not read,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coterie.llm.common import text_or_empty

K, S = 5, 2
#: Rows of one ordering bucket, about, and the most buckets (their bounds reach the driver; beyond, buckets grow).
BUCKET_ROWS, MOST_BUCKETS = 500, 65_536


def least_of(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


PLACE = (1 << 31) - 1


def bind(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers in text order: 31 bits of hash, then 32 bits that hold the place of the k-mer."""
    if not 0 < s < k:
        raise ValueError("s must be less than k")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    marks = F.array(*[F.lit(i).cast("long") for i in range(k - 1)])
    hashes = F.concat(marks, F.transform(words, lambda w: F.xxhash64(w)), marks)

    def shifted(a: Column, count: int) -> list[Column]:
        n = F.size(a) - (count - 1)
        return [F.slice(a, F.lit(i + 1), F.greatest(n, F.lit(0))) for i in range(count)]

    def zipped(a: Column, count: int, names: list[str]) -> Column:
        return F.arrays_zip(*[x.alias(name) for x, name in zip(shifted(a, count), names, strict=True)])

    def inner(h: Column) -> Column:
        names = [str(i) for i in range(s)]
        return F.transform(zipped(h, s, names), lambda x: F.xxhash64(*[x[n] for n in names]))

    def choose(h: Column) -> Column:
        w = k - s + 1
        names = [str(i) for i in range(w)]
        # every s-th inner hash, and the last: together they cover all words of the k-mer
        cover = sorted({*range(0, w, s), w - 1})
        n = F.greatest(F.size(h) - (w - 1), F.lit(0))
        places = F.slice(F.sequence(F.lit(0), F.size(h)), F.lit(1), n)
        windows = F.arrays_zip(*[x.alias(name) for x, name in zip(shifted(h, w), names, strict=True)], places.alias("at"))
        edge = lambda x: F.least(x["0"], x[str(w - 1)]) <= least_of([x[n] for n in names[1:-1]] or [x["0"]])
        value = lambda x: F.shiftleft(F.xxhash64(*[x[str(i)] for i in cover]).bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(x["at"].cast("long"))
        return F.transform(F.filter(windows, edge), value)

    found = bind(hashes, lambda h: bind(inner(h), choose))
    return F.when(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), found).otherwise(F.array().cast("array<bigint>"))


def hashes(found: Column) -> Column:
    """The anchors' hashes (31 bits, the top one of 32 set)."""
    return F.transform(found, lambda x: F.shiftright(x, 32).bitwiseOR(F.lit(0x80000000)))


def fingerprint(found: Column) -> Column:
    """The anchors as eight hex digits each."""
    return F.lower(F.array_join(F.transform(hashes(found), lambda x: F.hex(x)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct anchors over the mean number of distinct anchors of both (0 to 1); ``a`` and ``b`` are hashes."""
    shared, total = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * shared / F.greatest(total, F.lit(1)))


def neighbours(a: Column, body) -> Column:
    """``body`` of each element and the next one."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n), body)


def matches(a: Column, b: Column) -> Column:
    """Places of each shared anchor in both texts (its first ones), by its place in ``a``: 31 bits each in one number."""
    side = F.lit(1 << 31)
    # by hash; in each, first those of a by falling place, then those of b by rising place: the first places stand side by side
    of_a = F.transform(a, lambda x: x.bitwiseOR(F.lit(PLACE)) - x.bitwiseAND(F.lit(PLACE)))
    of_b = F.transform(b, lambda x: x.bitwiseOR(side))

    def pair(x: Column, y: Column) -> Column:
        hit = (F.shiftright(x, 32) == F.shiftright(y, 32)) & (x.bitwiseAND(side) == 0) & (y.bitwiseAND(side) != 0)
        places = F.shiftleft(F.lit(PLACE) - x.bitwiseAND(F.lit(PLACE)), 31).bitwiseOR(y.bitwiseAND(F.lit(PLACE)))
        return F.when(hit, places).otherwise(F.lit(-1).cast("long"))

    met = bind(F.sort_array(F.concat(of_a, of_b)), lambda all_: neighbours(all_, pair))
    return F.sort_array(F.filter(met, lambda x: x >= 0))


def alignment(a: Column, b: Column, total: Column) -> Column:
    """Shared anchors in the order of both texts, over the mean number of distinct anchors (0 to 1).

    A shared anchor counts if it stands, in both texts, after the shared anchor before it; the first one counts.
    ``total`` is the number of distinct anchors of both together.
    """
    place = lambda x: x.bitwiseAND(F.lit(PLACE))
    kept = lambda m: F.when(F.size(m) == 0, 0).otherwise(1 + F.size(F.filter(neighbours(m, lambda x, y: place(y) > place(x)), lambda up: up)))
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * bind(matches(a, b), kept) / F.greatest(total, F.lit(1)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """``key, anchors array<long>`` for every row: see ``anchors``."""
    return docs.select(F.col(key), text_or_empty(text).alias("__text")).select(key, anchors(F.col("__text"), k, s).alias("anchors"))


def in_order(docs: DataFrame, key: str, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, Window]:
    """``docs`` in key buckets, and the window in which every row's next row by descending key follows it.

    Buckets are quantile ranges of the key.  The first row of each bucket is
    repeated (``__ghost``) as the last row of the bucket that ends before it, and
    the very first row as the last of all, so that no window spans the table.
    """
    rows = docs.count()
    parts = min(MOST_BUCKETS, -(-rows // bucket_rows))
    bounds = sorted(set(docs.approxQuantile(key, [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    if bounds:
        from pyspark.ml.feature import Bucketizer

        given = docs.withColumn("__at", F.coalesce(F.col(key).cast("double"), F.lit(0.0)))
        cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="__at", outputCol="__cut").transform(given)
        bucket = F.col("__cut").cast("int")
    else:
        cut, bucket = docs, F.lit(0)
    cut = cut.withColumn("__bucket", F.when(F.col(key).isNull(), -1).otherwise(bucket)).drop("__at", "__cut")
    # one row for each bucket
    tops = sorted((r["__bucket"], r["top"]) for r in cut.groupBy("__bucket").agg(F.max(key).alias("top")).collect())
    after = [tops[(i + 1) % len(tops)][0] for i in range(len(tops))]
    schema = f"__bucket int, __top {docs.schema[key].dataType.simpleString()}, __after int"
    table = F.broadcast(docs.sparkSession.createDataFrame([(b, top, n) for (b, top), n in zip(tops, after, strict=True)], schema))
    first = F.col(key).eqNullSafe(F.col("__top"))
    places = F.when(first, F.array("__bucket", "__after")).otherwise(F.array("__bucket"))
    dealt = cut.join(table, "__bucket", "left").select(*docs.columns, F.posexplode(places).alias("__ghost", "__bucket"))
    return dealt, Window.partitionBy("__bucket").orderBy("__ghost", F.desc_nulls_last(key), "__tie")


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of every text and of its edit, and their likeness to each other and to the next text's.

    The edit replaces the last third of the code points by the first ones of the
    next text in descending order of the key (after the last: the first).
    """
    rows = docs.select(F.col(key), text_or_empty(text).alias("__text")).withColumn("__tie", F.xxhash64("__text"))
    dealt, order = in_order(rows, key)
    follow = dealt.withColumn("__next", F.coalesce(F.lead("__text").over(order), F.lit(""))).withColumn("n_chars", F.char_length("__text").cast("long"))
    third = F.expr("cast(n_chars div 3 as int)")
    edited = F.concat(F.substring(F.col("__text"), F.lit(1), F.col("n_chars").cast("int") - third), F.substring(F.col("__next"), F.lit(1), third))
    made = follow.withColumn("__edited", edited)
    marked = made.select(key, "__ghost", "__bucket", "__tie", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), anchors(F.col("__text"), k, s).alias("__a"), anchors(F.col("__edited"), k, s).alias("__e"))
    # same window: no further shuffle or sort
    paired = marked.withColumn("__n", F.lead("__a").over(order)).where("__ghost = 0")
    a, e, n = (F.col(c) for c in ("__a", "__e", "__n"))
    hashed = paired.select(key, "n_chars", "edited_sha256", "__a", "__e", "__n", *[hashes(x).alias(h) for x, h in ((a, "__ha"), (e, "__he"), (n, "__hn"))])
    distinct = hashed.select("*", *[F.size(F.array_distinct(h)).alias(c) for h, c in (("__ha", "__da"), ("__he", "__de"), ("__hn", "__dn"))])
    ha, he, hn = (F.col(c) for c in ("__ha", "__he", "__hn"))
    hexed = lambda h: F.lower(F.array_join(F.transform(h, lambda x: F.hex(x)), ""))

    def near(h: Column, count: str) -> Column:
        total = F.col("__da") + F.col(count)
        return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(ha, h)) / F.greatest(total, F.lit(1)))

    return distinct.select(
        key,
        "n_chars",
        "edited_sha256",
        hexed(ha).alias("fingerprint"),
        hexed(he).alias("edited_fingerprint"),
        near(he, "__de").alias("near_edited"),
        near(hn, "__dn").alias("near_next"),
        alignment(a, e, F.col("__da") + F.col("__de")).alias("aligned_edited"),
        alignment(a, n, F.col("__da") + F.col("__dn")).alias("aligned_next"),
    )

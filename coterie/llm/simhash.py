"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; each is set if it is set in over half of the XXH64
values of the text's 3-word shingles.  Two fingerprints within ``radius`` bits
have a common variant within half of it from both, so every distinct fingerprint
emits all variants in its half-radius ball, the shuffle brings equal variants
together, and colliding pairs are deduplicated and verified.  Within a variant
each member is tied to the smallest one only: members of one ball are within the
radius of each other, so no link between components is lost and no group is
expanded into pairs.

Defined results: texts of fewer than three words hash their whole word sequence;
no words (and null) give fingerprint zero, linked like any other; repeated rows
get the same component; a null id gets its fingerprint's component, and the
smallest id of a component ignores nulls.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coterie.llm.common import materialize, prepare, rows_in_slices
from coterie.llm.components import connected_components

WORDS = 3
SEED = 42
RADIUS = 2


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit number."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[start : start + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp long`` for every row."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text"))

    def run(batches):
        for whole in batches:
            for batch in rows_in_slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x or b"") for x in batch.column(1).to_pylist()], pa.int64())], ["key", "fp"])

    return source.mapInArrow(run, T.StructType([T.StructField("key", source.schema["key"].dataType), T.StructField("fp", T.LongType())]))


def ball(radius: int) -> list[int]:
    """Bit masks (signed) of up to ``radius`` of 64 bits."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``a, b`` that connect distinct fingerprints ``fp`` within an even ``radius``."""
    if radius % 2:
        raise ValueError("radius must be even")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    # a fixed number of partitions: few bytes become many variants, so AQE must not merge them (by another
    # expression than the key, or Spark would drop this shuffle and keep the merged one before it)
    spread = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.hash("fp"))
    variants = spread.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    # a variant's group holds at most the size of the ball: fingerprints are distinct
    groups = variants.groupBy("variant").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    pairs = groups.select(F.array_min("members").alias("b"), F.explode("members").alias("a")).where("a <> b")
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(key, fp)`` of every row, ``(fp, root)`` of every fingerprint, ``(root, component_id)`` of every component.

    ``root`` is the fingerprint that names a component, ``component_id`` its smallest key.
    """
    rows = materialize(fingerprints(docs, key, text), "simhash")
    prints = rows.groupBy("fp").agg(F.min("key").alias("least"))
    roots = materialize(connected_components(links(prints.select("fp"), radius)), "simhash-roots")
    of_print = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return rows, of_print.select("fp", "root"), of_print.groupBy("root").agg(F.min("least").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp, component_id`` for every row: the smallest key reachable over links."""
    rows, of_print, of_root = components(docs, radius, key, text)
    return rows.join(of_print.join(of_root, "root"), "fp").select(F.col("key").alias(key), "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def row_identity(docs: DataFrame) -> Column:
    """A name of each row: no id last, then the id, then hashes of the whole row; equal rows share it."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, and every row of another component stays.

    Rows are told apart by all their columns (of hashable types), not by their id: kept is the row of
    the smallest ``doc_id`` (none last), among those the one whose row hash is least; of equal rows one.
    """
    name = row_identity(docs)
    rows, of_print, of_root = components(docs.select(name.alias("row"), "text"), radius, "row")
    kept = of_root.select(F.col("component_id").alias("__coterie_row"))
    # a kept row that the table holds several times comes once
    many = rows.groupBy(F.col("key").alias("__coterie_row")).agg(F.count("*").alias("n")).where("n > 1").select("__coterie_row")
    kept = materialize(kept.join(many.withColumn("__coterie_many", F.lit(True)), "__coterie_row", "left"), "simhash-kept")
    named = docs.withColumn("__coterie_row", name)
    once = named.join(kept.where("__coterie_many is null"), "__coterie_row", "left_semi").select(docs.columns)
    equal = named.join(kept.where("__coterie_many"), "__coterie_row", "left_semi").groupBy("__coterie_row").agg(F.first(F.struct(*docs.columns)).alias("row"))
    return once.unionByName(equal.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))

"""Packing token sequences by shortest-pack-first over the length histogram.

``pieces`` tokenizes documents, adds an end id and cuts what is longer than a
sequence; ``pack`` places pieces.  The driver sees only the histogram of lengths
(at most ``size`` rows): lengths are placed longest first, each into the packs
with the most space left, as counts of packing patterns.  Every pattern position
then owns a range of ranks among the pieces of its length, and each piece finds
its sequence and offset from its rank.  A hot length is ranked in salted buckets
whose sizes are summed, so no task holds all pieces of one length: n of them make
buckets of the root of n, at least ``BUCKET``, so neither a bucket nor the list
of buckets grows faster than that.

Defined results: null and empty texts are one end id; repeated rows and rows that
share an id or have none are packed each; an empty table packs to nothing; other
columns, whatever their names, are not read.  Ranks follow the salt, the key, the
start, then the other numbers of a piece; pieces equal in all are interchangeable.
"""

from __future__ import annotations

import heapq
import math
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from coterie.llm.bpe import SLICE, codec, default_vocabulary, ids_array
from coterie.llm.common import in_fewer_files, materialize, prepare, rows_in_slices, text_or_empty

SIZE = 2048
END = 1
#: Pieces of one length that are ranked together in a task, at least.
BUCKET = 200


def pieces(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens`` (and ``ids`` if asked): one row for each piece.

    A document's ids end with ``END``; cuts fall at multiples of ``size``.
    """
    prepare(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    source = docs.select(F.col(key).alias("key"), text_or_empty(text).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("key", source.schema["key"].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    end = np.array([END], "<i4").tobytes()

    def run(batches):
        c = codec(path)
        for whole in batches:
            for batch in rows_in_slices(whole, "text", SLICE):
                rows, start, cut, total = [], [], [], []
                for row, ids in enumerate(c.encode_all(batch.column(1).to_pylist())):
                    ids += end
                    for at in range(0, len(ids), 4 * size):
                        rows.append(row)
                        start.append(at // 4)
                        cut.append(ids[at : at + 4 * size])
                        total.append(len(ids) // 4)
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, [len(x) // 4 for x in cut], map(zlib.crc32, cut), total))]
                yield pa.RecordBatch.from_arrays(columns + [ids_array(cut)] * keep_ids, schema.names)

    return source.mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)`` of each packing pattern; together they hold the histogram exactly."""
    by_space: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    spaces: list[int] = []  # a heap of the spaces that have packs, most first
    done: list[tuple[int, tuple[int, ...]]] = []

    def add(space: int, count: int, pattern: tuple[int, ...]) -> None:
        if space == 0:
            done.append((count, pattern))
            return
        if space not in by_space:
            by_space[space] = []
            heapq.heappush(spaces, -space)
        by_space[space].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = -spaces[0] if spaces else 0
            if space < length:
                # new packs, each filled before the next is opened: it is the one with the most space left
                each = size // length
                full, rest = divmod(left, each)
                if full:
                    add(size - each * length, full, (length,) * each)
                if rest:
                    add(size - rest * length, 1, (length,) * rest)
                break
            count, pattern = by_space[space].pop()
            taken = min(count, left)
            if count > taken:
                by_space[space].append((count - taken, pattern))
            if not by_space[space]:
                heapq.heappop(spaces)
                del by_space[space]
            add(space - length, taken, (*pattern, length))
            left -= taken
    return done + [x for space in sorted(by_space) for x in by_space[space]]


def slots(patterns: list[tuple[int, tuple[int, ...]]], histogram: dict[int, int]) -> tuple[dict[int, int], np.ndarray]:
    """First place of each length, and a row ``(first place, first sequence, offset, packs, length)`` for each run of
    equal lengths in a pattern.

    Places number all pieces, by length and rank; a run's places go round its packs.  The distinct lengths of a pattern
    sum to at most its size, so there are few runs.
    """
    base, at = {}, 0
    for length in sorted(histogram):
        base[length] = at
        at += histogram[length]
    used = dict.fromkeys(histogram, 0)
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, run in groupby(pattern):
            times = len(list(run))
            rows.append((base[length] + used[length], sequence, offset, count, length))
            used[length] += count * times
            offset += length * times
        sequence += count
    return base, np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``parts`` (``key, start, length, ...`` with lengths 1 to ``size``) with ``sequence_id`` and ``offset``."""
    prepare(parts.sparkSession)
    spark = parts.sparkSession
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < x <= size for x in histogram):
        raise ValueError(f"lengths must be 1 to {size}")
    base, table = slots(shortest_pack_first(histogram, size), histogram)
    # at most `size` rows: one for each length
    salts = F.broadcast(spark.createDataFrame([(x, -(-n // max(BUCKET, math.isqrt(n))), base[x]) for x, n in histogram.items()], "length long, __salts long, __base long"))
    numbers = [c for c, kind in parts.dtypes if kind == "bigint" and c not in ("key", "start", "length")]
    # rows that share a key (or lack one) are told apart by their numbers, so they spread too
    salted = parts.join(salts, "length").withColumn("__salt", F.pmod(F.xxhash64("key", "start", *numbers), "__salts"))
    ranked = salted.withColumn("__rank", F.row_number().over(W.Window.partitionBy("length", "__salt").orderBy("key", "start", *numbers)))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "__salt", (F.sum("n").over(W.Window.partitionBy("length").orderBy("__salt")) - F.col("n")).alias("__before"))
    placed = ranked.join(before, ["length", "__salt"]).withColumn("__place", F.col("__base") + F.col("__before") + F.col("__rank") - 1).select(*parts.columns, "__place")
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        firsts = table[:, 0]
        for batch in batches:
            place = batch.column(batch.num_columns - 1).to_numpy()
            first, sequence, offset, packs, length = table[np.searchsorted(firsts, place, side="right") - 1].T
            turn, pack = np.divmod(place - first, packs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence + pack), pa.array(offset + turn * length)], schema.names)

    return placed.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row for each piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    parts = materialize(in_fewer_files(pieces(docs, size, key, text, vocabulary)), "pieces")
    return pack(parts, size).withColumnRenamed("key", key)

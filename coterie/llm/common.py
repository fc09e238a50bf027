"""Shared helpers: scratch tables, worker caches, Arrow slices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.scratch import drop_path, materialize, prepare, scratch_path, store

__all__ = ["Memo", "drop_path", "in_fewer_files", "materialize", "prepare", "rows_in_slices", "scratch_path", "store", "table", "text_or_empty"]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input, by Spark's estimate, that a task has at least where a table is stored in fewer files.
TASK_BYTES = 8 << 20


def in_fewer_files(df: DataFrame) -> DataFrame:
    """``df`` without very small partitions, which would each be a file with its own buffers.

    Partitions are joined, without a shuffle, until each stands for ``TASK_BYTES`` of the plan's estimated size
    or there are two for each core; larger partitions stay as they are.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(min(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), (1 << 31) - 1))


class Memo(dict):
    """A memo bounded by bytes: two generations of about ``most_bytes`` each.

    ``memo[key]`` computes missing values with ``fill``; ``keep`` adds values.
    When the young generation is full it becomes the old one, so memory stays
    bounded and frequent keys survive.  Keys longer than ``LONGEST`` are never
    kept.  It changes speed only, never values.
    """

    LONGEST = 200
    #: Bytes of an entry besides its characters: two objects and their place in the table.
    ENTRY = 150

    def __init__(self, fill, most_bytes: int):
        super().__init__()
        self.fill, self.most_bytes, self.bytes, self.old = fill, most_bytes, 0, {}

    def keep(self, items: dict) -> None:
        """Add ``items``."""
        longest, entry, most, held = self.LONGEST, self.ENTRY, self.most_bytes, self.bytes
        for key, value in items.items():
            n = len(key)
            if n > longest:
                continue
            held += entry + 2 * n + (len(value) if type(value) is bytes else 0)
            if held > most:
                self.old, held = dict(self), entry + 2 * n
                self.clear()
            self[key] = value
        self.bytes = held

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.fill(key)
        self.keep({key: value})
        return value


def rows_in_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20):
    """Cut a record batch into slices whose ``column`` holds about ``max_bytes``.

    Bounds a worker's temporaries when texts are long; a single longer text is
    a slice of its own.
    """
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        limit = (ends[start - 1] if start else 0) + max_bytes
        stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


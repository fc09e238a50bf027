"""A stream of edges kept as a deduplicated table, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from coterie.sources.graphs import canonical_edges


def append_edges(stream: DataFrame, table_path: str, checkpoint: str):
    """Start a query that adds each micro-batch's new edges to the Parquet table at ``table_path``.

    ``stream`` has ``src, dst``.  A batch is canonicalised and anti-joined with
    the table, so replayed batches add nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = canonical_edges(batch)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.schema("src long, dst long").parquet(table_path), ["src", "dst"], "left_anti")
        new.write.mode("append").parquet(table_path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Scratch tables in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


#: Bytes of an Arrow batch to a Python worker, where the session has Spark's own default of four times as much.
BATCH_KEY, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's source tree, and bound their batches.

    On a cluster without a shared source tree ship the package with
    ``--py-files``; this only adds the driver's path to the workers' search path.
    A batch holds thousands of rows, which may be long texts; a session that sets
    its own bound keeps it.
    """
    default = f"{BATCH_DEFAULT}b"
    if spark.conf.get(BATCH_KEY, default) == default:
        spark.conf.set(BATCH_KEY, f"{BATCH}b")
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="coterie-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/coterie-{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back: cuts lineage and survives the loss of any executor."""
    return store(df, name)[0]


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``materialize``, with the table's path for ``drop_path``."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system, whatever its scheme."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)

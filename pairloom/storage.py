"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where it is unset, a local session gets a temporary folder, as in tests; on a cluster that would be a folder of one
    machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pairloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then
        pass


_scratch: list[str] = []


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder, removed by ``clear_scratch`` or when the driver ends."""
    path = f"{shared_dir(spark)}/pairloom-{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    atexit.register(_remove, spark, path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Remove the tables that this driver wrote to the shared folder; the number of paths.

    For a driver that runs one query after another: call it once a result has been written or collected. Plans that still
    read such a table fail afterwards, so nothing calls it of its own accord.
    """
    gone = [p for p in _scratch if "-code-" not in p]
    for path in gone:
        _remove(spark, path)
        _scratch.remove(path)
    return len(gone)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the plan is cut and a lost executor loses nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session has cores, if its files come in fewer pieces: for work on each row that costs
    far more than moving it once. Tables of any size come in more pieces by themselves and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)

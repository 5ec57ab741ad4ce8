"""Cutting lineage: a table written once to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import threading
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Cuts made inside each settled() that runs, by thread: queries that run at once don't see each other's.
_MADE = threading.local()


def _open() -> list[list[DataFrame]]:
    if not hasattr(_MADE, "stack"):
        _MADE.stack = []
    return _MADE.stack


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary one in local mode, where all is one process; on a cluster that would be a folder of one machine, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, few: bool = False) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: later readers recompute nothing, and lost executors lose nothing.

    few: at most two files for each core of the cluster, for tables much smaller than their input.
    """
    spark = df.sparkSession
    if few:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if _open():
        _open()[-1].append(out)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, cut; the cuts made on the way are deleted, as nothing reads them any longer."""
    made: list[DataFrame] = []
    _open().append(made)
    try:
        df = make()
    finally:
        _open().pop()
    out = cut(df)
    for one in made:
        drop_cut(one)
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a cut() that nothing reads any longer."""
    path = getattr(df, "_cut_path", None)
    if path:
        drop_path(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it comes in fewer partitions than that, as a small table in one file does; a table of many partitions stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df

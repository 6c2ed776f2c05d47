"""Cutting long lineages: tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables that are cut within ``passing``: each thread's own.
_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what the context was given, or spark.checkpoint.dir."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a compressed table of columns in the shared folder; it goes at the session's end, or with ``passing``."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    path, files = _path(spark, at)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    if (made := getattr(_open, "made", None)) is not None:
        made[at] = out
    return out


@contextlib.contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Around steps whose tables are read by later ones within only: all that are cut here go at the end, but those given to what is yielded."""
    outer, made, kept = getattr(_open, "made", None), {}, []
    _open.made = made

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        _open.made = outer
        for at, table in made.items():
            if not any(table is k for k in kept):
                path, files = _path(table.sparkSession, at)
                files.delete(path, True)
            elif outer is not None:
                outer[at] = table
        if made:  # Spark deletes shuffle files of finished steps only after the driver's garbage collection
            table.sparkSession.sparkContext._jvm.System.gc()

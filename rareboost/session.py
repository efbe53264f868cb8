"""Session helpers: staged tables in the shared checkpoint folder, and short-lived caches."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for staged tables.

    The cluster names a shared folder in ``spark.checkpoint.dir``; only a local
    session that names none gets a temporary folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="rareboost-checkpoint-")
        sc.setCheckpointDir(named)
    return named


def _app_folder(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"rareboost-{spark.sparkContext.applicationId}")


def staged_path(spark: SparkSession) -> str:
    """A new folder among the staged tables; ``drop_staged_tables`` removes it with them."""
    return os.path.join(_app_folder(spark), uuid.uuid4().hex)


#: Whether a query's shuffle files are deleted with its end and not with the garbage collection of its plan.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, keeps column pruning, and gives
    the planner the measured size of the table. The shuffle files of the write go
    when it is done, as nothing can read them any more.
    """
    spark = df.sparkSession
    path = staged_path(spark)
    schema = df.schema
    kept = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if kept is None else spark.conf.set(_CLEANUP, kept)
    out = spark.read.schema(schema).parquet(path)
    out._staged_path = path
    return out


def is_staged(df: DataFrame) -> bool:
    """Whether ``df`` is a staged table, or was named a narrow view of one by ``as_staged``."""
    return hasattr(df, "_staged_path")


def as_staged(df: DataFrame) -> DataFrame:
    """Name ``df`` a narrow view of a staged table: reading it again is one scan, so it needs no copy of its own."""
    df._staged_path = None
    return df


def still_staged(df: DataFrame) -> bool:
    """Whether the files of a staged table are there."""
    spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


#: Bytes of input per core up to which a table counts as small.
SMALL = 16 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a small table that lies in fewer files than there are cores out to all of them, by ``keys``.

    A file is often one row group, which a single task reads; what is computed and
    staged from it would stay in that task. Tables of many files, and large ones in
    few files, which Spark splits by itself, are left as they are, so nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    small = len(files) < cores and sum(_length(df.sparkSession, f) for f in files) < cores * SMALL
    return df.repartition(cores, *keys) if small else df


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)


def drop_staged_tables(spark: SparkSession) -> None:
    """Delete every table this application has staged; call it when no result is needed any more."""
    _delete(spark, _app_folder(spark))


def _length(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).getLen()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tracks cached frames of one step so that they are dropped together."""

    def __init__(self) -> None:
        self._frames: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._frames.append(df)
        return df

    def release(self) -> None:
        for df in self._frames:
            df.unpersist()
        self._frames.clear()

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *exc) -> None:
        self.release()

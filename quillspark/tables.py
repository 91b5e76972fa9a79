"""Tables: intermediate ones that outlive lost executors, small ones that come in few files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where none is named, one is set if driver and executors are one process (tests); on a cluster that is an error, as
    what one machine wrote to a folder of its own the others would not find.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillspark-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path for a table of this run."""
    return f"{_run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes the tables that this run has in the shared folder; results that are still to be read from them are gone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and Spark knows its size."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores if its files give fewer, so that a small table in one file is not one task's work.

    Tables that fill the cores stay as they are read: no text is shuffled for this at scale.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def pieces(df: DataFrame, each: int, most: int = 10_000) -> int:
    """How many partitions df fills with so many bytes, by Spark's estimate of its size, and one for each core at least.

    What a task holds stays the same then however large df is: adaptive execution joins small partitions, by their bytes
    as compressed, but splits none.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(df.sparkSession.sparkContext.defaultParallelism, size // each), most)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df shuffled by keys to as many partitions as the session shuffles to. For few bytes that cost much time: by their size alone, adaptive execution would put them into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

"""Session helpers: the shared folder, lineage cuts and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Least stored bytes a partition is made for.
SPREAD_BYTES = 512 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory (one file or a folder of part files), spread over the cores if it comes in too few pieces."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """`df`, read from files, with as many partitions as there are cores if its files give fewer and are large enough for more.

    A Parquet file of one row group is one task however much work its texts are; dealing a small table out costs less. Tables of as many pieces as cores, so any large table, stay as they are.
    """
    spark = df.sparkSession
    cores, have = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if have >= cores:
        return df
    jvm, conf, size = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for f in df.inputFiles()[: 4 * cores]:
        p = jvm.org.apache.hadoop.fs.Path(f)
        size += p.getFileSystem(conf).getFileStatus(p).getLen()
    want = min(cores, size // SPREAD_BYTES)
    return df.repartition(int(want)) if want > have else df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in spark.checkpoint.dir.

    Only where the setting is missing (local mode, tests) is a folder of our own made, and set as checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="prosewright-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, *keys: str) -> DataFrame:
    """`df` partitioned by keys and cut from its lineage, such that later plans know the partitioning and need no shuffle for windows or sums by these keys.

    An adaptive plan forgets its partitioning at a checkpoint, so this one is made without.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), *keys))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def _own_folder(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"prosewright-{spark.sparkContext.applicationId}")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in this application's part of it."""
    return os.path.join(_own_folder(spark), f"{name}-{uuid.uuid4().hex}")


def clean_up(spark: SparkSession) -> None:
    """Deletes what `stored` and `shared_path` of this application have written. Only when no result that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: computed once, and safe against lost executors."""
    path = shared_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

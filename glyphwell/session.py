"""Session settings and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", name: str = "glyphwell") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    single-machine session gets a temporary folder; on a cluster that would be
    local to one machine, so it is an error there.
    """
    context = spark.sparkContext
    if current := context.getCheckpointDir():
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"glyphwell-{os.getpid()}")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A small table in as many partitions as there are cores, for costly expressions; one with as many of its own is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that clash with none of ``df``, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out

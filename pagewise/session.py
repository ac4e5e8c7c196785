"""Sessions, and results that are computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine; on a cluster, the session that is there is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagewise")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset, a folder of our own, on this machine alone: on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagewise-checkpoint-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Compute df once and write it to the checkpoint folder: what is read by several branches must not run several times."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if a scan has fewer partitions than there are cores: a file of one row group is one task, however long its rows take. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

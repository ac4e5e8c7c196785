"""Tables that grow by batches under one path, and tombstones that hide what was written before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOMBSTONES = "tombstones"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def next_batch(spark: SparkSession, root: str) -> int:
    """One more than the last batch of any table under root. One writer at a time."""
    at, fs = _path(spark, f"{root}/*/batch=*")
    return max((int(s.getPath().getName().rpartition("=")[2]) for s in fs.globStatus(at) or ()), default=-1) + 1


def append(rows: DataFrame, root: str, name: str, batch: int, by: str | None = None) -> None:
    """Write rows as a batch of a table; a batch that is written again replaces itself alone."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{root}/{name}/batch={batch}")


def bury(gone: DataFrame, root: str) -> None:
    """Hide, in all tables, the rows of gone (document_id) that are written so far; what is written later is there again. A null id hides every row."""
    append(gone.select(F.col("document_id").cast("string").alias("document_id")).distinct(), root, TOMBSTONES, next_batch(gone.sparkSession, root))


def read(spark: SparkSession, root: str, name: str, key: str = "document_id", schema: str | None = None) -> DataFrame | None:
    """A table without what was buried since it was written; None before anything was."""
    if not exists(spark, f"{root}/{name}"):
        return None
    reader = spark.read.schema(f"{schema}, batch int") if schema else spark.read
    found = reader.parquet(f"{root}/{name}")
    if exists(spark, f"{root}/{TOMBSTONES}"):
        last = spark.read.schema("document_id string, batch int").parquet(f"{root}/{TOMBSTONES}").groupBy("document_id").agg(F.max("batch").alias("_gone"))
        floor = last.where("document_id is null").collect()
        found = found.join(last.where("document_id is not null").withColumnRenamed("document_id", key), key, "left").where("_gone is null or _gone < batch").drop("_gone")
        if floor:
            found = found.where(F.col("batch") > floor[0]["_gone"])
    return found.drop("batch")

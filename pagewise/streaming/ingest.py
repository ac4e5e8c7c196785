"""A folder of files as a stream: every micro-batch runs the same staged pipeline as a batch does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.render import render_documents
from ..plans.engines import Engine
from ..plans.router import process
from ..schemas import FILES
from ..sources.batches import exists
from ..sources.store import from_files


def ingest_batch(files: DataFrame, batch_id: int, out: str, engines: list[Engine], **settings) -> None:
    """Process the files of one batch that out lacks. A batch that runs again overwrites its own folder alone, so nothing is doubled."""
    spark = files.sparkSession
    sources = from_files(files).drop("modified_at")
    if exists(spark, f"{out}/documents"):
        done = spark.read.option("mergeSchema", "false").parquet(f"{out}/documents").where(F.col("batch") != batch_id)
        sources = sources.join(done.select("document_id"), "document_id", "left_anti")
    result = process(sources, engines, **settings)
    for name, table in (("documents", result.documents), ("pages", result.pages), ("failures", result.failures), ("views", render_documents(result.documents, result.pages))):
        table.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")


def ingest_stream(spark: SparkSession, landing: str, out: str, engines: list[Engine], checkpoint: str, files_per_batch: int = 1000, available_now: bool = True, pattern: str = "*", **settings) -> StreamingQuery:
    """Start reading landing. Admission is by files_per_batch; a file whose bytes are known already does no work."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).load(landing)
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: ingest_batch(df, k, out, engines, **settings))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def job_counts(jobs: DataFrame, every: str = "1 hour", late: str = "10 minutes", state: str = "state", at: str = "created_at") -> DataFrame:
    """Jobs by window and state; an extension beyond batch parity. Works on streams and tables alike."""
    marked = jobs.withWatermark(at, late) if jobs.isStreaming else jobs
    return marked.groupBy(F.window(at, every).alias("w"), state).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), state, "n")

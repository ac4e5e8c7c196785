"""Jobs: a log of what was asked for and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

TERMINAL = ("done", "failed")


def submit(sources: DataFrame, depth: int | None = None) -> DataFrame:
    """A queued job for each source; those beyond a queue's depth fail at once with queue_full. Ids follow from what was sent, so a second run makes the same."""
    seed = F.sha2(F.concat_ws("|", "document_id", "filename"), 256)
    jobs = sources.select(
        F.concat(F.lit("job_"), F.substring(seed, 1, 24)).alias("id"), F.concat(F.lit("trace_"), F.substring(seed, 25, 24)).alias("trace_id"), "document_id", "filename", "media_type", "sha256", "size_bytes"
    )
    if depth is None:
        return jobs.withColumns({"state": F.lit("queued"), "error_kind": F.lit(None).cast("string")})
    # The first `depth` by id get in: a bounded top-k, then a join on it.
    admitted = jobs.select("id").orderBy("id").limit(depth).withColumn("_in", F.lit(True))
    joined = jobs.join(admitted, "id", "left")
    return joined.withColumns({"state": F.when(F.col("_in"), "queued").otherwise("failed"), "error_kind": F.when(F.col("_in").isNull(), "queue_full")}).drop("_in")


def newest_first(jobs: DataFrame) -> DataFrame:
    """jobs with place, from 1; the newest first, then by id."""
    ordered = jobs.orderBy(F.desc("created_at"), "id")
    # Places come from sizes of sorted partitions, not from one task that ranks all rows. They are written
    # first, as two plans of the same sort need not cut it at the same rows.
    parts = materialise(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = {r["_p"]: r["count"] for r in parts.groupBy("_p").count().collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    if not starts:
        return jobs.withColumn("place", F.lit(0).cast("long"))
    base = F.create_map(*(F.lit(x) for p, s in starts.items() for x in (p, s)))
    return parts.withColumn("place", (base[F.col("_p")] + F.col("_m").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_p", "_m")


def latest(jobs: DataFrame) -> DataFrame:
    """The last job of each document."""
    w = Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def is_terminal(state: Column) -> Column:
    return state.isin(*TERMINAL)


def by_state(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("n"))


def get(jobs: DataFrame, job_id: str) -> DataFrame:
    """The last state of one job; a row with error_kind not_found if there is none."""
    own = latest_state(jobs.where(F.col("id") == job_id))
    asked = jobs.sparkSession.createDataFrame([(job_id,)], "id string")
    return asked.join(own.withColumn("_there", F.lit(True)), "id", "left").withColumn("error_kind", F.when(F.col("_there").isNull(), "not_found").otherwise(F.col("error_kind"))).drop("_there")


def latest_state(jobs: DataFrame) -> DataFrame:
    """Of a log with a row for each change, the last row of each job: terminal states stand behind others of the same time."""
    w = Window.partitionBy("id").orderBy(F.desc("created_at"), F.desc(is_terminal(F.col("state")).cast("int")))
    return jobs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

"""Routing: which page goes to which engine, and what becomes of the answers. All of it is relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import INCOMPLETE_REASONS, PIPELINE_VERSION, SCHEMA_VERSION

#: Types of pages that go to OCR without a native try.
OCR_TYPES = ("scanned", "image_based")


def choose_engine(candidates: DataFrame) -> DataFrame:
    """The candidate (document_id, reg_order, support, error_kind) of most support for each document.

    Ties go to the first registered; support 0 never wins. Where none wins, the first error other
    than `unsupported` stands, else `unsupported`, in a row with a null engine.
    """
    best = F.when((F.col("support") > 0) & F.col("error_kind").isNull(), F.struct(F.col("support"), (-F.col("reg_order")).alias("first")))
    wrong = F.when(F.col("error_kind").isNotNull() & (F.col("error_kind") != "unsupported"), F.col("reg_order"))
    picked = candidates.groupBy("document_id").agg(F.max_by(F.struct(*[c for c in candidates.columns if c not in ("document_id", "error_kind")]), best).alias("w"), F.max(best).isNotNull().alias("won"), F.min_by("error_kind", wrong).alias("e"))
    row = F.when(F.col("won"), F.col("w"))
    kept = [c for c in candidates.columns if c not in ("document_id", "error_kind")]
    return picked.select("document_id", *(row[c].alias(c) for c in kept), F.when(~F.col("won"), F.coalesce("e", F.lit("unsupported"))).alias("error_kind"))


def to_ocr(page_type: Column) -> Column:
    """Whether a page is read by OCR at once. Mixed pages are tried natively first."""
    return page_type.isin(*OCR_TYPES)


def partition_pages(pages: DataFrame) -> DataFrame:
    """pages with tier: ocr or native."""
    return pages.withColumn("tier", F.when(to_ocr(F.col("type")), "ocr").otherwise("native"))


def page_types(pages: DataFrame) -> DataFrame:
    """document_id and a map of page counts by type."""
    counts = pages.groupBy("document_id", "type").agg(F.count("*").alias("n"))
    return counts.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("page_types"))


def ocr_worklist(classified: DataFrame, escalated: DataFrame) -> DataFrame:
    """Each page (document_id, number) that OCR has to read, once."""
    return classified.select("document_id", "number").union(escalated.select("document_id", "number")).distinct()


def rank_pages(pages: DataFrame, score: Column) -> DataFrame:
    """pages with rank: the worst score of a document first, then by number."""
    return pages.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(score, "number")))


def cap_worst_first(ranked: DataFrame, most: int) -> DataFrame:
    """ranked pages that a cap keeps. The rank filter is on the row number, so tasks keep the best rows only before any exchange."""
    return ranked.where(F.col("rank") <= most)


def dropped_by_cap(pages: DataFrame, most: int) -> DataFrame:
    """document_id, kept and dropped: what a cap leaves; dropped pages are never silent."""
    n = F.count("*")
    return pages.groupBy("document_id").agg(F.least(n, F.lit(most)).cast("long").alias("kept"), F.greatest(n - most, F.lit(0)).cast("long").alias("dropped"))


def without(pages: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """pages that others lack: cache misses, pages not probed yet, documents not stored."""
    return pages.join(others.select(*on).distinct(), on, "left_anti")


def merge_pages(base: DataFrame, better: DataFrame, values: list[str]) -> DataFrame:
    """Pages of either side; where both have one, better's row as a whole, even an empty one."""
    on = ["document_id", "number"]
    there = better.withColumn("_there", F.lit(True))
    both = base.alias("b").join(there.alias("w"), on, "full")
    return both.select(*on, *(F.when(F.col("w._there"), F.col(f"w.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in values))


def fill_gaps(pages: DataFrame, documents: DataFrame, values: list[str], reason: str = "not_extracted") -> DataFrame:
    """A row for each number from 1 to a document's page_count; a page that nothing produced is a scanned placeholder with the reason."""
    on = ["document_id", "number"]
    wanted = documents.where("page_count > 0").select("document_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("number"))
    blank = {"type": F.lit("scanned"), "confidence": F.lit(0.0), "reasons": F.array(F.lit(reason))}
    joined = wanted.join(pages.withColumn("_there", F.lit(True)), on, "left")
    missing = F.col("_there").isNull()
    return joined.select(*on, *((F.when(missing, blank[c]).otherwise(F.col(c)) if c in blank else F.col(c)).alias(c) for c in values))


def add_reason(reasons: Column, reason: str) -> Column:
    """A set in order: a reason that is there already is not added twice."""
    return F.array_distinct(F.concat(F.coalesce(reasons, F.array().cast("array<string>")), F.array(F.lit(reason))))


def incomplete_documents(pages: DataFrame) -> DataFrame:
    """document_id, number and reason of the first page that some engine still owes. Vision failures don't count."""
    owed = F.get(F.filter("reasons", lambda r: r.isin(*INCOMPLETE_REASONS)), F.lit(0))
    return pages.withColumn("owed", owed).where("owed is not null").groupBy("document_id").agg(F.min("number").alias("number"), F.min_by("owed", "number").alias("reason"))


def reusable_documents(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id of stored documents that need no work: same versions, both views there, no page owed."""
    current = (F.col("schema_version") == SCHEMA_VERSION) & (F.col("pipeline_version") == PIPELINE_VERSION) & F.col("has_json") & F.col("has_markdown")
    return without(documents.where(current).select("document_id"), incomplete_documents(pages), ["document_id"])


def merge_metadata(first: Column, second: Column) -> Column:
    """first's fields, second's where first's are blank; settings of either, first's where both have one."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(first["custom"], empty), F.coalesce(second["custom"], empty)
    custom = F.map_concat(a, F.map_filter(b, lambda k, _: ~F.map_contains_key(a, k)))
    text = [F.coalesce(blank(first[c]), blank(second[c])).alias(c) for c in ("title", "author", "language")]
    return F.struct(*text, F.coalesce(first["page_count"], second["page_count"]).alias("page_count"), custom.alias("custom"))


def shard_pages(pages: DataFrame, shards: int) -> DataFrame:
    """pages with shard, from 1: runs of near-equal length for each document, longer ones first."""
    return pages.withColumn("shard", F.ntile(shards).over(Window.partitionBy("document_id").orderBy("number")))


def shard_outcome(runs: DataFrame) -> DataFrame:
    """For each document: failed only if every shard failed; the duration is the longest shard's."""
    return runs.groupBy("document_id").agg(F.min(F.col("error").isNotNull()).alias("failed"), F.max("duration_ms").alias("duration_ms"), F.count_if(F.col("error").isNotNull()).alias("failed_shards"))

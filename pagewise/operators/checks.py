"""Invariants of documents: each violation is a row, and none is what is wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BLOCK_TYPES, PAGE_KINDS, PAGE_TYPES, PIPELINE_VERSION, SCHEMA_VERSION


def _told(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks; a rule that is null counts as kept."""
    return F.filter(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items())), lambda x: x.isNotNull())


def page_violations(pages: DataFrame) -> DataFrame:
    """document_id, number, block_id, violation for pages and their blocks; nothing leaves its page."""
    c = F.col
    rules = {
        "kind": c("kind").isNull() | ~c("kind").isin(*PAGE_KINDS),
        "type": c("type").isNull() | ~c("type").isin(*PAGE_TYPES),
        "confidence": c("confidence").isNull() | ~c("confidence").between(0, 1),
        "quality": c("quality.score").isNull() | ~c("quality.score").between(0, 1),
        "geometry": (c("kind") != "paginated") & (c("width").isNotNull() | c("height").isNotNull()),
        "duplicate_block": F.size(F.array_distinct(F.transform("blocks", lambda b: b["block_id"]))) < F.size("blocks"),
        "covered_content": F.exists("cells", lambda x: x["covered_row"].isNotNull() & F.exists("blocks", lambda b: (b["parent_id"] == x["table_id"]) & (b["row"] == x["row"]) & (b["col"] == x["col"]))),
    }
    whole = pages.select("document_id", "number", F.lit(None).cast("string").alias("block_id"), F.explode(_told(rules)).alias("violation"))
    b = pages.select("document_id", "number", "kind", F.explode("blocks").alias("b"))
    block_rules = {
        "block_id": c("b.block_id").isNull(),
        "block_type": c("b.type").isNull() | ~c("b.type").isin(*BLOCK_TYPES),
        "provenance": c("b.provenance.engine").isNull() | c("b.provenance.method").isNull(),
        "block_confidence": c("b.confidence").isNotNull() & ~c("b.confidence").between(0, 1),
        "degenerate_box": c("b.bbox").isNotNull() & ((c("b.bbox.width") <= 0) | (c("b.bbox.height") <= 0)),
        "box_off_page": c("b.bbox").isNotNull() & (c("kind") != "paginated"),
        "heading_level": (c("b.type") == "heading") & (c("b.level").isNull() | (c("b.level") < 1)),
    }
    return whole.union(b.select("document_id", "number", "b.block_id", F.explode(_told(block_rules)).alias("violation")))


def document_violations(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id and violation: versions, hashes, page counts, and numbers that run from 1 without a gap."""
    counted = pages.groupBy("document_id").agg(F.count("*").alias("n"), F.min("number").alias("first"), F.max("number").alias("last"), F.count_distinct("number").alias("different"))
    both = documents.join(counted, "document_id", "left")
    n = F.coalesce("n", F.lit(0))
    rules = {
        "schema_version": F.col("schema_version") != SCHEMA_VERSION,
        "pipeline_version": F.col("pipeline_version") != PIPELINE_VERSION,
        "sha256": F.col("source.sha256").isNull() | ~F.col("source.sha256").rlike(r"\A[0-9a-f]{64}\z"),
        "page_count": F.col("metadata.page_count") != n,
        "page_numbers": (n > 0) & ((F.col("first") != 1) | (F.col("last") != n) | (F.col("different") != n)),
    }
    return both.select("document_id", F.explode(_told(rules)).alias("violation"))


def engines_used(pages: DataFrame) -> DataFrame:
    """document_id and the engines that any of its blocks came from, in order."""
    own = pages.select("document_id", F.explode(F.array_distinct(F.transform("blocks", lambda b: b["provenance"]["engine"]))).alias("engine")).distinct()
    return own.groupBy("document_id").agg(F.array_sort(F.collect_list("engine")).alias("engines"))


def page_text(pages: DataFrame) -> DataFrame:
    """document_id, number and text: block texts in order, joined by one space, tables included."""
    told = F.filter(F.transform("blocks", lambda b: b["text"]), lambda t: F.length(t) > 0)
    return pages.select("document_id", "number", F.array_join(told, " ").alias("text"))


def expectation_failures(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """document_id and failure for expected (document_id, min_blocks, allowed array, denied array): too few blocks, or engines that should or should not be there."""
    n = pages.groupBy("document_id").agg(F.sum(F.size("blocks")).alias("n"))
    both = expected.join(n, "document_id", "left").join(engines_used(pages), "document_id", "left")
    used = F.coalesce("engines", F.array().cast("array<string>"))
    rules = {
        "missing": F.col("n").isNull(),
        "few_blocks": F.col("n") < F.col("min_blocks"),
        "engine_not_allowed": F.col("allowed").isNotNull() & (F.size(F.array_except(used, "allowed")) > 0),
        "engine_denied": F.col("denied").isNotNull() & F.arrays_overlap(used, "denied"),
    }
    return both.select("document_id", F.explode(_told(rules)).alias("failure"))

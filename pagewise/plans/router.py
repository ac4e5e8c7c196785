"""The staged pipeline: inspect, route each page, read it with the cheapest engine, score, escalate, assemble."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.metrics import disagreement
from ..functions.quality import Weights, plain_text, score_pages
from ..operators import routing as R
from ..operators.cache import PageCache
from ..schemas import DROPPED, EXTRACTED, INSPECTED, PAGE_COLUMNS, PIPELINE_VERSION, QUALITY, RUNS, SCHEMA_VERSION
from ..session import materialise
from .engines import Engine

ON = ["document_id", "number"]


@dataclass
class Result:
    """documents and pages of what could be read, runs of engines, and failures: documents that no engine could open."""

    documents: DataFrame
    pages: DataFrame
    runs: DataFrame
    failures: DataFrame
    vision_dropped: DataFrame


def _empty(like: DataFrame, schema) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)


def inspect(sources: DataFrame, engines: list[Engine]) -> DataFrame:
    """One row of INSPECTED for each source: the best engine's, or the error that stands."""
    looks = [(k, e.inspect(sources)) for k, e in enumerate(engines)]
    found = [df.withColumn("reg_order", F.lit(k)) for k, df in looks if df is not None]
    out = found[0] if found else _empty(sources, INSPECTED).withColumn("reg_order", F.lit(0))
    for df in found[1:]:
        out = out.unionByName(df)
    chosen = R.choose_engine(out.drop("error")).drop("reg_order")
    picked = sources.select("document_id").distinct().join(chosen, "document_id", "left")
    return picked.withColumn("error_kind", F.when(F.col("engine").isNull(), F.coalesce("error_kind", F.lit("unsupported"))))


def _extract(sources: DataFrame, wanted: DataFrame, engine: Engine, cache: PageCache | None, shards: int = 1, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages with an error row for what failed, runs). wanted: document_id, number; whole: documents to be read without a page list.

    What the cache has is not asked for. Pages of a document go to the engine in runs of near-equal
    length where there are several shards; the content joins by id, late.
    """
    hits = None
    if cache is not None and cache.path is not None:
        hits = materialise(cache.hits(wanted, engine.name, engine.version))
        cache.count(wanted, hits)
        missing = R.without(wanted, hits, ON)
    else:
        missing = wanted.select(*ON)
    lists = R.shard_pages(missing, shards).groupBy("document_id", "shard").agg(F.array_sort(F.collect_list("number")).alias("numbers")).drop("shard")
    if whole is not None:
        lists = lists.union(whole.select("document_id", F.lit(None).cast("array<int>")))
    got = materialise(engine.extract(sources.join(lists, "document_id")))
    if cache is not None:
        cache.put(got)
    name = [F.lit(engine.name).alias("engine"), F.lit(engine.version).alias("version")]
    asked = lists.groupBy("document_id").agg(F.array_sort(F.flatten(F.collect_list(F.coalesce("numbers", F.array().cast("array<int>"))))).alias("pages"))
    errors = got.where("error_kind is not null").groupBy("document_id").agg(F.min("error").alias("error"))
    runs = asked.join(errors, "document_id", "left").select("document_id", *name, "pages", F.lit(False).alias("cache_hit"), "error")
    pages = got
    if hits is not None:
        full = R.without(hits.select("document_id").distinct(), lists, ["document_id"])
        runs = runs.union(full.select("document_id", *name, F.lit(None).cast("array<int>"), F.lit(True), F.lit(None).cast("string")))
        pages = got.unionByName(hits.withColumns({"engine": F.lit(engine.name), "engine_version": F.lit(engine.version)}), allowMissingColumns=True)
    return pages, runs


def _read(pages: DataFrame) -> DataFrame:
    """The pages of an extraction, without its errors; a number that comes twice counts once."""
    return pages.where("error_kind is null and number is not null").select(*ON, *PAGE_COLUMNS).dropDuplicates(ON)


def _text(column: str):
    return plain_text(F.transform(F.col(column), lambda b: F.coalesce(b["text"], F.lit(""))))


def process(sources: DataFrame, engines: list[Engine], ocr: Engine | None = None, vision: Engine | None = None, config: Config = Config(), weights: Weights = Weights(), cache: PageCache | None = None) -> Result:
    """Read sources (SOURCES). Every engine call is written once before its rows are used, so no page is read twice for two branches.

    A page that inspection calls scanned or image_based goes to OCR, others to the engine that won the
    inspection; native pages below the OCR threshold follow. OCR's answer replaces a native page even
    where it is empty. Where OCR fails or there is none, pages that nothing has read become placeholders.
    With a vision engine, OCR pages below its threshold are read again, worst first and no more than the
    cap; a probe of the worst page widens that to all OCR pages of its document where the two readings
    disagree. Vision never makes a page worse: empty and failed answers leave the page, with a reason.
    """
    spark = sources.sparkSession
    seen = materialise(inspect(sources, engines))
    failures = seen.where("engine is null").select("document_id", "error_kind")
    good = seen.where("engine is not null")
    runs = good.select("document_id", F.concat("engine", F.lit(":inspect")).alias("engine"), F.col("engine_version").alias("version"), F.lit(None).cast("array<int>").alias("pages"), F.lit(False).alias("cache_hit"), F.lit(None).cast("string").alias("error"))

    classified = R.partition_pages(good.select("document_id", F.explode("pages").alias("p")).select("document_id", "p.*"))
    native_pages, ocr_pages = (classified.where(F.col("tier") == t).select(*ON) for t in ("native", "ocr"))

    # Native extraction, each document by its own engine.
    native = _empty(sources, EXTRACTED)
    for engine in engines:
        own = good.where(F.col("engine") == engine.name)
        ids = own.select("document_id")
        whole = own.where(F.coalesce(F.size("pages"), F.lit(0)) <= 0).select("document_id")
        if ids.join(native_pages, "document_id", "left_semi").union(whole).take(1):
            got, ran = _extract(sources, native_pages.join(ids, "document_id", "left_semi"), engine, cache, whole=whole)
            native, runs = native.unionByName(got, allowMissingColumns=True), runs.union(ran)
    broken = native.where("error_kind is not null").select("document_id", "error_kind").distinct()
    failures = failures.union(broken)
    alive = R.without(good, broken, ["document_id"])
    scored = materialise(score_pages(_read(R.without(native, broken, ["document_id"])), weights))

    low = scored.join(native_pages, ON, "left_semi").where(F.col("quality.score") < config.ocr_threshold).select(*ON)
    todo = materialise(R.ocr_worklist(R.without(ocr_pages, broken, ["document_id"]), low))
    current = scored
    values = [*PAGE_COLUMNS, "quality"]
    if todo.take(1):
        if ocr is not None:
            got, ran = _extract(sources, todo, ocr, cache, config.ocr_shards)
            runs = runs.union(ran)
            read = _read(got)
            again = score_pages(read.join(low.withColumn("_low", F.lit(True)), ON, "left"), weights, F.col("_low").isNotNull()).drop("_low")
            current = R.merge_pages(scored, again.select(*ON, *values), values)
            # A document fails in OCR only where every shard did; a page that a partial answer lacks is a gap.
            failed = R.without(got.where("error_kind is not null").select("document_id").distinct(), read, ["document_id"])
            owed, reason = todo.join(failed, "document_id", "left_semi"), "ocr_failed"
        else:
            owed, reason = todo, "no_ocr_engine"
        current = materialise(current.unionByName(_placeholders(R.without(owed, current, ON), classified, reason), allowMissingColumns=True))

    dropped = _empty(sources, DROPPED)
    if vision is not None and (config.vision_threshold > 0 or config.vision_probe) and todo.take(1):
        current, dropped, ran = _escalate(sources, current, todo, vision, config, weights, cache, values)
        runs = runs.union(ran)

    counted = alive.select("document_id", "page_count")
    filled = R.fill_gaps(current.join(counted.where("page_count > 0"), "document_id", "left_semi").select(*ON, *values), counted, values)
    others = current.join(counted.where("page_count > 0"), "document_id", "left_anti").select(*ON, *values)
    whole_pages = filled.union(others)
    blank = F.array().cast(EXTRACTED["blocks"].dataType)
    whole_pages = whole_pages.withColumns({"blocks": F.coalesce("blocks", blank), "kind": F.coalesce("kind", F.lit("paginated"))})
    rescored = score_pages(whole_pages.withColumn("_was", F.col("quality")), weights)
    pages = materialise(rescored.withColumn("quality", F.coalesce("_was", "quality").cast(QUALITY)).drop("_was"))

    said = native.where("metadata is not null").groupBy("document_id").agg(F.min_by("metadata", F.coalesce("number", F.lit(1))).alias("said"))
    n = pages.groupBy("document_id").agg(F.count("*").cast("int").alias("n"))
    documents = alive.select("document_id", F.col("metadata").alias("first")).join(said, "document_id", "left").join(n, "document_id", "left")
    merged = R.merge_metadata(F.col("first"), F.col("said"))
    documents = documents.select("document_id", F.struct("document_id", merged.alias("m"), F.coalesce("n", F.lit(0)).alias("n")).alias("x")).join(sources.select("document_id", F.struct("filename", "media_type", "sha256", "size_bytes").alias("source")), "document_id")
    documents = documents.select(
        "document_id", "source", F.col("x.m").withField("page_count", F.col("x.n")).alias("metadata"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(PIPELINE_VERSION).alias("pipeline_version")
    )
    return Result(documents, pages, runs.select(*RUNS.names), failures.distinct(), dropped)


def _placeholders(wanted: DataFrame, classified: DataFrame, reason: str) -> DataFrame:
    """Empty pages as inspection saw them, with one more reason."""
    known = wanted.join(classified.select(*ON, "type", "confidence", "reasons"), ON, "left")
    empty = lambda c: F.array().cast(EXTRACTED[c].dataType).alias(c)
    page = known.select(*ON, F.lit("paginated").alias("kind"), F.coalesce("type", F.lit("scanned")).alias("type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), R.add_reason(F.col("reasons"), reason).alias("reasons"), empty("blocks"), empty("items"), empty("cells"))
    # It scores 0, as it has no text, and so is the first that vision looks at.
    return score_pages(page)


def _escalate(sources, current, todo, vision, config, weights, cache, values):
    """Pages after the vision tier, what the cap left out, and the runs."""
    ocr_read = current.join(todo, ON, "left_semi")
    ranked = materialise(R.rank_pages(ocr_read.select(*ON, F.col("quality.score").alias("score"), _text("blocks").alias("text")), F.col("score")))
    below = ranked.where(F.col("score") < config.vision_threshold)
    answers, runs, probes, targets = [], _empty(sources, RUNS), None, below
    if config.vision_probe:
        worst = ranked.where("rank = 1")
        got, ran = _extract(sources, worst.select(*ON), vision, cache)
        runs = runs.union(ran)
        said = _read(got).where(F.size("blocks") > 0)
        compared = said.join(worst.select(*ON, "text"), ON).withColumn("d", disagreement(F.col("text"), _text("blocks")))
        probes = materialise(compared.where(F.col("d") >= config.vision_disagreement).drop("d", "text"))
        targets = below.unionByName(ranked.join(probes.select("document_id").distinct(), "document_id", "left_semi")).dropDuplicates(ON)
        answers.append(probes)
    again = R.rank_pages(targets.drop("rank"), F.col("score"))
    kept = materialise(R.cap_worst_first(again, config.vision_max_pages).select(*ON))
    dropped = R.dropped_by_cap(targets, config.vision_max_pages)
    remaining = R.without(kept, probes, ON) if probes is not None else kept
    if remaining.take(1):
        got, ran = _extract(sources, remaining, vision, cache)
        runs = runs.union(ran)
        answers.append(_read(got))
    if not kept.take(1):
        return current, dropped, runs
    said = answers[0]
    for more in answers[1:]:
        said = said.unionByName(more)
    said = said.join(kept, ON, "left_semi").dropDuplicates(ON)
    probed = (probes.select(*ON) if probes is not None else kept.limit(0)).withColumn("_probed", F.lit(True))
    better = score_pages(said.where(F.size("blocks") > 0).join(probed, ON, "left"), weights, F.lit(True))
    reasons = R.add_reason(F.col("reasons"), "vision_escalated")
    better = better.withColumn("reasons", F.when(F.col("_probed"), R.add_reason(reasons, "vision_probe")).otherwise(reasons)).select(*ON, *values)
    # Pages of the cap that vision left: empty ones are marked as both, in this order.
    empty = said.where(F.size("blocks") == 0).select(*ON).withColumn("_empty", F.lit(True))
    left = R.without(kept, better, ON).join(empty, ON, "left").withColumn("_left", F.lit(True))
    marked = current.join(left, ON, "left")
    with_empty = F.when(F.col("_empty"), R.add_reason(F.col("reasons"), "vision_empty")).otherwise(F.col("reasons"))
    marked = marked.withColumn("reasons", F.when(F.col("_left"), R.add_reason(with_empty, "vision_failed")).otherwise(F.col("reasons"))).drop("_empty", "_left")
    return materialise(R.merge_pages(marked.select(*ON, *values), better, values)), dropped, runs

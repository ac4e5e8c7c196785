"""A library of documents over tables: submit, look, read, delete and sweep, with the answers that a service would give."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.text import http_status
from .operators import jobs, routing
from .operators.cache import PageCache
from .operators.render import render_documents
from .plans.engines import Engine
from .plans.router import inspect, process
from .schemas import PIPELINE_VERSION, SCHEMA_VERSION
from .session import materialise
from .sources import batches, store


@dataclass
class Library:
    """Tables under one path: documents, pages, views, failures, runs, assets, blobs and jobs, each appended by batch.

    A tombstone hides what was written before it, so a document that is sent again after its deletion is
    there again. One writer at a time.
    """

    spark: SparkSession
    path: str
    engines: list[Engine]
    ocr: Engine | None = None
    vision: Engine | None = None
    config: Config = field(default_factory=Config)
    cache: PageCache | None = None

    def table(self, name: str, key: str = "document_id") -> DataFrame | None:
        """A table without what was deleted; None before anything was written."""
        return batches.read(self.spark, self.path, name, key)

    def submit(self, sources: DataFrame) -> DataFrame:
        """Read what the library lacks; jobs with their outcome for all sources. Bytes that are known are done at once."""
        jobs_ = jobs.submit(sources)
        known = self.table("documents")
        new = sources if known is None else routing.without(sources, known.select("document_id"), ["document_id"])
        batch = batches.next_batch(self.spark, self.path)
        if new.take(1):
            new = materialise(new)
            blobs, stored = new.dropDuplicates(["sha256"]), self.table("blobs", "sha256")
            blobs = blobs if "modified_at" in blobs.columns else blobs.withColumn("modified_at", F.current_timestamp())
            blobs = blobs if stored is None else routing.without(blobs, stored.select("sha256").distinct(), ["sha256"])
            batches.append(blobs.withColumn("prefix", F.substring("sha256", 1, 2)), self.path, "blobs", batch, "prefix")
            result = process(new.drop("modified_at"), self.engines, self.ocr, self.vision, self.config, cache=self.cache)
            for name, rows in (("documents", result.documents), ("pages", result.pages), ("failures", result.failures), ("runs", result.runs), ("views", render_documents(result.documents, result.pages))):
                batches.append(rows, self.path, name, batch)
            found = [self._assets(e, new) for e in self.engines if hasattr(e, "assets")]
            if found:
                batches.append(reduce(DataFrame.unionByName, (store.commit_assets(x.withColumn("blob_ref", F.lit(None).cast("string"))) for x in found)), self.path, "assets", batch)
        done, failed = self.table("documents").select("document_id", F.col("metadata.page_count").alias("pages")), self.table("failures").dropDuplicates(["document_id"])
        out = jobs_.drop("state", "error_kind").join(done, "document_id", "left").join(failed, "document_id", "left")
        out = materialise(out.withColumns({"state": F.when(F.col("pages").isNotNull(), "done").otherwise("failed"), "created_at": F.current_timestamp()}))
        batches.append(out, self.path, "jobs", batch)
        return out.drop("created_at")

    def _assets(self, engine: Engine, new: DataFrame) -> DataFrame:
        """What an engine finds in new documents; what the cache has, even that there is nothing, is not looked for again."""
        if self.cache is None or self.cache.path is None:
            return engine.assets(new)
        kept = materialise(self.cache.assets(new, engine.name, engine.version))
        rest = routing.without(new, kept.select("document_id").distinct(), ["document_id"])
        fresh = materialise(engine.assets(rest))
        self.cache.put_assets(rest, engine.name, engine.version, fresh)
        return fresh.unionByName(kept.where("asset_id is not null"))

    def jobs(self) -> DataFrame | None:
        """The log of jobs, the newest first, with place."""
        log = self.table("jobs")
        return None if log is None else jobs.newest_first(jobs.latest_state(log))

    def job(self, job_id: str, wait_seconds: float = 0, every: float = 0.5) -> Row | None:
        """The last state of a job; None if there is none. With wait_seconds, asked again until it has ended or they are over: another writer may be at it."""
        until = time.monotonic() + wait_seconds
        while True:
            log = self.table("jobs")
            row = next((r for r in jobs.get(log, job_id).collect() if r.error_kind != "not_found"), None) if log is not None else None
            if row is not None and row.state in jobs.TERMINAL or time.monotonic() >= until:
                return row
            time.sleep(every)

    def inspect(self, sources: DataFrame) -> DataFrame:
        """What a look without extraction tells: engine, page count and page types, or the error and its status."""
        seen = inspect(sources, self.engines)
        types = routing.page_types(seen.where("engine is not null").select("document_id", F.explode("pages").alias("p")).select("document_id", "p.type"))
        return seen.select("document_id", "engine", "page_count", "page_kind", "error_kind", F.when(F.col("error_kind").isNotNull(), http_status(F.col("error_kind"))).otherwise(200).alias("status")).join(types, "document_id", "left")

    def view(self, document_id: str, kind: str = "markdown") -> str | None:
        """One document as markdown or json; None if it is not there."""
        found = self.table("views")
        row = found.where(F.col("document_id") == document_id).select(kind).take(1) if found is not None else []
        return row[0][0] if row else None

    def asset(self, document_id: str, asset_id: str) -> tuple[str, bytes] | None:
        """Media type and bytes of one asset; None if it is not there."""
        found = self.table("assets")
        row = store.asset(found, document_id, asset_id).select("media_type", "content").take(1) if found is not None else []
        return (row[0].media_type, bytes(row[0].content)) if row else None

    def delete(self, gone: DataFrame) -> None:
        """Documents of gone (document_id) are no longer there, nor what the cache keeps of them; deleting what is not there changes nothing. compact() frees their bytes."""
        gone = materialise(gone.select("document_id").distinct())
        batches.bury(gone, self.path)
        if self.cache is not None:
            self.cache.drop(gone)

    def sweep(self, now: Column | None = None) -> DataFrame:
        """Delete documents older than the configured age; their ids in order. Ids go from table to table, not through the driver."""
        blobs = self.table("blobs", "sha256")
        if blobs is None or not self.config.ttl_seconds:
            return self.spark.createDataFrame([], "document_id string")
        when = now if now is not None else F.current_timestamp()
        out = materialise(store.expired(blobs, self.config.ttl_seconds, when).select(F.col("sha256").alias("document_id")))
        if out.take(1):
            self.delete(out)
        return out.orderBy("document_id")

    def compact(self, to: str) -> Library:
        """A library at another path without deleted rows; the old one stays as it is."""
        for name in ("documents", "pages", "views", "failures", "runs", "assets", "blobs", "jobs"):
            rows = self.table(name, "sha256" if name == "blobs" else "document_id")
            if rows is not None:
                batches.append(rows, to, name, 0, "prefix" if name == "blobs" else None)
        return Library(self.spark, to, self.engines, self.ocr, self.vision, self.config, self.cache)

    def engine_table(self) -> DataFrame:
        """name, version and tier of every engine, by name."""
        rows = [(e.name, e.version, "registered") for e in self.engines] + [(e.name, e.version, tier) for e, tier in ((self.ocr, "ocr"), (self.vision, "vision")) if e is not None]
        return self.spark.createDataFrame(sorted(rows), "name string, version string, tier string")

    def listing(self) -> dict:
        """What a listing of engines tells: the engines, the versions of schema and pipeline, and the cache's hits, misses and pages."""
        found = [{"name": r.name, "version": r.version} for r in self.engine_table().collect()]
        c = self.cache
        counts = {"hits": c.hit_count, "misses": c.miss_count, "pages": c.rows().count()} if c is not None else {"hits": 0, "misses": 0, "pages": 0}
        return {"engines": found, "schema_version": SCHEMA_VERSION, "pipeline_version": PIPELINE_VERSION, "cache": counts}

"""The page cache: what an engine's version has read of a document's page, and the assets that it found, kept as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EXTRACTED, PAGE_COLUMNS, PIPELINE_VERSION
from ..session import materialise
from ..sources import batches

ASSET = T.StructType([T.StructField(n, k) for n, k in (("asset_id", T.StringType()), ("media_type", T.StringType()), ("content", T.BinaryType()), ("origin", T.StringType()))])


class PageCache:
    """A folder of tables that grow by batches, pages split by the first two digits of the document's hash; None keeps nothing.

    A key is the document, the pipeline's version, the engine and its version, the page and the
    settings: a new version of an engine misses its own pages alone. Assets are kept for a document as a
    whole, and that it has none is kept too. Where `limit` or more pages are kept before a put, the
    cache starts anew. Reads are joins, so what is handed out is a copy. hit_count and miss_count are of
    this object.
    """

    def __init__(self, spark: SparkSession, path: str | None, settings: dict[str, str] | None = None, limit: int | None = None):
        self.spark, self.path, self.limit = spark, path, limit
        self.settings = ",".join(f"{k}={v}" for k, v in sorted((settings or {}).items()))
        self.hit_count = self.miss_count = 0

    def _table(self, name: str, kinds: str) -> DataFrame:
        found = batches.read(self.spark, self.path, name, schema=f"{kinds}, prefix string") if self.path is not None else None
        return found.where(F.col("pipeline") == PIPELINE_VERSION) if found is not None else self.spark.createDataFrame([], kinds)

    def _own(self, rows: DataFrame, engine: str, version: str) -> DataFrame:
        return rows.where((F.col("engine") == engine) & (F.col("engine_version") == version) & (F.col("settings") == self.settings))

    def _kept(self, rows: DataFrame, name: str) -> None:
        marked = rows.withColumns({"settings": F.lit(self.settings), "pipeline": F.lit(PIPELINE_VERSION), "prefix": F.substring("document_id", 1, 2)})
        batches.append(marked, self.path, name, batches.next_batch(self.spark, self.path), "prefix")

    def rows(self) -> DataFrame:
        fields = [f for f in EXTRACTED.fields if f.name in PAGE_COLUMNS]
        return self._table("pages", ", ".join(["document_id string", "engine string", "engine_version string", "page int", "settings string", "pipeline string", *(f"{f.name} {f.dataType.simpleString()}" for f in fields)]))

    def asset_rows(self) -> DataFrame:
        return self._table("assets", ", ".join(["document_id string", "engine string", "engine_version string", "settings string", "pipeline string", *(f"{f.name} {f.dataType.simpleString()}" for f in ASSET.fields)]))

    def hits(self, wanted: DataFrame, engine: str, version: str) -> DataFrame:
        """The pages of wanted (document_id, number) that are kept, as rows with PAGE_COLUMNS."""
        own = self._own(self.rows(), engine, version)
        own = own.select("document_id", F.col("page").alias("number"), *PAGE_COLUMNS).dropDuplicates(["document_id", "number"])
        return wanted.select("document_id", "number").join(own, ["document_id", "number"])

    def count(self, wanted: DataFrame, hits: DataFrame) -> None:
        """Count what was asked for and what was there."""
        got = stats(wanted, hits).collect()[0]
        self.hit_count, self.miss_count = self.hit_count + got.hits, self.miss_count + got.misses

    def put(self, pages: DataFrame) -> None:
        """Keep the pages of an extraction that have no error."""
        if self.path is None:
            return
        if self.limit and self.rows().count() >= self.limit:
            batches.bury(self.spark.createDataFrame([(None,)], "document_id string"), self.path)
        self._kept(pages.where("error_kind is null and number is not null").select("document_id", "engine", "engine_version", F.col("number").alias("page"), *PAGE_COLUMNS), "pages")

    def put_assets(self, read: DataFrame, engine: str, version: str, assets: DataFrame) -> None:
        """Keep the assets (document_id and those of ASSET) of the documents in read; a document without any has a row of nulls."""
        if self.path is not None:
            rows = read.select("document_id").distinct().join(assets.select("document_id", *ASSET.names), "document_id", "left")
            self._kept(rows.withColumns({"engine": F.lit(engine), "engine_version": F.lit(version)}), "assets")

    def assets(self, wanted: DataFrame, engine: str, version: str) -> DataFrame:
        """Asset rows of wanted (document_id) that are kept; one of nulls for a document that is known to have none."""
        return self._own(self.asset_rows(), engine, version).join(wanted.select("document_id").distinct(), "document_id", "left_semi").select("document_id", *ASSET.names).dropDuplicates(["document_id", "asset_id"])

    def drop(self, gone: DataFrame) -> int:
        """Hide all that is kept of the documents of gone; how many rows that were. forget() frees their bytes."""
        if self.path is None:
            return 0
        gone = materialise(gone.select("document_id").distinct())
        n = sum(rows.join(gone, "document_id", "left_semi").count() for rows in (self.rows(), self.asset_rows()))
        if n:
            batches.bury(gone, self.path)
        return n

    def forget(self, gone: DataFrame, to: str) -> PageCache:
        """A cache at another path without the documents of gone: files are never changed in place."""
        out = PageCache(self.spark, to, limit=self.limit)
        out.settings = self.settings
        for k, (name, rows) in enumerate((("pages", self.rows()), ("assets", self.asset_rows()))):
            kept = rows.join(gone.select("document_id").distinct(), "document_id", "left_anti").withColumn("prefix", F.substring("document_id", 1, 2))
            batches.append(kept, to, name, k, "prefix")
        return out


def stats(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: hits and misses."""
    both = wanted.select("document_id", "number").distinct().join(hits.select("document_id", "number").distinct().withColumn("hit", F.lit(1)), ["document_id", "number"], "left")
    return both.agg(F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("misses"))


def key_matches(document_hash: Column, key: Column) -> Column:
    """Whether a written key is of this document."""
    return F.startswith(key, F.concat(document_hash, F.lit("|")))

import datetime as dt

import pytest
from pagewise.config import Config
from pagewise.functions.quality import score_pages
from pagewise.operators import checks, tiers
from pagewise.operators.cache import PageCache
from pagewise.plans.engines import ImageEngine, NativeEngine, StubOcr
from pagewise.plans.router import process
from pagewise.schemas import SOURCES
from pagewise.service import Library
from pyspark.sql import functions as F

TABLE = "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>"


def sizes(spark):
    return spark.createDataFrame([("d", 1, 2.0, 300.0, 400.0), ("d", 2, 2.0, 300.0, 400.0)], "document_id string, page int, scale double, width_pt double, height_pt double")


def test_layout_pages(spark):
    rows = [("d", 1, 1, "table", TABLE, 0.0, 400.0, 100.0, 500.0, 2, 0.9), ("d", 1, 2, "doc_title", " A  title ", 0.0, 0.0, 100.0, 20.0, 1, 0.8), ("d", 1, 3, "seal", "", 5.0, 600.0, 5.0, 700.0, 3, 0.5), ("d", 1, 4, "text", "  ", 0.0, 0.0, 1.0, 1.0, 4, 0.5), ("d", 1, 5, "table", "no table", 0.0, 0.0, 1.0, 1.0, 5, 0.5)]
    regions = spark.createDataFrame(rows, "document_id string, page int, region_id int, label string, content string, x0 double, y0 double, x1 double, y1 double, ord int, det_score double")
    lines = spark.createDataFrame([("d", 1, "A title", 0.7, 0.0, 0.0, 90.0, 18.0)], "document_id string, page int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    got = {r.number: r for r in tiers.layout_pages(regions, lines, sizes(spark), "ocr", "1").collect()}
    assert [(b.block_id, b.type, b.text) for b in got[1].blocks] == [("p1-ly0", "heading", "A title"), ("p1-ly1", "table", None), ("p1-ly1-r0c0", "paragraph", "a"), ("p1-ly1-r0c1", "paragraph", "b"), ("p1-ly1-r1c1", "paragraph", "c"), ("p1-ly2", "image", None)]
    head, table, image = got[1].blocks[0], got[1].blocks[1], got[1].blocks[5]
    assert (head.level, head.confidence, head.bbox.asDict()) == (1, 0.7, {"x": 0.0, "y": 390.0, "width": 50.0, "height": 10.0})
    assert table.confidence == 0.9 and table.header_rows == 0 and image.alt == "seal" and image.bbox is None
    assert [(c.row, c.col, c.covered_row, c.row_span) for c in got[1].cells] == [(0, 0, None, 2), (0, 1, None, 1), (1, 0, 0, None), (1, 1, None, 1)]
    assert got[1].confidence == pytest.approx(0.7) and got[1].reasons == ["ocr", "layout_analysis"]
    assert got[2].blocks == [] and got[2].reasons == ["ocr", "no_text_found"] and got[2].confidence == 0
    pages = score_pages(tiers.layout_pages(regions, lines, sizes(spark), "ocr", "1"))
    assert checks.page_violations(pages).count() == 0


def test_vision_pages(spark):
    rows = [("d", 1, 0, "text", "Body  text", None, [0.0, 500.0, 1000.0, 600.0], "x"), ("d", 1, 1, "text", "Head", None, [1000.0, 100.0, 0.0, 0.0], "9"), ("d", 1, 2, "table", None, "<tr><td>one</td></tr><tr><td>two</td></tr>", [0.0, 700.0, 10.0, 800.0], None), ("d", 1, 3, "table", None, TABLE, [0.0, 900.0, 10.0, 950.0], None), ("d", 1, 4, "image", " ", None, [0.0, 0.0, 1.0, 1.0], None), ("d", 1, 5, "", "x", None, [0.0, 0.0, 1.0, 1.0], None), ("d", 1, 6, "text", "x", None, [0.0], None)]
    entries = spark.createDataFrame(rows, "document_id string, page int, position int, label string, text string, table_body string, box array<double>, text_level string")
    got = {r.number: r for r in tiers.vision_pages(tiers.vision_blocks(entries), sizes(spark), "vision", "1", "pipeline").collect()}
    assert [(b.block_id, b.type, b.text, b.level) for b in got[1].blocks][:5] == [("p1-vis0", "heading", "Head", 6), ("p1-vis1", "paragraph", "Body text", None), ("p1-vis2-r0", "paragraph", "one", None), ("p1-vis2-r1", "paragraph", "two", None), ("p1-vis3", "table", None, None)]
    assert got[1].blocks[0].bbox.asDict() == {"x": 0.0, "y": 360.0, "width": 300.0, "height": 40.0} and got[1].blocks[2].bbox is None
    assert (got[1].confidence, got[1].reasons, got[2].confidence, got[2].reasons) == (1.0, ["ocr", "vision"], 0.0, ["ocr", "vision", "no_text_found"])
    assert len(got[1].cells) == 4 and not any(b.confidence for b in got[1].blocks)


def test_backends():
    assert tiers.remote_backend("hybrid-engine") == "hybrid-http-client" and tiers.remote_backend("vlm") == "vlm-http-client"
    with pytest.raises(ValueError):
        tiers.remote_backend("pipeline")


def test_violations_are_found(spark):
    src = spark.createDataFrame([("a" * 64, "a.md", None, "a" * 64, 4, b"# T\n\n| a |\n|---|\n"), ("b" * 64, "b.txt", None, "b" * 64, 4, b"words")], SOURCES)
    result = process(src, [NativeEngine()])
    assert checks.page_violations(result.pages).count() == checks.document_violations(result.documents, result.pages).count() == 0
    bad = result.pages.withColumns({"kind": F.lit("odd"), "confidence": F.lit(2.0), "width": F.lit(1.0), "blocks": F.transform("blocks", lambda b: b.withField("type", F.lit("x")).withField("block_id", F.lit("same")).withField("confidence", F.lit(-1.0)))})
    assert {r.violation for r in checks.page_violations(bad).collect()} == {"kind", "confidence", "geometry", "duplicate_block", "block_type", "block_confidence"}
    lost = checks.document_violations(result.documents.withColumn("schema_version", F.lit("0")), result.pages.where("document_id like 'a%'")).collect()
    assert {(r.document_id[0], r.violation) for r in lost} == {("a", "schema_version"), ("b", "schema_version"), ("b", "page_count")}
    assert {tuple(r) for r in checks.engines_used(result.pages).selectExpr("substr(document_id, 1, 1)", "engines[0]").collect()} == {("a", "native"), ("b", "native")}
    assert {r.text for r in checks.page_text(result.pages).collect()} == {"T a", "words"}
    expected = spark.createDataFrame([("a" * 64, 9, ["native"], None), ("b" * 64, 1, ["pdf"], ["native"]), ("c", 1, None, None)], "document_id string, min_blocks int, allowed array<string>, denied array<string>")
    assert {(r.document_id[0], r.failure) for r in checks.expectation_failures(result.pages, expected).collect()} == {("a", "few_blocks"), ("b", "engine_not_allowed"), ("b", "engine_denied"), ("c", "missing")}


def test_a_library(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"), [NativeEngine(), ImageEngine()], StubOcr(), config=Config(ttl_seconds=60))
    rows = [("a" * 64, "a.md", "text/markdown", "a" * 64, 4, b"# T"), ("b" * 64, "b.bin", None, "b" * 64, 4, b"\0")]
    src = spark.createDataFrame(rows, SOURCES)
    assert {(r.document_id[0], r.state, r.error_kind) for r in lib.submit(src).collect()} == {("a", "done", None), ("b", "failed", "unsupported")}
    assert {r.state for r in lib.submit(src.where("filename = 'a.md'")).collect()} == {"done"} and lib.table("documents").count() == 1
    assert lib.view("a" * 64) == "# T\n" and '"schema_version": "1.0"' in lib.view("a" * 64, "json") and lib.view("c" * 64) is None
    looks = {r.document_id[0]: (r.status, r.page_types) for r in lib.inspect(src).collect()}
    assert looks == {"a": (200, {"native": 1}), "b": (415, None)}
    assert [r.name for r in lib.engine_table().collect()] == ["image", "native", "ocr-stub"]
    assert lib.sweep().count() == 0
    late = F.lit(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(days=1)).cast("timestamp")
    assert sorted(r.document_id[0] for r in lib.sweep(late).collect()) == ["a", "b"]
    assert lib.view("a" * 64) is None and lib.table("blobs", "sha256").count() == 0
    assert lib.compact(str(tmp_path / "new")).table("documents").count() == 0


def test_a_document_that_is_sent_again_is_there_again(spark, tmp_path):
    from test_office import docx

    cache = PageCache(spark, str(tmp_path / "cache"))
    lib = Library(spark, str(tmp_path / "lib"), [NativeEngine()], cache=cache)
    src = spark.createDataFrame([("d" * 64, "d.docx", None, "d" * 64, 1, docx()), ("e" * 64, "e.md", None, "e" * 64, 1, b"# E")], SOURCES)
    jobs = {r.document_id[0]: r for r in lib.submit(src).collect()}
    assert {r.state for r in jobs.values()} == {"done"} and cache.rows().count() == 2
    assert {(r.document_id[0], r.asset_id) for r in cache.asset_rows().collect()} == {("d", "a0"), ("e", None)}
    assert lib.job(jobs["d"].id).state == "done" and lib.job("job_none") is None and lib.jobs().count() == 2
    gone = src.where("filename = 'd.docx'").select("document_id")
    lib.delete(gone)
    lib.delete(gone)
    assert lib.view("d" * 64) is None and lib.asset("d" * 64, "a0") is None and lib.view("e" * 64) == "# E\n"
    assert {r.document_id[0] for r in cache.rows().collect()} == {"e"} and cache.drop(gone) == 0
    assert {r.state for r in lib.submit(src).collect()} == {"done"}
    assert lib.view("d" * 64).startswith("# A title") and lib.asset("d" * 64, "a0") == ("image/png", b"png")
    assert lib.table("documents").count() == 2 and lib.table("blobs", "sha256").count() == 2 and cache.rows().count() == 2
    listing = lib.listing()
    assert listing["cache"] == {"hits": 0, "misses": 3, "pages": 2} and listing["engines"] == [{"name": "native", "version": "1"}]
    assert lib.compact(str(tmp_path / "new")).view("d" * 64).startswith("# A title")


def test_a_full_cache_starts_anew(spark, tmp_path):
    cache = PageCache(spark, str(tmp_path / "cache"), limit=2)
    src = lambda c: spark.createDataFrame([(c * 64, f"{c}.md", None, c * 64, 1, b"# X")], SOURCES)
    kept = []
    for c in "abc":
        process(src(c), [NativeEngine()], cache=cache)
        kept.append({r.document_id[0] for r in cache.rows().collect()})
    assert kept == [{"a"}, {"a", "b"}, {"c"}]


def test_assets_of_a_library(spark, tmp_path):
    from test_office import docx

    lib = Library(spark, str(tmp_path / "lib"), [NativeEngine()])
    lib.submit(spark.createDataFrame([("d" * 64, "d.docx", None, "d" * 64, 1, docx())], SOURCES))
    assert lib.asset("d" * 64, "a0") == ("image/png", b"png") and lib.asset("d" * 64, "a1") is None
    assert "![pic](a0)" in lib.view("d" * 64) and lib.view("d" * 64).startswith("# A title\n")
    lib.delete(spark.createDataFrame([("d" * 64,)], "document_id string"))
    assert lib.asset("d" * 64, "a0") is None


def test_settings_from_variables():
    assert Config.from_env({"PAGEWISE_OCR_THRESHOLD": "0.7", "PAGEWISE_VISION_PROBE": "false", "OTHER": "x"}) == Config(ocr_threshold=0.7, vision_probe=False)
    for bad in ({"PAGEWISE_OCR_SHARDS": "x"}, {"PAGEWISE_VISION_PROBE": "maybe"}, {"PAGEWISE_VISION_THRESHOLD": "0.9"}):
        with pytest.raises(ValueError):
            Config.from_env(bad)

import datetime as dt

from pagewise.functions.text import http_status
from pagewise.operators import cache, jobs
from pagewise.operators import routing as R
from pagewise.sources import store
from pyspark.sql import functions as F

NOW = dt.datetime(2024, 1, 2)


def files(spark, tmp_path, **contents):
    for name, content in contents.items():
        (tmp_path / name.replace("__", ".")).write_bytes(content)
    return store.read_sources(spark, str(tmp_path), most_bytes=100)


def test_sources_are_addressed_by_content(spark, tmp_path):
    got = {r.filename: r for r in files(spark, tmp_path, a__md=b"# x", b__md=b"# x", c__pdf=b"%PDF", empty__txt=b"", big__txt=b"x" * 101).collect()}
    assert sorted(got) == ["a.md", "c.pdf"] and got["c.pdf"].media_type == "application/pdf" and got["a.md"].size_bytes == 3
    bad = store.rejected_files(spark.read.format("binaryFile").load(str(tmp_path)), 100).withColumn("status", http_status(F.col("error_kind")))
    assert [(r.error_kind, r.status) for r in bad.collect()] == [("too_large", 413)]  # files without bytes are not even listed


def test_blobs_are_put_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    src = files(spark, tmp_path / "in", a__md=b"one", b__md=b"two")
    out = str(tmp_path / "blobs")
    store.put_blobs(src, out)
    store.put_blobs(src, out, spark.read.parquet(out))
    stored = spark.read.parquet(out)
    assert stored.count() == 2
    asked = spark.createDataFrame([(r.sha256,) for r in stored.collect()] + [("0" * 64,)], "sha256 string")
    assert sorted(r.error_kind or "" for r in store.resolve(asked, stored).collect()) == ["", "", "not_found"]
    gone = stored.limit(1)
    assert store.remove(stored, gone, "sha256").count() == 1 and store.remove(stored, gone.limit(0), "sha256").count() == 2


def test_sweep_is_strict_and_off_without_a_limit(spark):
    rows = [("a", NOW - dt.timedelta(hours=1)), ("b", NOW - dt.timedelta(hours=1, seconds=1)), ("c", NOW)]
    df = spark.createDataFrame(rows, "sha256 string, modified_at timestamp")
    gone = lambda ttl: [r.sha256 for r in store.expired(df, ttl, F.lit(NOW)).collect()]
    assert gone(3600) == ["b"] and gone(None) == gone(0) == []


def test_assets(spark):
    rows = [("d", "a0", "image/png", b"bytes", None), ("d", "a1", "image/gif", None, "kept"), ("d", "a2", "x", None, None)]
    got = store.commit_assets(spark.createDataFrame(rows, "document_id string, asset_id string, media_type string, content binary, blob_ref string"))
    assert {r.asset_id: len(r.blob_ref) for r in got.collect()} == {"a0": 64, "a1": 4} and store.asset(got, "d", "a1").count() == 1


def test_jobs(spark):
    src = spark.createDataFrame([(f"d{k}", f"f{k}", "text/plain", f"d{k}", 1) for k in range(5)], "document_id string, filename string, media_type string, sha256 string, size_bytes long")
    first, again = jobs.submit(src, 3).collect(), jobs.submit(src, 3).collect()
    assert sorted(first) == sorted(again) and sorted(r.state for r in first) == ["failed"] * 2 + ["queued"] * 3
    assert {r.error_kind for r in first if r.state == "failed"} == {"queue_full"} and jobs.submit(src).where("state = 'queued'").count() == 5
    log = spark.createDataFrame([("a", "d", NOW, "queued"), ("b", "d", NOW + dt.timedelta(1), "done"), ("c", "e", NOW, "failed")], "id string, document_id string, created_at timestamp, state string")
    assert [(r.id, r.place) for r in jobs.newest_first(log).orderBy("place").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    assert {r.state: r.n for r in jobs.by_state(jobs.latest(log)).collect()} == {"done": 1, "failed": 1}
    assert jobs.newest_first(log.limit(0)).count() == 0


def test_cache_stats_and_keys(spark):
    wanted = spark.createDataFrame([("d", 1), ("d", 2), ("e", 1)], "document_id string, number int")
    assert tuple(cache.stats(wanted, wanted.limit(1)).collect()[0]) == (1, 2)
    assert [r[0] for r in spark.createDataFrame([("h|2|e@1|1",), ("hh|2|e@1|1",)], "k string").select(cache.key_matches(F.lit("h"), F.col("k"))).collect()] == [True, False]


def test_metadata(spark):
    schema = "a struct<title: string, author: string, language: string, page_count: int, custom: map<string, string>>, b struct<title: string, author: string, language: string, page_count: int, custom: map<string, string>>"
    df = spark.createDataFrame([((" ", "A", None, 2, {"k": "1"}), ("T", "B", "en", 9, {"k": "2", "l": "3"}))], schema)
    got = df.select(R.merge_metadata(F.col("a"), F.col("b")).alias("m")).collect()[0].m
    assert (got.title, got.author, got.language, got.page_count, got.custom) == ("T", "A", "en", 2, {"k": "1", "l": "3"})


def test_engines_of_equal_support_and_errors(spark):
    rows = [("d", 0, 50, None, "a"), ("d", 1, 90, None, "b"), ("d", 2, 90, None, "c"), ("e", 0, 0, None, "a"), ("e", 1, 90, "malformed", "b"), ("f", 0, 90, "unsupported", "a"), ("g", 0, 0, None, "a")]
    got = {r.document_id: (r.engine, r.error_kind) for r in R.choose_engine(spark.createDataFrame(rows, "document_id string, reg_order int, support int, error_kind string, engine string")).collect()}
    assert got == {"d": ("b", None), "e": (None, "malformed"), "f": (None, "unsupported"), "g": (None, "unsupported")}


def test_shards_split_like_hand_dealt_runs(spark):
    for n, shards, want in ((5, 2, [3, 2]), (2, 5, [1, 1]), (6, 3, [2, 2, 2]), (7, 3, [3, 2, 2])):
        got = R.shard_pages(spark.range(n).selectExpr("'d' as document_id", "cast(id + 1 as int) as number"), shards)
        runs = [sorted(r.number for r in rows) for _, rows in __import__("itertools").groupby(sorted(got.collect(), key=lambda r: r.number), key=lambda r: r.shard)]
        assert [len(r) for r in runs] == want and sum(runs, []) == list(range(1, n + 1))


def test_incomplete_documents_take_the_first_page(spark):
    rows = [("d", 1, ["vision_failed"]), ("d", 3, ["ocr_failed"]), ("d", 2, ["x", "not_extracted"]), ("e", 1, ["vision_empty"]), ("f", 1, None)]
    got = R.incomplete_documents(spark.createDataFrame(rows, "document_id string, number int, reasons array<string>")).collect()
    assert [tuple(r) for r in got] == [("d", 2, "not_extracted")]

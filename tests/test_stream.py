import datetime as dt

from pagewise.plans.engines import ImageEngine, NativeEngine, StubOcr
from pagewise.streaming.ingest import ingest_batch, ingest_stream, job_counts


def test_a_stream_reads_each_content_once_and_restarts(spark, tmp_path):
    landing, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    landing.mkdir()
    run = lambda: ingest_stream(spark, str(landing), out, [NativeEngine(), ImageEngine()], ck, ocr=StubOcr()).awaitTermination()
    (landing / "a.md").write_text("# One\n\nSome words.")
    (landing / "b.bin").write_bytes(b"\0\1\2")
    run()
    (landing / "c.txt").write_text("Two\n\nmore words")
    (landing / "a-copy.md").write_text("# One\n\nSome words.")
    run()
    run()
    docs = spark.read.parquet(f"{out}/documents")
    assert docs.count() == docs.select("document_id").distinct().count() == 2
    assert spark.read.parquet(f"{out}/pages").count() == 2
    assert spark.read.parquet(f"{out}/failures").count() == 1
    assert {r.markdown.split("\n")[0] for r in spark.read.parquet(f"{out}/views").collect()} == {"# One", "Two"}


def test_a_batch_that_runs_again_doubles_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("words")
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    for _ in range(2):
        ingest_batch(files, 0, str(tmp_path / "out"), [NativeEngine()])
    assert spark.read.parquet(str(tmp_path / "out" / "documents")).count() == 1


def test_counts_by_window(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "done"), (t + dt.timedelta(minutes=30), "done"), (t + dt.timedelta(hours=1), "failed")], "created_at timestamp, state string")
    assert sorted((r.start, r.state, r.n) for r in job_counts(df).collect()) == [(t, "done", 2), (t + dt.timedelta(hours=1), "failed", 1)]

import random
import time

import pytest
from pagewise.functions import metrics, quality, text
from pyspark.sql import functions as F


def one(spark, column, *rows, schema="a string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def score(spark, *blocks, type="native", confidence=1.0):
    rows = [([{"text": t, "confidence": c} for t, c in blocks], type, confidence)]
    df = spark.createDataFrame(rows, "blocks array<struct<text: string, confidence: double>>, type string, confidence double")
    return quality.score_pages(df).collect()[0].quality


def test_golden_scores(spark):
    q = score(spark, ("Chapter One", None))
    assert q.char_count == 12 and q.score == pytest.approx(0.709)
    q = score(spark, ("��� �� ����", None))
    assert (q.char_count, q.replacement_ratio, q.word_ratio) == (12, 0.75, 0.0) and q.score == pytest.approx(0.2215)


def test_empty_pages_score_zero(spark):
    assert score(spark).score == 0 and score(spark, ("", None), (None, 0.5)).score == 0


def test_control_characters_are_damage_and_white_space_is_not(spark):
    assert score(spark, ("a\tb\r\nc\x01\x85", None)).replacement_ratio == pytest.approx(2 / 9)


def test_languages_without_spaces_and_sparse_pages_are_not_punished(spark):
    assert score(spark, ("日本語の文章です。" * 60, None)).score == pytest.approx(1.0)
    assert score(spark, ("Chapter One", None)).score > 0.60


def test_measured_branch(spark):
    q = score(spark, ("Confidently misread words of a page " * 12, 0.42), type="scanned", confidence=0.9)
    assert q.measured_confidence == pytest.approx(0.42) and q.measured_coverage == 1 and q.score == pytest.approx(0.42)
    q = score(spark, ("x" * 10, 0.1), ("y" * 100, None))
    assert q.measured_coverage == pytest.approx(10 / 110) and q.score > 0.6
    assert score(spark, ("text", -1.0)).measured_confidence == 0 and score(spark, ("text", 2.0)).measured_confidence == 1


def test_engine_confidence_is_null_for_scans_that_report_none(spark):
    assert score(spark, ("t", None), type="scanned", confidence=0.0).engine_confidence is None
    assert score(spark, ("t", None), type="native", confidence=0.0).engine_confidence == 0


def test_marks_and_formats_are_implausible_and_punctuation_is_not(spark):
    got = one(spark, quality.word_ratio(F.col("a")), "abc ... $5", "a\u0301b ab", "x\u200by", "\u00bd", "")
    assert got == [1.0, 0.5, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("same", "same", 0), ("same  text", " same\ntext ", 0), ("Amount due 1,250.00", "Amountdue 1,250.00", 1 / 19), ("", "x", 1), ("", "", 0), ("x", None, 1), ("a" * 5000, "a" * 4000 + "b" * 1000, 0), ("日本語", "日本酒", 1 / 3)],
)
def test_disagreement(spark, a, b, want):
    d = metrics.disagreement
    got = spark.createDataFrame([(a, b)], "a string, b string").select(d(F.col("a"), F.col("b")).alias("x"), d(F.col("b"), F.col("a")).alias("y")).collect()[0]
    assert got.x == got.y == pytest.approx(want)


def test_edit_distance_is_the_built_in_one_and_not_its_time(spark):
    rnd = random.Random(8)
    rows = [("", ""), ("", "ab"), ("kitten", "sitting"), ("\U0001f600é日", "é日\U0001f601"), ("a" * 64, "b" * 65), (None, "x"), ("ab" * 200, "ba" * 200)]
    for _ in range(150):
        letters = "ab" if rnd.random() < 0.5 else "abcdeé日\U0001f600 "
        a = "".join(rnd.choices(letters, k=rnd.choice([1, 30, 63, 64, 65, 128, 300])))
        b = a.replace("a", "") if rnd.random() < 0.3 else "".join(rnd.choices(letters, k=rnd.randrange(260))) if rnd.random() < 0.5 else "".join(rnd.choice(letters) if rnd.random() < 0.2 else c for c in a)
        rows.append((a, b))
    both = spark.createDataFrame(rows, "a string, b string")
    got = both.select(metrics.edit_distance(F.col("a"), F.col("b")).alias("x"), metrics.edit_distance(F.col("b"), F.col("a")).alias("y"), F.levenshtein("a", "b").alias("z")).collect()
    assert all(r.x == r.y == r.z for r in got)
    long = "".join(rnd.choices("abcdefgh ", k=4000))
    pairs = spark.createDataFrame([(f"{k}{long}", f"{long[::-1]}{k}") for k in range(40)], "a string, b string").coalesce(1).cache()
    pairs.count()

    def seconds(distance):
        start = time.time()
        pairs.agg(F.sum(distance(F.col("a"), F.col("b")))).collect()
        return time.time() - start

    seconds(metrics.edit_distance)
    assert 4 * seconds(metrics.disagreement) < seconds(F.levenshtein)
    assert not any(x in pairs.select(metrics.disagreement(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Pandas"))


def test_error_rates(spark):
    df = spark.createDataFrame([("a b c d", "a x c d"), ("a b", ""), ("", ""), ("", "x"), ("ab", "abcdefgh"), ("w " * 500, "w " * 499)], "e string, g string")
    got = df.select(metrics.cer(F.col("e"), F.col("g")).alias("c"), metrics.wer(F.col("e"), F.col("g")).alias("w")).collect()
    assert [r.w for r in got] == pytest.approx([0.25, 1, 0, 1, 1, 1 / 500])
    assert [r.c for r in got][:5] == pytest.approx([1 / 7, 1, 0, 1, 1])


def test_wer_against_a_plain_edit_distance(spark):
    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x):
            row = _next(row, a, y, i)
        return row[-1]

    def _next(row, a, y, i):
        out = [i + 1]
        for j, b in enumerate(y):
            out.append(min(out[j] + 1, row[j + 1] + 1, row[j] + (a != b)))
        return out

    import random

    rnd = random.Random(4)
    rows = [(" ".join(rnd.choices("abcdef", k=rnd.randrange(1, 12))), " ".join(rnd.choices("abcdefg", k=rnd.randrange(1, 12)))) for _ in range(80)]
    got = spark.createDataFrame(rows, "e string, g string").select("e", "g", metrics.wer(F.col("e"), F.col("g")).alias("w")).collect()
    for r in got:
        x, y = r.e.split(), r.g.split()
        assert r.w == pytest.approx(min(1, plain(x, y) / len(x)))


def test_paragraphs(spark):
    got = one(spark, text.paragraphs(F.col("a")), "a\n\n\nb", "x\r\n\r\ny", "  indent  \nline\t\n\n \n\nz\n", "")
    assert got == [["a", "\nb"], ["x\n\ny"], ["  indent\nline", "z"], []]


def test_names(spark):
    assert one(spark, text.safe_segment(F.col("a")), "../../etc", "a/..", "", "/", "x\\y.md", "..", "a/./b/") == ["etc", "_", "_", "_", "y.md", "_", "b"]
    assert one(spark, text.blob_path(F.col("a")), "abcd", "a") == ["blobs/ab/abcd", "blobs/__/a"]
    assert one(spark, text.valid_document_id(F.col("a")), "a" * 64, "A" * 64, "a" * 63, "a" * 64 + "\n", None) == [True, False, False, False, False]
    assert one(spark, text.extension(F.col("a")), "x.TAR.gz", "dir.d/x", "x.", None) == ["gz", None, None, None]
    assert one(spark, text.detection_name(F.col("a"), F.lit("p.md")), " ", None, "n.txt") == ["p.md", "p.md", "n.txt"]


def test_formats(spark):
    heads = [b"%PDF-1.7", b"{\\rtf1", b"\xff\xd8\xff", b"RIFF\0\0\0\0WEBP", b"RIFF\0\0\0\0WAVE", b"BM" + b"\0" * 24, b"BM text", b"GIF89a", b"II*\0", b""]
    got = one(spark, text.detect_format(F.col("a"), F.lit("x.md")), *[(h,) for h in heads], schema="a binary")
    assert got == ["pdf", "rtf", "image", "image", "markdown", "image", "markdown", "image", "image", "markdown"]


def test_cache_keys(spark):
    key = lambda c: text.cache_key(F.lit("h"), F.lit("2"), F.lit("e"), F.lit("1"), F.lit(3), c)
    df = spark.range(1)
    plain, a, b = df.select(key(F.lit(None).cast("map<string,string>")), key(F.create_map(F.lit("x"), F.lit("1"), F.lit("a"), F.lit("2"))), key(F.create_map(F.lit("a"), F.lit("2"), F.lit("x"), F.lit("1")))).collect()[0]
    assert plain == "h|2|e@1|3" and a == b and a.startswith(plain + "|") and len(a) == len(plain) + 17


def test_page_lists_and_sizes(spark):
    assert one(spark, text.page_numbers(F.col("a")), "3, 1,3", "", None, "0", "x", "2,") == [[1, 3], None, None, [], [], [2]]
    assert one(spark, text.clamp_dpi(F.col("a")), 10, 200, 900, schema="a int") == [72, 200, 600]
    df = spark.createDataFrame([(4000, 4000), (100, 100), (10_000_000, 1)], "w int, h int")
    assert [tuple(r[0]) for r in df.select(text.fit_pixels(F.col("w"), F.col("h"))).collect()] == [(2000, 2000), (100, 100), (6324555, 1)]


def test_services_and_exit_codes(spark):
    df = spark.createDataFrame([("encrypted", 500), ("resource_limit", 400), ("odd", 415), (None, 413), (None, 502)], "k string, s int")
    assert [r[0] for r in df.select(text.service_error_kind(F.col("k"), F.col("s"))).collect()] == ["encrypted", "malformed", "unsupported", "malformed", "internal"]
    assert one(spark, text.exit_error_kind(F.col("a")), 0, 1, 2, 3, 4, 9, schema="a int") == [None, "internal", "unsupported", "malformed", "encrypted", "internal"]

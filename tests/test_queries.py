"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import datetime as dt
import hashlib
import math
import re
from decimal import Decimal

import __spark_entry__ as entry
import duckdb
import pytest
from pagewise.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in data), key=lambda r: [(v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = rows(got.columns, map(tuple, got.collect())), rows(columns, want.fetchall())
    assert len(a) == len(b) > 0 or name == "stored_documents_reused"
    for x, y in zip(a, b):
        assert all(u == v or isinstance(u, (int, float)) and isinstance(v, (int, float)) and math.isclose(u, v, rel_tol=1e-8) for u, v in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_others_give_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_document_queries_stay_in_the_jvm(spark):
    for name in ("page_quality", "rank_ocr_pages", "merge_pages", "region_confidence", "disagreement", "wer", "text_paragraphs"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_pages_of_one_document_don_t_reach_python_with_others(spark):
    out = queries.process_documents(spark, SF)
    assert out.where("score < 0 or score > 1 or n_blocks < 1").count() == 0


def collapsed(t):
    return re.sub(r"[^\S\x1c-\x1f]+", " ", t).strip(" ")


def distance(a, b):
    """Edit distance in code points, a column of the table as the bits of one number."""
    if not a:
        return len(b)
    at, full, last, score = {}, (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down = full, 0
    for c in b:
        eq = at.get(c, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = down | full & ~(xh | up), up & xh
        score += bool(ph & last) - bool(mh & last)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        up, down = mh | full & ~(xv | ph), ph & xv
    return score


def test_disagreement_of_whole_texts_by_brute_force(spark, tmp_path):
    assert distance("kitten", "sitting") == 3 and distance("", "ab") == 2 and distance("日本語", "日本") == 1
    rows = [(1, "xyz " * 300 + "aeiou " * 900), (2, "Überfälle in Köln, " * 400), (3, "数字 aeiou\u2003x"), (4, ""), (5, "aeiou"), (6, "  \n "), (7, "b" * 4500 + "a" * 500)]
    whole = spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("doc_id", "text").collect()
    rows += [(100 + r.doc_id, r.text) for r in whole]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.disagreement, r.cer) for r in queries.disagreement_whole(spark, str(tmp_path)).collect()}
    for i, t in rows:
        a, b = collapsed(t), collapsed(re.sub("[aeiou]", "", t))
        x, y = a[:4000], b[:4000]
        want = 0.0 if not x and not y else 1.0 if not x or not y else distance(x, y) / max(len(x), len(y))
        cer = min(1.0, distance(a, b) / len(a)) if a else float(bool(b))
        assert got[i] == pytest.approx((want, cer), abs=1e-6), i
    assert len(got) == len(rows) and got[1][0] > 0.3 and got[7] == (0.0, 0.1)


def test_text_functions_reach_the_end_of_a_text(spark, tmp_path):
    long = "word " * 4000
    rows = [(1, long + "a_b*c\\ \u00a0\u2003 end \n"), (2, long + "abc end"), (3, ""), (4, " [x]<|` ")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.text_functions_whole(spark, str(tmp_path)).select("doc_id", "escaped_sha256", "escaped_chars", "collapsed_sha256", "collapsed_chars").collect()}
    for i, t in rows:
        a, b = re.sub(r"([\\`*_\[\]<|])", r"\\\1", f"s_[en]|`{t}"), collapsed(t)
        assert got[i] == (hashlib.sha256(a.encode()).hexdigest(), len(a), hashlib.sha256(b.encode()).hexdigest(), len(b)), i

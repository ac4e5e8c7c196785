import bisect
import random
import zlib
from collections import Counter, defaultdict

from pagewise.llm import sharding as s


def check(docs, n=8):
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    got = s.digest(docs, n).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < n and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    for x in slots.values():
        assert sorted(x) == list(range(len(x)))
    return sizes, max([r["size"] for r in got], default=0)


def test_equal_bytes_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes, largest = check(docs)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    check(no_docs)


def test_many_small_rows_meet_the_tolerance(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text", "1 as size", "'a' as shard")
    sizes, _ = check(docs)
    mean = sum(sizes.values()) / 8
    assert all(abs(v - mean) < 0.003 * mean for v in sizes.values())


def test_same_result_again_and_rows_in_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = s.digest(docs).select("doc_id", "shard", "slot").collect()
    b = s.digest(docs.repartition(5)).select("doc_id", "shard", "slot").collect()
    assert sorted(a) == sorted(b)


def test_whole_rows_are_kept(odd_docs):
    got = s.shard_documents(odd_docs, 3)
    assert got.columns == [*odd_docs.columns, "size", "shard", "slot"] and got.count() == 13


def test_one_key_with_a_third_of_the_rows(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text")
    sizes, largest = check(docs)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * largest + 0.002 * sum(sizes.values()) / 8


def test_hot_rows_that_differ_in_other_columns(spark):
    docs = spark.range(4000).selectExpr("if(id % 2 = 0, 7, id) as doc_id", "if(id % 2 = 0, 'hot', cast(id as string)) as text", "id % 5 as nth", "map('a', id % 3) as m")
    got = s.shard_documents(docs)
    n = Counter(r.shard for r in got.collect())
    assert sum(n.values()) == 4000 and len(n) == 8
    assert Counter((r.doc_id, r.text, r.nth, r.m["a"]) for r in got.collect()) == Counter((r.doc_id, r.text, r.nth, r.m["a"]) for r in docs.collect())
    sizes, largest = check(docs.select("doc_id", "text"))
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest + 0.002 * sum(sizes.values()) / 8


def test_shards_do_not_follow_the_settings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    a = sorted(s.digest(docs).select("doc_id", "shard", "slot").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert sorted(s.digest(docs.repartition(3)).select("doc_id", "shard", "slot").collect()) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_intervals_by_brute_force(spark):
    rnd = random.Random(3)
    keys = [rnd.getrandbits(64) - (1 << 63) for _ in range(2000)] + [-(1 << 63), (1 << 63) - 1, 0, -1]
    for n in (0, 1, 2, 7, 500):
        bounds = sorted([rnd.getrandbits(64) - (1 << 63) for _ in range(n - n // 4)] + keys[: n // 4])
        got = s.with_interval(spark.createDataFrame([(k,) for k in keys], "key long"), "key", bounds, "i").collect()
        assert len(got) == len(keys) and all(r.i == bisect.bisect_right(bounds, r.key) for r in got)


def test_plan_has_no_python(odd_docs):
    plan = s.digest(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

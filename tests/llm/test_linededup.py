import hashlib
from collections import defaultdict

import pyarrow.parquet as pq

from pagewise.llm import linededup as ld

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows):
    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(odd_docs, no_docs):
    got = sorted((tuple(r) for r in ld.digest(odd_docs).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert ld.digest(no_docs).count() == 0


def test_documents(spark):
    at = "/root/testdata/sf0.01/documents.parquet"
    table = pq.read_table(at, columns=["doc_id", "text"])
    got = sorted((tuple(r) for r in ld.digest(spark.read.parquet(at)).collect()), key=str)
    assert got == brute(list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist())))
    assert sum(r[2] for r in got) > 100


def test_white_space_and_long_line_runs(spark):
    rows = [
        (1, "\x0b\x0cShared line here\r\n\x85Shared line here\n" + "\n".join(f"unique line {i}" for i in range(3000))),
        (2, "shared LINE here\n\x85Shared line here\n" + "\n".join(f"unique line {i}" for i in range(0, 3000, 2)) + "\nlast"),
        (3, "É" * 10 + "\nshort key\n" + "é" * 10),
        (4, "É" * 10 + "\nshort key\n" + "é" * 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ld.digest(docs).collect()), key=str) == brute(rows)


def test_a_hot_line_reaches_over_many_partitions(spark):
    rows = [(i, f"a line that all of them have\nmine alone {i % 700}\nthe second of the common lines") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        seen = ld.occurrences(docs, "doc_id", "text", 10)
        assert seen.groupBy("h1", "h2").agg(ld.F.count_distinct("part").alias("n")).where("n > 2").count() == 2
        assert sorted(map(tuple, ld.digest(docs).collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_extra_columns_stay(odd_docs):
    got = ld.dedup_lines(odd_docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "found", "n_lines", "n_dropped", "kept"] and got.count() == 13


def test_plan_has_no_python(odd_docs):
    plan = ld.digest(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

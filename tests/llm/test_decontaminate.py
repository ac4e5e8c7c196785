import hashlib
import re

from pagewise.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "the quick brown fox jumps over the lazy dog near the river bank"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    ws, hit, ids = words(text), set(), set()
    for item, body in items:
        iw = words(body)
        if not iw or item is None:
            continue
        m = min(10, len(iw))
        wins = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)}
        for i in range(len(ws) - m + 1):
            if tuple(ws[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                ids.add(str(item))
    return len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, ITEM), (10, "Wörds — with"), (2, "word " * 12), (3, None), (None, "same row"), (4, "..."), (2, "word " * 12), (9, "Row, twice!")]


def test_against_brute_force(spark, odd_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in d.digest(odd_docs, bench).collect()), key=str)
    assert got == sorted(((r.doc_id, *brute(r.text, ITEMS)) for r in odd_docs.collect()), key=str)
    assert sum(r[-1] for r in got) >= 5


def test_parts_of_a_large_benchmark_give_the_same(spark, odd_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = d.scan_benchmark(odd_docs.select("doc_id", "text"), bench).select("doc_id", "found.n_words", "found.hit_ranges", "found.items")
    parts = d.scan_benchmark(odd_docs.select("doc_id", "text"), bench, set_bytes=40).select("doc_id", "found.n_words", "found.hit_ranges", "found.items")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(whole) == key(parts)


def test_remove(spark, odd_docs):
    bench = spark.createDataFrame([(1, ITEM), (9, "Row, twice!")], "item_id long, text string")
    docs = odd_docs.unionByName(spark.createDataFrame([(20, "A B c d e f g h. " * 3 + ITEM.upper() + "! And so on and on.", "en", "s", 0, 1, "y")], odd_docs.schema))
    got = d.remove_contamination(docs, bench)
    assert got.columns == docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert 1 not in rows and 5 not in rows  # most of their words are hit
    assert rows[20].text == "A B c d e f g h. " * 3 + "! And so on and on." and rows[20].n_chars == len(rows[20].text)
    assert rows[2].text is None and rows[7].text == "  line ONE is here for all \nother words follow\nLine two is here for all"
    assert d.digest(got, bench).where("contaminated").count() == 0


def test_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.digest(no_docs, none).count() == 0
    assert d.digest(odd_docs, none).where("n_hit > 0 or items_sha256 is null").count() == 0


def test_many_texts_per_step(spark):
    rows = [(i, f"{'Ab ' * (i % 7)}one two three four five six seven eight nine ten{' zz' * (i % 3)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, "one two three four five six seven eight nine ten"), (6, "ten zz zz")], "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in d.digest(docs, bench).collect()}
    assert all(got[i] == brute(t, [(5, bench.collect()[0].text), (6, "ten zz zz")]) for i, t in rows[:50])
    assert sum(g[1] for g in got.values()) == sum(brute(t, [(5, rows[0][1]), (6, "ten zz zz")])[1] for _, t in rows)


def test_parts_of_a_large_benchmark_cut_the_same(spark, odd_docs):
    w = [f"w{k}" for k in range(40)]
    line = lambda *parts: " ".join(" ".join(w[a:b]) for a, b in parts)
    # Overlapping items, and a window that is there only when another item's is cut.
    items = [(1, line((1, 11))), (2, line((5, 15))), (3, line((20, 30))), (4, line((16, 20), (30, 36)))]
    texts = [line((0, 16)), "Say: " + line((16, 36)) + " end.", line((0, 40)), line((5, 15), (1, 11)), "nothing here", line((20, 25), (1, 15), (25, 30))]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").union(odd_docs.select("doc_id", "text"))
    bench = spark.createDataFrame(items + [(k + 10, b) for k, (_, b) in enumerate(ITEMS) if b], "item_id long, text string")
    whole = d.scan_benchmark(docs, bench, clean=True)
    want = sorted(map(str, whole.collect()))
    for size in (30, 60, 90, 200):
        parts = d.scan_benchmark(docs, bench, clean=True, set_bytes=size)
        assert parts.columns == whole.columns and sorted(map(str, parts.collect())) == want
    got = {r.doc_id: r.found.cleaned for r in whole.where("text like '%w%'").collect()}
    assert got[100] == "w0  w15" and got[101] == "Say:  end." and not got[105].split()
    assert d._sets(bench, 10, 30)[1:] and d.digest(parts.select("doc_id", d.F.coalesce("found.cleaned", "text").alias("text")), bench).where("contaminated").count() == 0


def test_a_long_item_is_cut_into_pieces_that_have_its_windows(spark):
    w = [f"W{k}" for k in range(400)]
    items = [(1, "; ".join(w)), (2, "w1 w2 w3")]
    docs = spark.createDataFrame([(1, " ".join(w[100:130])), (2, "x " + " ".join(w[5:14]) + " y"), (3, " ".join(w[390:])), (4, " ".join(w))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(d._sets(bench, 10, 200)) > 3 and d._pieces(bench.selectExpr("string(item_id) as item", "text as body"), 10, 200).count() > 10
    got = d.scan_benchmark(docs, bench, set_bytes=200).collect()
    want = {r.doc_id: brute(r.text, items) for r in docs.collect()}
    for r in got:
        hit = sum(x.end - x.first for x in r.found.hit_ranges)
        assert (r.found.n_words, hit, len(r.found.items)) == want[r.doc_id][:3]
    assert want[4][1] == 400 and want[2][1] == 0

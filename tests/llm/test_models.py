"""The three operators that learn: held-out accuracy, odd rows, empty tables, brute force where there is one."""

import zlib
from collections import Counter

import numpy as np
import pytest

from pagewise.llm import langid, quality, toxicity


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


@pytest.fixture(scope="module")
def tables(spark):
    at = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{at}/documents.parquet").cache(), spark.read.parquet(f"{at}/labels.parquet")


def held_out(got, labels, label):
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    yes, no = [r.predicted for r in rows if r[label]], [r.predicted for r in rows if not r[label]]
    return np.mean(yes), np.mean(no)


def test_quality_held_out(tables):
    docs, labels = tables
    kept, junk = held_out(quality.digest(docs, labels), labels, "quality")
    assert kept > 0.98 and junk < 0.2


def test_toxicity_held_out(tables):
    docs, labels = tables
    found, false = held_out(toxicity.digest(docs, labels), labels, "toxic")
    assert found > 0.75 and false < 0.01


def test_language_held_out(tables):
    docs, _ = tables
    got = langid.digest(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang").count() / got.count() > 0.98


@pytest.mark.parametrize("op", ["quality", "toxicity", "langid"])
def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs, op):
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(1, 12)] + [(1, None, None, "y"), (None, 1, 1, "z")], "doc_id long, quality int, toxic int, key string")
    none = labels.limit(0)
    run = {"quality": quality.digest, "toxicity": toxicity.digest, "langid": lambda d, _: langid.digest(d)}[op]
    modulus, left = (4, 2) if op == "toxicity" else (5, 0)
    for docs, known in ((odd_docs, labels), (odd_docs, none), (no_docs, none), (no_docs, labels)):
        got = run(docs, known).collect()
        assert Counter((r.doc_id, r.held_out) for r in got) == Counter((r.doc_id, crc(r.doc_id) % modulus == left) for r in docs.collect())
        assert all(0 <= r.score <= 1 for r in got)
        if op != "langid":
            assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_training_never_sees_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en" if crc(i) % 5 else "xx") for i in range(300)], "doc_id long, text string, lang string")
    assert {lang for _, lang in langid.training_rows(docs)} == {"en"}
    labels = spark.createDataFrame([(i, int(crc(i) % 5 == 0)) for i in range(300)], "doc_id long, quality int")
    got = quality.model_rows(spark, docs, labels, "quality", 5, 0, 4000, 1000)
    assert len(got) == sum(crc(i) % 5 != 0 for i in range(300)) and not any(y for _, y in got)


def test_language_counts_and_distances_by_brute_force():
    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        padded = " " + " ".join(words) + " "
        out = Counter(c for c in padded if c != " ") + Counter(padded[i : i + 2] for i in range(len(padded) - 1))
        return out + Counter(g for i in range(len(padded) - 2) if (g := padded[i : i + 3])[1] != " ")

    decode = lambda code: "".join(" " if c == 1 else chr(c - 2) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c)
    for text in ("Hello, hello wörld!", "a", "  x--y  ", "één twee drie " * 40):
        codes, counts = langid.ngram_counts(text)
        assert {decode(int(c)): int(n) for c, n in zip(codes, counts)} == dict(grams(text))
    assert all(not len(langid.ngram_counts(t)[0]) for t in ("", "123 !?", "\n"))
    profiles = langid.Profiles.fit([("the cat and the hat", "en"), ("der hund und die katze", "de")], depth=20)
    codes, counts = langid.ngram_counts("the dog and the katze")
    own, places = langid.ranked(codes, counts, 20)
    for k in range(2):
        rank = {int(c): profiles.ranks[i, k] for i, c in enumerate(profiles.codes) if profiles.ranks[i, k] < 20}
        want = sum(abs(p - rank[int(c)]) if int(c) in rank else 20 for c, p in zip(own, places)) / (20 * len(own))
        assert abs(want - profiles.distances("the dog and the katze")[k]) < 1e-9


def test_pieces_of_a_long_text_count_as_one(monkeypatch):
    text = "Some words, über alles; 12 x  y " * 50
    want = langid.ngram_counts(text)
    for piece in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "PIECE", piece)
        got = langid.ngram_counts(text)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_unknown_texts_go(spark):
    docs = spark.createDataFrame([(1, "the cat and the hat"), (2, None), (3, "123"), (4, "жжж щщщ")], "doc_id long, text string")
    profiles = langid.Profiles.fit([("the cat and the hat", "en"), ("der hund und die katze", "de")])
    assert [r.doc_id for r in langid.keep_known(docs, profiles, 0.3).collect()] == [1]


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 511, 512, 513, 1016, 1017, 5000):
        data = np.arange(n, dtype=np.int64).astype(np.uint8) | 1
        counts = quality.chunk_counts(np.array([0, n]))
        chunks = quality.chunked(data, np.array([0, n]), 0, counts[0])
        covered = sum((chunks[k] != 0).sum() for k in range(len(chunks))) - (quality.CHUNK - quality.HOP) * (counts[0] - 1)
        assert covered == n and len(chunks) == counts[0]


def test_texts_are_scored_alike_alone_and_together():
    net, r = quality.ConvNet.fresh(6), np.random.default_rng(7)
    texts = [bytes(r.integers(32, 120, n, dtype=np.uint8)) for n in (0, 5, 600, 200_000, 1, 512, 0, 3000)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.scores(np.frombuffer(b"".join(texts), np.uint8), offsets)
    alone = [net.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(got, alone, atol=1e-6)


def test_words_of_a_long_text_hash_alike_in_pieces(monkeypatch):
    from pagewise.llm import bytewords

    data = np.frombuffer(("some words, and many more of them " * 400 + "x" * 5000 + " end").encode(), np.uint8)
    found = bytewords.find_words(data, np.array([0, len(data)]), toxicity.WORD)
    want = found.hashes()
    monkeypatch.setattr(bytewords, "PIECE", 64)
    assert np.array_equal(found.hashes(), want) and len(set(want.tolist())) == 9


def test_convolution_by_brute_force():
    net = quality.ConvNet.fresh(3)
    chunk = np.random.default_rng(1).integers(0, 256, (2, quality.CHUNK), dtype=np.uint8)
    vectors = net.embed[chunk]
    want = np.max([vectors[:, i : i + 8].reshape(2, -1) @ net.filters for i in range(0, quality.CHUNK - 7, quality.STRIDE)], 0)
    assert np.allclose(net.pooled(chunk), np.maximum(want + net.bias, 0), atol=1e-4)


def test_gradient_of_the_net_by_differences():
    net = quality.ConvNet.fresh(4)
    for p in ("embed", "filters", "bias", "hidden", "hidden_bias", "out", "out_bias"):
        setattr(net, p, getattr(net, p).astype(np.float64))
    r = np.random.default_rng(2)
    chunks, y, weight = r.integers(0, 256, (6, quality.CHUNK), dtype=np.uint8), np.array([0, 1, 1, 0, 1, 0.0]), np.ones(6)
    loss = lambda: np.mean(np.log1p(np.exp(-np.where(y > 0, 1, -1) * net.logits(chunks))))
    for p, g in zip(net.parameters(), net._step(chunks, y, weight)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, h = p[at], 1e-5
        p[at] = old + h
        up = loss()
        p[at] = old - h
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * h) - g[at]) < 1e-4 * max(1, abs(g[at]))


def test_machine_by_brute_force_and_learns_a_pair():
    r = np.random.default_rng(3)
    rows = []
    for _ in range(2000):
        a, b = (r.random(2) < 0.5).tolist()
        rows.append((f"{'insult ' * a}{'people ' * b}pad{r.integers(5)}", int(a and b)))
    m = toxicity.FactorizationMachine.fit(rows)
    assert (m.v != 0).any()
    raw = [t.encode() for t, _ in rows[:50]]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got = m.scores(data, offsets)
    for k, text in enumerate(raw):
        own = toxicity.terms(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        logit = m.bias + sum(m.w[own]) + sum(m.v[i] @ m.v[j] for x, i in enumerate(own) for j in own[x + 1 :])
        assert abs(1 / (1 + np.exp(-logit)) - got[k]) < 1e-9
    assert np.mean((got >= 0.5) == [y for _, y in rows[:50]]) > 0.95


def test_machine_learns_a_pair_of_words_that_tell_nothing_alone():
    r, rows = np.random.default_rng(3), []
    for _ in range(6000):
        a, b = (r.random(2) < 0.5).tolist()
        rows.append((f"{'insult ' * a}{'people ' * b}pad{r.integers(5)} w{r.integers(40)} w{r.integers(40)}", int(a == b)))
    m = toxicity.FactorizationMachine.fit(rows[:5000])
    raw = [t.encode() for t, _ in rows[5000:]]
    got = m.scores(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert np.mean((got >= 0.5) == [y for _, y in rows[5000:]]) > 0.97


def test_quality_without_labels_is_the_prior(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.digest(odd_docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(1, 12)], "doc_id long, quality int")
    scores = {round(r.score, 6) for r in quality.digest(odd_docs, ones).collect()}
    assert len(scores) == 1 and 0.5 < scores.pop() < 1


def test_every_chunk_of_a_labelled_text_is_learned():
    """A mark that stands far behind the start of a long text decides."""
    r = np.random.default_rng(5)
    noise = lambda n: "".join(r.choice(list("abcdefgh "), n))
    rows = [(noise(400) if k % 2 else noise(3000) + " ZZZZZZZZ " * 60 + noise(10), k % 2) for k in range(200)]
    net = quality.ConvNet.fit(rows)
    raw = [t.encode() for t, _ in rows]
    chunks = quality.chunk_counts(np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert chunks[0] > 6 and net.logits(quality.chunked(np.frombuffer((" ZZZZZZZZ " * 60).encode(), np.uint8), np.array([0, 600]), 0, 1))[0] < net.logits(quality.chunked(np.frombuffer(noise(400).encode(), np.uint8), np.array([0, 400]), 0, 1))[0]


def test_long_texts_are_read_in_windows_only_where_the_sample_is_full(spark):
    from pagewise.llm import common
    from pyspark.sql import functions as F

    assert common.fair_length([5, 100, 7, 50], 80) == 34 and common.fair_length([5, 7], 80) == 7 and common.fair_length([], 9) == 0
    text = "".join(chr(0x4E00 + k) for k in range(5000))
    got = spark.createDataFrame([(text,), ("short",)], "t string").select(common.windows(F.col("t"), 500)).collect()
    assert len(got[0][0]) <= 500 and got[0][0].startswith(text[:10]) and got[0][0].endswith(text[-10:]) and len(got[0][0].split(" ")) == 21 and got[1][0] == "short"
    docs = spark.createDataFrame([(i, text * (1 + 3 * (i == 1)) + str(i)) for i in range(8)] + [(2, text + "2")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    n = sum(crc(i) % 5 != 0 for i in range(8))
    assert sorted(len(t) for t, _ in quality.model_rows(spark, docs, labels, "quality", 5, 0, 100, 100))[0] == 5001
    small = quality.model_rows(spark, docs, labels, "quality", 5, 0, 100, 100, 3000)
    assert len(small) == n and sum(len(t) for t, _ in small) <= 3000


def test_text_ids_work(spark):
    docs = spark.createDataFrame([(f"d{i}", f"words {i} " * (1 + i % 3)) for i in range(40)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2, i % 2) for i in range(40)], "doc_id string, quality int, toxic int")
    assert quality.digest(docs, labels).count() == toxicity.digest(docs, labels).count() == 40


def test_languages_of_long_texts_alone_are_learned(spark):
    long = [(i, "les petites maisons sont rouges et grises " * 1500, "fr") for i in range(10)]
    short = [(100 + i, "the little houses are red and grey over there", "en") for i in range(10)]
    docs = spark.createDataFrame([*long, *short, (200, None, "de")], "doc_id long, text string, lang string")
    rows = langid.training_rows(docs)
    assert {x for _, x in rows} == {"fr", "en"} and max(len(t) for t, _ in rows) == langid.MAX_TRAIN_CHARS
    profiles = langid.learn(docs)
    assert profiles.predict(long[0][1])[0] == "fr" and profiles.predict(short[0][1])[0] == "en"

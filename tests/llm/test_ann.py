import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pagewise.llm import ann
from pyspark.sql import functions as F


def brute(ids, vectors, k=20, every=20):
    """{query: [(vec_id, score)]}; vectors as lists."""
    rows = {}
    for i, v in zip(ids, vectors):
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            rows[i] = np.array(v, float)
    keys = np.array(sorted(rows))
    x = np.stack([rows[i] for i in keys])
    out = {}
    for i in keys[keys % every == 0]:
        s = (x * rows[i]).sum(1)
        order = [j for j in np.lexsort((keys, -s)) if keys[j] != i][:k]
        out[int(i)] = [(int(keys[j]), float(s[j])) for j in order]
    return out


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def table(name, sf="sf0.01"):
    t = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    return t["vec_id"].to_pylist(), t["embedding"].to_pylist()


def test_exact_where_one_leaf_holds_all(spark):
    got = collect(ann.digest(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")))
    want = brute(*table("embeddings"))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-14)


def test_recall_with_many_leaves_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = collect(ann.nearest(rows, F.col("vec_id") % 20 == 0, leaf_rows=128))
    want = brute(*table("embeddings", "sf0.1"))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_odd_vectors_and_copies(spark):
    r = np.random.default_rng(1)
    vecs = [[float(x) for x in r.standard_normal(4) * r.choice([0.1, 1, 5])] for _ in range(300)]
    hot = [1.0, 2.0, -1.0, 0.5]
    rows = [(i, hot if i % 3 == 0 else vecs[i % 300], "x") for i in range(600)]
    rows += [(1000, None, "x"), (1020, [], "x"), (1040, [0.0] * 4, "x"), (1060, [1.0, None, 0.0, 0.0], "x"), (1080, [float("nan"), 1.0, 1.0, 1.0], "x"), (1100, [float("inf"), 1.0, 1.0, 1.0], "x"), (1120, [1.0, 2.0], "x"), (None, hot, "x"), (3, hot, "x"), (3, hot, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(5)
    got = collect(ann.nearest(df, F.col("vec_id") % 20 == 0, leaf_rows=20))
    want = brute([i for i, v, _ in rows if i != 1120], [v for i, v, _ in rows if i != 1120])
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9 and all(len(v) == 20 for v in got.values())
    assert all(q not in [i for i, _ in v] for q, v in got.items())
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]]


def test_vectors_of_other_lengths_are_answered_among_their_own(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.standard_normal((4, 3, 7)[(i % 11 > 5) + (i % 11 > 8)])]) for i in range(400)] + [(1000, [1.0, 2.0])]
    got = collect(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 20 == 0, leaf_rows=40))
    hits = []
    for size in (4, 3, 7):
        own = [(i, v) for i, v in rows if len(v) == size]
        want = brute([i for i, _ in own], [v for _, v in own])
        assert {q for q in got if len(rows[q][1]) == size} == want.keys()
        for q in want:
            if size == 4:
                hits.append(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20)
            else:
                assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    assert np.mean(hits) >= 0.9 and 1000 not in got


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.digest(spark.createDataFrame([], schema)).count() == 0
    assert ann.digest(spark.createDataFrame([(0, [1.0, 0.0])], schema)).count() == 0
    got = collect(ann.digest(spark.createDataFrame([(0, [1.0, 0.0]), (5, [2.0, 1.0]), (20, [0.0, -1.0])], schema)))
    assert got == {0: [(5, 2.0), (20, 0.0)], 20: [(0, 0.0), (5, -1.0)]}


def test_queue_opens_every_leaf_once_and_home_first():
    x = np.random.default_rng(4).standard_normal((500, 8))
    f = ann.Forest.fit(x, 4, 3)
    home = f.leaves(x[:5])
    for i in range(5):
        order = f.search(f.sides(x[i : i + 1])[0], 48)
        assert sorted(order) == list(range(48)) and set(order[:3]) == set(home[:, i].tolist())
    assert all(np.bincount(row >> 0, minlength=16 * (t + 1))[16 * t :].min() >= 20 for t, row in enumerate(f.leaves(x)))


@pytest.mark.parametrize("k", [1, 5])
def test_best_of_with_ties(k):
    v = np.array([[1.0, 0], [1, 0], [0, 1], [1, 0], [2, 0]])
    q, c, s = ann.best_of(np.array([[1.0, 0.0]]), np.array([9]), v, np.array([7, 3, 1, 5, 9]), k)
    assert [int(i) for i in np.array([7, 3, 1, 5, 9])[c]] == [3, 5, 7, 1][:k] and not q.any() and s[0] == 1


def test_floors_lose_none_of_the_best():
    """Blocks with repeated vectors, handed over one by one: the best of all, as by one scan."""
    r = np.random.default_rng(6)
    queries, vectors = r.integers(-3, 4, (30, 3)).astype(float), r.integers(-3, 4, (900, 3)).astype(float)
    tables = []
    for n in range(20):
        at = r.permutation(900)[:300]
        role, x, h = np.repeat([0, 1], [300, 30]), np.vstack([vectors[at], queries]), np.concatenate([at, np.arange(30) + 5000])
        tables.append(pa.table({"leaf": np.full(330, n), "vb": np.zeros(330, int), "qb": np.zeros(330, int), "role": role, "h1": h, "h2": h, "id": h, "vec": ann._packed(x)}))
    seen = np.unique(np.concatenate([t["h1"].to_numpy()[:300] for t in tables]))
    for held, most in ((200, 10**6), (200, 100), (10**6, 10**6)):
        best = ann._BestOf(5, held, most)
        out = list(best.run(b for t in tables for b in t.to_batches(max_chunksize=170)))
        h1, _, c1, _, _, s = best.reduced([tuple(c.to_numpy() for c in b.columns) for b in out])
        for q in range(30):
            score = vectors[seen] @ queries[q]
            want = np.lexsort((seen, -score))[:5]
            assert c1[h1 == q + 5000].tolist() == seen[want].tolist() and s[h1 == q + 5000].tolist() == score[want].tolist()

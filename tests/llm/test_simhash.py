import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from pagewise.llm import simhash as s


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def shingles_of(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_components(fps):
    """The least fingerprint that links reach, for each."""
    fps = np.array(sorted(set(fps)), np.int64)
    root = {}
    for f in fps:
        if int(f) in root:
            continue
        root[int(f)], queue = int(f), [f]
        while queue:
            x = queue.pop()
            for y in fps[np.bitwise_count((fps ^ x).view(np.uint64)) <= 3]:
                if int(y) not in root:
                    root[int(y)] = int(f)
                    queue.append(y)
    return root


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = {r.text: brute_fp(r.text) for r in rows}
    signed = {t: f - (1 << 64) if f >> 63 else f for t, f in fps.items()}
    root = brute_components(signed.values())
    least = {}
    for r in rows:
        k = root[signed[r.text]]
        least[k] = min([x for x in (least.get(k), r.doc_id) if x is not None], default=None)
    want = Counter((r.doc_id, f"{fps[r.text]:016x}", least[root[signed[r.text]]]) for r in rows)
    assert Counter(tuple(r) for r in s.digest(docs).collect()) == want
    return want


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert s.digest(no_docs).count() == 0


def test_documents(spark):
    want = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sum(i != c for i, _, c in want) > 50


@pytest.mark.parametrize("full_cell", [4, 1024])
def test_links_span_the_components(spark, full_cell):
    rnd, fps = random.Random(3), set()
    for _ in range(300):
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 1, 2, 30])):
            fps.add(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))))
            if rnd.random() < 0.3:
                base ^= 1 << rnd.randrange(64)
    crowd = rnd.getrandbits(64)
    fps |= {crowd ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(6))) for _ in range(800)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(4)
    got = {r.node: r.root for r in s.components(s.link_fingerprints(df, full_cell)).collect()}
    want = brute_components(signed)
    assert {f: got.get(f, f) for f in signed} == want
    assert len(set(want.values())) < len(signed)


def test_every_pair_within_reach_shares_a_cell():
    rnd = random.Random(9)
    low = 0x5555555555555555
    counts = lambda f: (f & low) + (f >> 1 & low)
    for _ in range(2000):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << k for k in rnd.sample(range(64), 3))
        assert any(counts(a) & m == counts(b) & m for m in s.grid_masks(2, False))
        assert any(a & m == b & m for m in s.grid_masks(1, True))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(1000, 1400)] + [(1399, 7), (8, 8)]
    got = {r.node: r.root for r in s.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[1200] == got[7] == got[5] == 5


def test_one_document_of_each_group_stays(spark, odd_docs):
    got = s.keep_representatives(odd_docs)
    assert got.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert ids[1] == 1 and 5 not in ids and ids[11] == 2 and ids[None] == 1 and ids[2] == 1 and 3 not in ids and 4 not in ids


def near_copies(seed=7, n=130):
    """Groups of texts with some words replaced, texts that share a long passage, and copies."""
    rnd, rows = random.Random(seed), []
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 8)))
    passage = [word() for _ in range(60)]
    for _ in range(n):
        base = [word() for _ in range(rnd.randrange(30, 300))]
        for _ in range(rnd.choice([1, 1, 2, 5])):
            own = [word() if rnd.random() < rnd.choice([0, 0.004, 0.01, 0.02, 0.04]) else w for w in base]
            rows.append(" ".join(own))
    rows += [" ".join([*passage, *(word() for _ in range(rnd.randrange(5, 90)))]) for _ in range(80)]
    rows += rows[:5] + ["", " ", "one two", "one  TWO", "one two three"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("full_cell", "block"), [(1024, 4096), (3, 4)])
def test_similar_texts_by_brute_force(spark, full_cell, block):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    nodes, dropped = s.similar_groups(docs, full_cell=full_cell, block=block)
    gone = {r.id for r in dropped.collect()}
    kept = {r.id for r in nodes.collect()} - gone
    sets, group = [(i, shingles_of(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    linked = 0
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if len(a & b) >= 0.8 * len(a | b):
                linked += 1
                if (x := find(i)) != (y := find(j)):
                    group[max(x, y)] = min(x, y)
    want = {i for i in group if find(i) == i}
    assert want <= kept and linked > 100
    # A pair at 0.8 shares no anchor with a chance of 0.0016; divided cells lose as many again.
    assert len(kept - want) <= 1


@pytest.mark.parametrize(("full_cell", "block"), [(1024, 4096), (3, 4)])
def test_no_link_of_similar_texts_is_lost(spark, full_cell, block):
    """Pairs at exactly 0.8, some of which share no anchor or differ in more bits than a sketch allows, and in cells fuller than full_cell."""
    rnd, rows = random.Random(31), []
    words = lambda n: [f"{rnd.getrandbits(32):x}" for _ in range(n)]
    passage = words(12)
    for k in range(300):
        base = words(12) if k % 2 else passage[:8] + words(4) if k % 4 else passage + words(20)
        base = base if k % 4 else base + words(4)
        n = len(base) - 4
        # A word more at the end of both: of n + 2 shingles, n are shared where n is 8; longer ones lose n / 8 each.
        rows += [" ".join([*base, *words(n // 8)]), " ".join([*base, *words(n // 8)])]
    rows += ["", " \n", "\t"]
    pairs = [(a, b) for a, b in zip(rows[:600:2], rows[1:600:2])]
    assert all(5 * len(shingles_of(a) & shingles_of(b)) == 4 * len(shingles_of(a) | shingles_of(b)) for a, b in pairs)
    nodes, dropped = s.similar_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3), full_cell=full_cell, block=block)
    assert {r.id for r in dropped.collect()} == {*range(1, 600, 2), 601, 602}
    assert {r.id for r in nodes.collect()} == set(range(603))


@pytest.mark.parametrize("seeds", [[254, 390, 439, 453, 564, 819, 3806, 5662]])
def test_pairs_that_anchors_or_fingerprints_lost(spark, seeds):
    rows = []
    for k in seeds:
        r = random.Random(k)
        w = [f"{r.getrandbits(32):x}" for _ in range(14)]
        rows += [" ".join([*w[:12], x]) for x in w[12:]]
    _, dropped = s.similar_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {r.id for r in dropped.collect()} == set(range(1, len(rows), 2))


def test_prefixes_and_counts_bound_every_similar_pair():
    r = np.random.default_rng(5)
    late = np.sort(r.integers(0, 1 << 63, 40).astype(np.uint64))
    ranks = r.permutation(40)
    for _ in range(400):
        n, m = int(r.integers(1, 120)), 0
        both = np.concatenate([r.integers(0, 1 << 63, n).astype(np.uint64), r.choice(late, int(r.integers(0, 41)), replace=False)])
        alone = len(both) // 4
        m = int(r.integers(0, alone + 1))
        more = r.integers(0, 1 << 63, alone).astype(np.uint64)
        a, b = np.unique(np.concatenate([both, more[:m]])), np.unique(np.concatenate([both, more[m:]]))
        assert np.intersect1d(s.prefix(a, late, ranks), s.prefix(b, late, ranks)).size
        sizes = np.array([len(a), len(b)])
        counts = s.counts_by_part(np.concatenate([a, b]), sizes)
        assert s._near(counts[:1], sizes[:1], counts[1], sizes[1], 0.8).all() and counts.sum() == sizes.sum()


def test_manhattan_distance_bounds_the_bits():
    r = np.random.default_rng(2)
    fps = r.integers(-(1 << 63), 1 << 63, 3000)
    points = s.embed(fps)
    assert points.shape == (3000, 8) and all(int(p.sum()) == int(f & (2**64 - 1)).bit_count() for p, f in zip(points[:50], fps[:50].tolist()))
    for k in range(20):
        bits = np.array([((int(f) ^ int(fps[k])) & (2**64 - 1)).bit_count() for f in fps])
        assert (np.abs(points - points[k]).sum(1) <= bits).all()
        assert np.array_equal(s.within(points, fps, points[k], fps[k], 25), np.flatnonzero(bits <= 25))


def test_links_over_the_highest_bit(spark):
    """Fingerprints are signed longs: a difference in the highest bit and another must still be two bits."""
    rnd = random.Random(21)
    pairs = [(a, a ^ 1 << 63 ^ sum(1 << b for b in rnd.sample(range(63), rnd.randrange(3)))) for a in (rnd.getrandbits(64) for _ in range(40))]
    signed = [f - (1 << 64) if f >> 63 else f for pair in pairs for f in pair]
    got = {r.node: r.root for r in s.components(s.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    assert all(got[a] == got[b] == min(a, b) for a, b in zip(signed[::2], signed[1::2]))


def test_every_pair_shares_a_cell_of_the_third_grid():
    rnd = random.Random(10)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << k for k in rnd.sample(range(64), 3))
        for mask in s.grid_masks(1, True):
            if a & mask == b & mask:
                assert any(a & m == b & m for m in s.free_masks(mask))
    assert all(bin(mask).count("1") + bin(m).count("1") >= 46 for mask in s.grid_masks(1, True) for m in s.free_masks(mask))


def test_long_text_in_parts():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(n)) for n in (70000, 3, 9000, 0, 2, 8192, 1)]
    raw = [t.encode() for t in texts]
    got = s.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert [int(g) for g in got] == [brute_fp(t) for t in texts]


def test_speed_of_the_reader_is_not_bought_by_prefixes():
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])
    long = max(table["text"].to_pylist(), key=len)
    raw = np.frombuffer(long.encode(), np.uint8)
    assert int(s.fingerprints(raw, np.array([0, len(raw)]))[0]) == brute_fp(long)

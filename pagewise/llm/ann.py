"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all of them, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

TREES = 4
#: Distinct vectors of a leaf, about; and levels of a tree at most, beyond which leaves grow and are dealt out in blocks.
LEAF_ROWS, MAX_LEVELS = 512, 12
#: Vectors that the hyperplanes are fitted on at most, and numbers in them.
SAMPLE_ROWS, SAMPLE_NUMBERS = 20_000, 4_000_000
#: Query vectors whose exact neighbours settle how many leaves a search opens, and the recall that it aims at.
CALIBRATION, TARGET_RECALL = 100, 0.95
#: Rows of a block of vectors or queries: a task holds one of each.
BLOCK_ROWS = 2048
#: Numbers that a vectorised step holds in one array, about.
STEP_NUMBERS = 1 << 22


@dataclass
class Forest:
    """normals[t][d]: (2**d, dimension); cuts[t][d]: (2**d,). A vector goes right where its projection is above the cut."""

    normals: list[list[np.ndarray]]
    cuts: list[list[np.ndarray]]
    levels: int

    @classmethod
    def fit(cls, sample: np.ndarray, levels: int, trees: int, seed: int = 17) -> Forest:
        r = np.random.default_rng(seed)
        normals, cuts = [], []
        for _ in range(trees if levels else 1):
            own_n, own_c, at = [], [], np.zeros(len(sample), np.int64)
            for d in range(levels):
                w = r.standard_normal((1 << d, sample.shape[1]))
                w /= np.linalg.norm(w, axis=1, keepdims=True)
                p = np.einsum("nd,nd->n", sample, w[at])
                order = np.lexsort((p, at))
                edge = np.searchsorted(at[order], np.arange((1 << d) + 1))
                c = np.zeros(1 << d)
                full = edge[1:] > edge[:-1]
                c[full] = p[order][((edge[1:] + edge[:-1] - 1) // 2)[full]]
                at = at * 2 + (p > c[at])
                own_n.append(w)
                own_c.append(c)
            normals.append(own_n)
            cuts.append(own_c)
        return cls(normals, cuts, levels)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered through: (trees, n)."""
        out = []
        for t, (normals, cuts) in enumerate(zip(self.normals, self.cuts)):
            at = np.zeros(len(vectors), np.int64)
            for w, c in zip(normals, cuts):
                at = at * 2 + (np.einsum("nd,nd->n", vectors, w[at]) > c[at])
            out.append((t << self.levels) + at)
        return np.array(out)

    def sides(self, vectors: np.ndarray) -> np.ndarray:
        """How far each vector lies beyond each cut: (n, trees, 2**levels). Node `at` of level d has place 2**d + at; place 0 is empty."""
        out = np.zeros((len(vectors), len(self.normals), 1 << self.levels))
        for t, (normals, cuts) in enumerate(zip(self.normals, self.cuts)):
            for d, (w, c) in enumerate(zip(normals, cuts)):
                out[:, t, 1 << d : 2 << d] = vectors @ w.T - c
        return out

    def search(self, sides: np.ndarray, n_leaves: int) -> list[int]:
        """The first n_leaves leaves in the order of one queue that all trees share, for a vector's row of sides().

        A node's priority is the sum of squared distances to the cuts that its path crosses to the far
        side; the root of each tree has none.
        """
        rows, leaf = sides.tolist(), 1 << self.levels
        heap = [(0.0, 1, t) for t in range(len(rows))]
        out: list[int] = []
        while heap and len(out) < n_leaves:
            far, node, t = heapq.heappop(heap)
            row = rows[t]
            while node < leaf:
                side = row[node]
                near = 2 * node + (side > 0)
                heapq.heappush(heap, (far + side * side, near ^ 1, t))
                node = near
            out.append(t * leaf + node - leaf)
        return out

    def searches(self, vectors: np.ndarray, n_leaves: int) -> Iterator[list[int]]:
        """search() of each vector, with bounded room for their sides."""
        step = max(1, STEP_NUMBERS // (len(self.normals) << self.levels))
        for a in range(0, len(vectors), step):
            for sides in self.sides(vectors[a : a + step]):
                yield self.search(sides, n_leaves)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _packed(vectors: np.ndarray) -> pa.Array:
    """Rows as their bytes: Spark moves these at once, and the numbers of an array one by one."""
    width = vectors.shape[1] * 8
    offsets = np.arange(len(vectors) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(vectors))]).cast(pa.binary())


def _unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _augmented(vectors: np.ndarray, top: float) -> np.ndarray:
    """One more number, so that all have the length of the longest: then the largest inner product is the nearest."""
    return np.hstack([vectors, np.sqrt(np.maximum(0.0, top - np.einsum("nd,nd->n", vectors, vectors)))[:, None]])


def best_of(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the k largest inner products of each query over vectors with other ids, ties to the smaller id.

    Where floor is given, scores below each query's floor may be left out. A matrix product selects, with room for its rounding; then each score is computed alone, so that
    the same pair has the same score wherever it is met.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, STEP_NUMBERS // max(1, vectors.size))
    for a in range(0, len(queries), step):
        rough = queries[a : a + step] @ vectors.T
        least = np.full((len(rough), 1), -np.inf) if floor is None else floor[a : a + step, None]
        if rough.shape[1] > k + 1:
            more = np.flatnonzero((rough >= least).sum(1) > k + 1)
            least[more] = np.partition(rough[more], rough.shape[1] - k - 1, axis=1)[:, [rough.shape[1] - k - 1]]
        q, c = np.nonzero(rough >= least - 1e-9 * np.maximum(1.0, np.abs(least)))
        q = q + a
        others = ids[c] != own[q]
        q, c = q[others], c[others]
        score = (vectors[c] * queries[q]).sum(1)
        order = np.lexsort((ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((q[best], c[best], score[best]))
    q, c, score = (np.concatenate(x) for x in zip(*out))
    return q, c, score


@dataclass
class _BestOf:
    """Scores the blocks of a partition as they stream by, sorted by block and role, and keeps the best k of each query over all of them."""

    k: int
    #: Rows that are kept at least before only the best of them go on, and rows beyond which those are handed out.
    held: int = 20_000
    most: int = 1_000_000

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        rest: pa.Table | None = None
        size, least = 0, 0
        floors: dict[tuple[int, int], float] = {}
        for batch in batches:
            part = pa.Table.from_batches([batch])
            rest = part if rest is None else pa.concat_tables([rest, part])
            block = np.stack([rest[c].to_numpy() for c in ("leaf", "vb", "qb")])
            cuts = np.concatenate([[0], np.flatnonzero((block[:, 1:] != block[:, :-1]).any(0)) + 1]) if len(rest) else np.zeros(1, int)
            for a, b in zip(cuts[:-1], cuts[1:]):
                kept.append(self.block(rest.slice(a, b - a), floors))
                size += len(kept[-1][0])
            rest = rest.slice(cuts[-1]).combine_chunks()
            if size > max(self.held, 2 * least):
                kept = [self.reduced(kept)]
                size = least = len(kept[0][0])
                floors = self.floors(kept[0])
                if size > self.most:
                    yield self.rows(kept[0])
                    kept, size, least, floors = [], 0, 0, {}
        if rest is not None and len(rest):
            kept.append(self.block(rest, floors))
        if kept:
            yield self.rows(self.reduced(kept))

    def block(self, group: pa.Table, floors: dict[tuple[int, int], float]) -> tuple[np.ndarray, ...]:
        """h1, h2, c1, c2, id, score of the best pairs of a block's queries and vectors, but for pairs below their query's floor. A query's own vector is a candidate here: its copies have other ids."""
        role = group["role"].to_numpy()
        n = int((role == 0).sum())
        b, a = group.slice(0, n), group.slice(n)
        if not len(a) or not len(b):
            return tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0),)
        ids = b["id"].to_numpy()
        floor = np.array([floors.get(key, -np.inf) for key in zip(a["h1"].to_pylist(), a["h2"].to_pylist())])
        q, c, s = best_of(_unpacked(a["vec"]), np.full(len(a), np.iinfo(np.int64).min), _unpacked(b["vec"]), ids, self.k, floor)
        pick = lambda t, name, at: t[name].to_numpy()[at]
        return pick(a, "h1", q), pick(a, "h2", q), pick(b, "h1", c), pick(b, "h2", c), ids[c], s

    def reduced(self, parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """The best k different candidates of each query."""
        h1, h2, c1, c2, ids, s = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((c2, c1, ids, -s, h2, h1))
        h1, h2, c1, c2, ids, s = (x[order] for x in (h1, h2, c1, c2, ids, s))
        if len(h1):  # the same pair from several trees has the same score, so it stands together
            again = np.concatenate([[False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & (c1[1:] == c1[:-1]) & (c2[1:] == c2[:-1])])
            h1, h2, c1, c2, ids, s = (x[~again] for x in (h1, h2, c1, c2, ids, s))
            first = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            place = np.arange(len(h1)) - np.maximum.accumulate(np.where(first, np.arange(len(h1)), 0))
            h1, h2, c1, c2, ids, s = (x[place < self.k] for x in (h1, h2, c1, c2, ids, s))
        return h1, h2, c1, c2, ids, s

    def floors(self, best: tuple[np.ndarray, ...]) -> dict[tuple[int, int], float]:
        """The score of the k-th of each query that has so many, in rows as reduced() gives them: a pair below it is not among the best."""
        h1, h2, s = best[0], best[1], best[5]
        last = np.arange(self.k - 1, len(s))
        last = last[(h1[last] == h1[last - self.k + 1]) & (h2[last] == h2[last - self.k + 1])]
        return dict(zip(zip(h1[last].tolist(), h2[last].tolist()), s[last].tolist()))

    @staticmethod
    def rows(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h1", "h2", "c1", "c2", "id", "score"])


def distinct_vectors(rows: DataFrame, vec_id: str, vector: str, is_query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, members). nodes: h1, h2, vec, asked, ids: one row for each distinct vector, its k + 1 smallest ids
    and whether a query has it; members: h1, h2, vec_id of the queries.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id
    take no part. No list grows with a vector's copies: more ids
    than k + 1 of one vector can't be among k neighbours.
    """
    vec = F.col(vector).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec"), is_query.alias("asks"))
    good = good.where((F.size("vec") > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists("vec", lambda x: x != 0))
    keyed = good.select("vec_id", "asks", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit("second"), "vec").alias("h2"))
    members = keyed.groupBy("h1", "h2", "vec_id").agg(F.max("asks").alias("asks"))
    w = Window.partitionBy("h1", "h2").orderBy("vec_id")
    ids = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    vectors = keyed.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.max("asks").alias("asked"))
    return cut(vectors.join(ids, ["h1", "h2"])), members.where("asks").select("h1", "h2", "vec_id")


def _calibrate(nodes: DataFrame, forest: Forest, top: float, k: int) -> int:
    """Leaves that a search must open for TARGET_RECALL, from the exact neighbours of CALIBRATION query vectors over all nodes."""
    asked = nodes.where("asked").orderBy("h2", "h1").limit(CALIBRATION).select("ids", "vec").toArrow()
    if not len(asked) or not forest.levels:
        return 1
    queries = _matrix(asked["vec"])
    own = np.array([x[0] for x in asked["ids"].to_pylist()], np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(0))
            if len(vectors):
                ids = batch.column(1).to_numpy(zero_copy_only=False)
                q, c, s = best_of(queries, own, vectors, ids, k)
                leaves = forest.leaves(_augmented(vectors, top)).T[c]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(s), pa.array(ids[c]), pa.array(leaves.tolist(), pa.list_(pa.int64()))], names=["q", "s", "id", "leaves"])

    found = nodes.select("vec", F.col("ids")[0].alias("id")).mapInArrow(scan, "q long, s double, id long, leaves array<long>")
    w = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    rows = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "leaves").collect()
    total = len(forest.normals) << forest.levels
    order = [{leaf: n for n, leaf in enumerate(x)} for x in forest.searches(np.pad(queries, ((0, 0), (0, 1))), total)]
    need = sorted(min(order[r.q][leaf] for leaf in r.leaves) for r in rows)
    return need[min(len(need) - 1, int(np.ceil(TARGET_RECALL * len(need))) - 1)] + 1 if need else 1


def nearest(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds, the k nearest other rows found, by inner product.

    Nearest first, ties to the smaller vec_id; scores are in double precision on the vectors as they
    are. All candidates where they are fewer. Rows that repeat an id and vector count once; an id with
    several vectors is asked once for each. An empty table gives no rows.

    Copies of a vector are one node of the index. The trees' hyperplanes are fitted on a sample of
    SAMPLE_ROWS nodes; every node is put in one leaf of each tree. A search opens leaves in the order
    of one priority queue over all trees; how many is settled by the exact neighbours of CALIBRATION
    queries, so that recall holds at any size and for any data. Leaves are dealt out with their
    queries, in blocks of bounded size, and scored by matrix products; only the best k of a query and
    task move on. The trees are of the most common length; each other length is one leaf, numbered
    below 0, that holds all its vectors and that all its queries open: there the search is exact.
    """
    nodes, members = distinct_vectors(rows, vec_id, vector, is_query, k)
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    common = nodes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("top")).orderBy(F.desc("n"), "dim").limit(1).collect()
    out_type = "query_id long, rank int, vec_id long, score double"
    if not common:
        return rows.sparkSession.createDataFrame([], out_type)
    dim, n, top = common[0]
    treed = nodes.where(F.size("vec") == dim)
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(n / leaf_rows)))))
    bound = min(SAMPLE_ROWS, max(1, SAMPLE_NUMBERS // dim))
    sample = _matrix(treed.orderBy("h1", "h2").limit(bound).select("vec").toArrow()["vec"]) if levels else np.zeros((1, dim))
    forest = Forest.fit(_augmented(sample, top), levels, trees)
    n_leaves = _calibrate(treed, forest, top, k)

    def places(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Vectors of one length, and row, leaf and role of their places: each node once for each tree; an asked one once more for each leaf that its search opens."""
        sizes = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False)
        asked = batch.column(4).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            vectors, asks = _matrix(batch.column(3).take(pa.array(at))), np.flatnonzero(asked[at])
            if size == dim:
                leaves = forest.leaves(_augmented(vectors, top))
                opened = list(forest.searches(np.pad(vectors[asks], ((0, 0), (0, 1))), n_leaves))
            else:
                leaves, opened = np.full((1, len(at)), -int(size)), [[-int(size)]] * len(asks)
            counts = [len(x) for x in opened]
            row = np.concatenate([np.tile(np.arange(len(at)), len(leaves)), np.repeat(asks, counts)])
            leaf = np.concatenate([leaves.reshape(-1), *(np.array(x, np.int64) for x in opened)])
            yield vectors, at[row], leaf, np.repeat([0, 1], [leaves.size, sum(counts)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vectors, row, leaf, role in places(batch):
                at = np.searchsorted(np.unique(row), row)
                for a in range(0, len(row), 4096):
                    z = slice(a, a + 4096)
                    part = batch.select([0, 1, 2]).take(pa.array(row[z]))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[z]), pa.array(role[z]), *part.columns, _packed(vectors[at[z]])], names=["leaf", "role", "h1", "h2", "id", "vec"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, leaf, role in places(batch):
                keys, n = np.unique(np.stack([leaf, role]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(n)], names=["leaf", "role", "n"])

    base = nodes.select("h1", "h2", F.col("ids")[0].alias("id"), "vec", "asked")
    placed = base.mapInArrow(place, "leaf long, role long, h1 long, h2 long, id long, vec binary")
    # Rows of each leaf and role: a bounded table, as levels, trees and lengths are.
    filled = {(r.leaf, r.role): r.n for r in base.mapInArrow(tally, "leaf long, role long, n long").groupBy("leaf", "role").agg(F.sum("n").alias("n")).collect()}
    blocks = {key: -(-c // BLOCK_ROWS) for key, c in filled.items()}
    most = [max([b for (_, role), b in blocks.items() if role == r], default=1) for r in (0, 1)]
    table = rows.sparkSession.createDataFrame([(leaf, blocks.get((leaf, 0), 1), blocks.get((leaf, 1), 0)) for leaf, role in sorted(filled) if role == 0 and (leaf, 1) in filled], "leaf long, v_blocks int, q_blocks int")
    dealt = placed.join(F.broadcast(table), "leaf")
    if most == [1, 1]:
        dealt = dealt.withColumn("vb", F.lit(0)).withColumn("qb", F.lit(0))
    else:  # a block of vectors goes to every block of queries of its leaf, and the other way round
        ours = lambda role, blocks_: F.when(F.col("role") == role, F.array(F.pmod(F.xxhash64("h1", "h2"), F.col(blocks_)).cast("int"))).otherwise(F.sequence(F.lit(0), F.col(blocks_) - 1))
        dealt = dealt.withColumn("vb", F.explode(ours(0, "v_blocks"))).withColumn("qb", F.explode(ours(1, "q_blocks")))

    best = _BestOf(k + 1)
    found = (
        dealt.select("leaf", "vb", "qb", "role", "h1", "h2", "id", "vec")
        .repartition("leaf", "vb", "qb")
        .sortWithinPartitions("leaf", "vb", "qb", "role")
        .mapInArrow(best.run, "h1 long, h2 long, c1 long, c2 long, id long, score double")
    )
    w = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    rank = F.row_number().over(w)
    # A pair is met once in each tree at most, so this many rows hold the best k + 1 pairs; the rest go before the exchange.
    found = found.withColumn("r", rank).where(F.col("r") <= (k + 1) * len(forest.normals)).drop("r").distinct()
    found = found.withColumn("r", rank).where(F.col("r") <= k + 1).drop("r", "id")
    copies = nodes.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "ids")
    each = found.join(copies, ["c1", "c2"]).select("h1", "h2", "score", F.explode("ids").alias("id"))
    listed = each.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("best"))
    answers = members.join(listed, ["h1", "h2"])
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("vec_id")), 1, k)
    return answers.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "b")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))


def digest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by `every`."""
    return nearest(embeddings.select("vec_id", "embedding"), F.col("vec_id") % every == 0, k)

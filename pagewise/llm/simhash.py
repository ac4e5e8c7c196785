"""SimHash near-dedup: fingerprints linked by a grid join over segment popcounts, verified exactly, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import LOWER, byte_class, find_words, mix
from .common import cut, spare_name, text_steps

SHINGLE = 3
#: Fingerprints link at so many differing bits or fewer.
MAX_BITS = 3
#: Bands of segments; MAX_BITS of them can differ, the others are a cell of the grid.
BANDS = 6
#: Fingerprints that share a cell; fuller cells are divided by another grid first.
FULL_CELL = 1024
SEED = 42
#: Word bytes: all but white space.
WORD = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text as uint64; a text without words has zero."""
    found = find_words(data, offsets, WORD)
    n_words, out = np.diff(found.ptr), np.zeros(len(offsets) - 1, np.uint64)
    if not len(found.starts):
        return out
    # Words one after another with a space behind each: a shingle is then one slice.
    sizes = found.ends - found.starts + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mask = np.ones(ends[-1], bool)
    mask[ends - 1] = False
    joined = np.full(ends[-1], 0x20, np.uint8)
    joined[mask] = found.low[WORD[found.low]]
    blob = joined.tobytes()
    counts = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    first = np.repeat(found.ptr[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    last = first + np.repeat(np.minimum(n_words, shingle), counts) - 1
    digest = xxhash.xxh64_intdigest
    h = np.empty(len(first), np.uint64)
    for part in range(0, len(first), 65536):
        own = slice(part, part + 65536)
        h[own] = [digest(blob[a:b], SEED) for a, b in zip(starts[first[own]].tolist(), (ends[last[own]] - 1).tolist())]
    at = np.cumsum(counts) - counts
    # The bits of at most a few thousand shingles are unpacked at a time.
    full = np.flatnonzero(counts)
    k = 0
    while k < len(full):
        e = max(k + 1, int(np.searchsorted(at[full] + counts[full], at[full[k]] + 8192, "right")))
        group = full[k:e]
        lo, hi = at[group[0]], at[group[-1]] + counts[group[-1]]
        sums = np.zeros((len(group), 64), np.int64)
        for part in range(lo, hi, 65536):
            stop = min(hi, part + 65536)
            bits = np.unpackbits(h[part:stop].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            if len(group) == 1:
                sums[0] += bits.sum(0, dtype=np.int64)
            else:
                sums = np.add.reduceat(bits, at[group] - lo, axis=0, dtype=np.int32)
        over = 2 * sums > counts[group][:, None]
        out[group] = np.packbits(over, axis=1, bitorder="little").view("<u8")[:, 0]
        k = e
    return out


def add_fingerprints(docs: DataFrame, text: str = "text", fingerprint: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """Every row of docs with its 64 bits as a long; the whole text counts, null as an empty one."""
    docs = docs.drop(fingerprint)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprints(data, offsets, shingle) for _, _, data, offsets in text_steps(batch.column(names.index(text)))]
            column = np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column)], names=[*names, fingerprint])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(fingerprint, T.LongType())]))


# The grid. A fingerprint is embedded as the popcounts of its segments; the Manhattan distance of two
# embeddings is at most their Hamming distance. Segments are dealt to BANDS bands. Where the Manhattan
# distance is at most MAX_BITS, no more than MAX_BITS bands differ, so the others agree: a cell of the grid
# is the popcounts of BANDS - MAX_BITS bands, and two linked fingerprints share one of its cells.


def _popcounts(fp: Column, width: int) -> Column:
    """A long of the popcounts of all segments of `width` bits, each in its own place (width is 1 or 2)."""
    if width == 1:
        return fp
    low = F.lit(0x5555555555555555)
    one, two = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    # A pair of bits 00, 01, 10, 11 becomes 00, 01, 01, 10: a sum without carries into other pairs.
    return one.bitwiseXOR(two).bitwiseOR(F.shiftleft(one.bitwiseAND(two), 1))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def grid_masks(width: int, dealt: bool) -> list[int]:
    """The bits that each cell table looks at. dealt: segment k goes to band k % BANDS, else bands are runs."""
    segments = 64 // width
    bands = [0] * BANDS
    for k in range(segments):
        bands[k % BANDS if dealt else k * BANDS // segments] |= ((1 << width) - 1) << (k * width)
    return [sum(bands[b] for b in kept) for kept in combinations(range(BANDS), BANDS - MAX_BITS)]


def free_masks(mask: int) -> list[int]:
    """The cell tables of the bits that mask leaves free: those in BANDS bands, all but MAX_BITS of them kept."""
    free = [b for b in range(64) if not mask >> b & 1]
    bands = [sum(1 << b for b in free[k::BANDS]) for k in range(BANDS)]
    return [sum(bands[b] for b in kept) for kept in combinations(range(BANDS), BANDS - MAX_BITS)]


def _cells(fps: DataFrame, width: int, dealt: bool, carried: list[str]) -> DataFrame:
    """fps once for each cell table: grid, cell, fp and the carried columns."""
    masks = F.array(*(F.lit(_signed(m)) for m in grid_masks(width, dealt)))
    tables = fps.select(*carried, "fp", _popcounts(F.col("fp"), width).alias("counts"), F.posexplode(masks).alias("grid", "mask"))
    return tables.select(*carried, "grid", F.col("counts").bitwiseAND(F.col("mask")).alias("cell"), "fp")


#: Bits of a segment in the embedding that a cell is searched by.
SEGMENT = 8


def embed(fps: np.ndarray) -> np.ndarray:
    """Fingerprints as points: the popcount of each segment of SEGMENT bits, (n, 64 / SEGMENT)."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint8)).reshape(len(fps), -1).astype(np.int8)


def differing(a, b) -> np.ndarray:
    """Bits that differ. Unsigned: of a negative number, numpy counts the bits of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def within(points: np.ndarray, fps: np.ndarray, point: np.ndarray, fp, most: int) -> np.ndarray:
    """Places of the fingerprints at `most` bits or fewer from fp. The Manhattan distance of the points is a lower bound, so it decides which are held against it bit by bit."""
    at = np.flatnonzero(np.abs(points - point).sum(1) <= most)
    return at[differing(fps[at], fp) <= most]


def link_block(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (root, other) that span each component of distinct fingerprints at MAX_BITS or fewer.

    A search from each fingerprint over those not yet reached: never all pairs, and a crowded cell
    shrinks with each step.
    """
    rest, points, out = fps, embed(fps), []
    while len(rest) > 1:
        root, queue, rest, points = rest[0], [(rest[0], points[0])], rest[1:], points[1:]
        while queue and len(rest):
            fp, point = queue.pop()
            near = within(points, rest, point, fp, MAX_BITS)
            if len(near):
                out += [(int(root), int(x)) for x in rest[near]]
                queue += list(zip(rest[near], points[near]))
                stay = np.ones(len(rest), bool)
                stay[near] = False
                rest, points = rest[stay], points[stay]
    return out


def _link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their cell columns and then fp (the last): links within each cell."""
    held: list[np.ndarray] | None = None

    def links(columns: list[np.ndarray], final: bool):
        *keys, fps = columns
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        cuts = np.concatenate([[0], change, [len(fps)]])
        upto = len(cuts) - 1 if final else len(cuts) - 2
        out: set[tuple[int, int]] = set()
        sizes = np.diff(cuts)
        # Cells of two, by far the most, at once.
        twos = cuts[:upto][sizes[:upto] == 2]
        points = embed(fps) if len(twos) else np.zeros((0, 1), np.int8)
        twos = twos[np.abs(points[twos] - points[twos + 1]).sum(1) <= MAX_BITS] if len(twos) else twos
        near = twos[differing(fps[twos], fps[twos + 1]) <= MAX_BITS]
        out.update(zip(fps[near].tolist(), fps[near + 1].tolist()))
        for k in np.flatnonzero(sizes[:upto] > 2):
            out.update(link_block(fps[cuts[k] : cuts[k + 1]]))
        return out, [c[cuts[upto] :] for c in columns]

    def batch_of(found: set[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns = [np.concatenate(x) for x in zip(held, columns)] if held is not None else columns
        if len(columns[-1]):
            found, held = links(columns, False)
            yield batch_of(found)
    if held is not None and len(held[-1]):
        yield batch_of(links(held, True)[0])


def link_fingerprints(fps: DataFrame, full_cell: int = FULL_CELL) -> DataFrame:
    """Links (a, b), a set that spans every component, from a column fp of distinct fingerprints.

    Cells of pairs of bits are counted first, with partial sums. Those of full_cell fingerprints or
    fewer are dealt out and searched; the fingerprints of fuller ones go on to a second grid, of
    single bits in bands that cross the first ones, inside their cell, and from its full cells to a
    third, of the bits that the second leaves free. At most 18 bits are free in a cell of the third grid,
    so it has no more than 2**18 fingerprints, 2 MB, however large the table is.
    """
    first = cut(_cells(fps, 2, False, []))
    keys = ["grid", "cell"]
    roomy, full = _parted(first, keys, full_cell)
    found = [_search(roomy, keys)]
    if full is not None:
        second = cut(_cells(full.withColumnsRenamed({"grid": "grid0", "cell": "cell0"}), 1, True, ["grid0", "cell0"]))
        keys = ["grid0", "cell0", "grid", "cell"]
        roomy, full = _parted(second, keys, full_cell)
        found.append(_search(roomy, keys))
    if full is not None:
        masks = F.array(*(F.array(*(F.lit(_signed(m)) for m in free_masks(mask))) for mask in grid_masks(1, True)))
        inside = full.withColumnsRenamed({"grid": "grid1", "cell": "cell1"}).select("grid0", "cell0", "grid1", "cell1", "fp", F.posexplode(F.element_at(masks, F.col("grid1") + 1)).alias("grid", "mask"))
        keys = ["grid0", "cell0", "grid1", "cell1", "grid", "cell"]
        found.append(_search(inside.withColumn("cell", F.col("fp").bitwiseAND(F.col("mask"))), keys))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _parted(cells: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of cells of `most` rows or fewer, and those of fuller ones (None without any)."""
    full = cut(cells.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys))
    if not full.take(1):
        return cells, None
    return cells.join(full, keys, "left_anti"), cells.join(full, keys)


def _search(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(_link_sorted, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of the links (a, b).

    Large-star and small-star steps alternate until a round changes nothing; every round is written to
    the checkpoint folder. Minima are partial aggregates, and a node with very many links is a skewed
    join that Spark splits.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("m", "x").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).collect()[0]
        if tuple(state) == before:
            break
        before = tuple(state)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", component: str = "component_id", fingerprint: str = "fingerprint") -> DataFrame:
    """doc_id, fingerprint (long) and component, the smallest doc_id that links reach, for every row of docs.

    Words are runs of characters other than white space, A-Z in lower case; shingles of three, repeats
    included, and the whole sequence where there are fewer words; a text without words, or null, has
    fingerprint zero and links like any other. Equal fingerprints are one node, so copies are never
    paired. A null doc_id is no candidate for the smallest; a component of null ids alone has null.
    """
    fps = cut(add_fingerprints(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")), "body", "fp").drop("body"))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(link_fingerprints(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias(component))
    of_fp = rooted.join(of_root, "root").select("fp", component)
    return fps.join(of_fp, "fp").select(F.col("id").alias(doc_id), F.col("fp").alias(fingerprint), component)


# Near duplicates by the similarity of their shingle sets. At 0.8, fingerprints of 64 bits differ in 20 and more: no grid of
# bits is both complete and selective there. So the cells are those of prefixes: in one order of all shingles, two sets of which
# one has n elements and that share `least` of their union or more share one of the first n - least * n + 1 elements of each. In a
# cell the sizes, and the elements that each set has in PARTS parts of the hashes, rule out; what stays is verified on the sets.
# Every bound holds for every pair, so no link is lost, in cells of any size.

#: Words of a shingle, and the least Jaccard similarity of near duplicates.
WORDS, LEAST = 5, 0.8
#: Parts of the hashes in which the elements of a set are counted: a power of two, so that they have 8 elements on average or fewer, from the least number to the most. Unrelated sets are told apart up to some 25 a part.
PARTS, MOST_PARTS = 64, 4096
#: Shingles that the order puts last, most frequent at the end, lest their cells are full: those of so many texts or more in a sample of about so many. They decide the size of cells, never what is found.
POPULAR, SEEN, SAMPLE = 65_536, 4, 8192
#: Characters of a text up to which it may be in that sample.
SAMPLE_TEXT = 16_384
#: Texts of a group that one task holds the shingles of, at most twice as many; larger groups are dealt out as pairs of blocks.
GROUP_BLOCK = 4096
#: Rows of three longs up to which the members of candidate groups are broadcast, and their texts not shuffled to meet them.
BROADCAST_ROWS = 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text of fewer words, but not none, has one."""
    found = find_words(data, offsets, WORD)
    words, out = found.hashes(), []
    step = np.uint64(0xD6E8FEB86659FD93)
    for a, b in zip(found.ptr[:-1].tolist(), found.ptr[1:].tolist()):
        m = min(shingle, b - a)
        h = np.zeros(max(0, b - a - m + 1) if m else 0, np.uint64)
        for j in range(m):
            h = h * step + words[a + j : a + j + len(h)]
        out.append(np.unique(mix(h)))
    return out


def prefix(own: np.ndarray, popular: np.ndarray, ranks: np.ndarray, least: float = LEAST) -> np.ndarray:
    """The elements of a sorted set of which every set that is similar at `least` has one in its own prefix; a set without elements has the cell 0. popular: sorted; ranks: their order, behind all others."""
    if not len(own):
        return np.zeros(1, np.uint64)
    most = len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1
    if len(popular):
        at = np.minimum(np.searchsorted(popular, own), len(popular) - 1)
        late = popular[at] == own
        if late.any():
            own = np.concatenate([own[~late], own[late][np.argsort(ranks[at[late]])]])
    return own[:most]


def n_parts(n: float, most: int = MOST_PARTS) -> int:
    """Parts for a set of n elements."""
    return min(most, max(PARTS, 1 << (int(np.ceil(n / 8)) - 1).bit_length()))


def counts_by_part(values: np.ndarray, sizes: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """The elements of each set in each part, (sets, parts), for sets one after the other in values. The parts of a smaller number are sums of those of a larger."""
    part = (values & np.uint64(parts - 1)).astype(np.int64)
    return np.bincount(np.repeat(np.arange(len(sizes)) * parts, sizes) + part, minlength=len(sizes) * parts).reshape(-1, parts).astype(np.int32)


def _folded(counts: np.ndarray, parts: int) -> np.ndarray:
    """Counts, each the bytes of a set, as rows of `parts` parts."""
    return np.stack([np.frombuffer(c, np.uint8).reshape(-1, parts).sum(0, dtype=np.int32) for c in counts])


def _near(counts: np.ndarray, n: np.ndarray, own_counts: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
    """Sets that may be as similar as `least` to their partner: the Manhattan distance of the counts is at most the number of elements that one of the two has alone."""
    return np.abs(counts - own_counts).sum(1) <= (n + own) * (1 - least) / (1 + least) + 1e-6


def _fitting(n: np.ndarray, own: int, least: float) -> np.ndarray:
    """Sets of n elements that can be as similar to one of `own`."""
    return np.minimum(n, own) >= least * np.maximum(n, own) - 1e-9


def _spanned(ids: np.ndarray, counts: np.ndarray, n: np.ndarray, least: float, verify=None) -> list[tuple[int, int]]:
    """Links (id, id) that span the components of texts whose sizes and counts fit and that verify(place, places) lets stand: a search from each over those not yet reached."""
    rest, out = np.arange(len(ids)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            k = queue.pop()
            near = rest[_fitting(n[rest], n[k], least)]
            near = near[_near(counts[near], n[near], counts[k], n[k], least)]
            if verify is not None and len(near):
                near = near[verify(k, near)]
            if len(near):
                out += [(int(ids[k]), int(ids[x])) for x in near]
                queue += near.tolist()
                rest = rest[~np.isin(rest, near)]
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of one key after the other, from batches that are sorted by their first `keys` columns."""
    rest: pa.Table | None = None
    for batch in chain(batches, [None]):
        if batch is not None:
            part = pa.Table.from_batches([batch])
            rest = part if rest is None else pa.concat_tables([rest, part]).combine_chunks()
        if rest is None or not len(rest):
            continue
        columns = [rest.column(k).to_numpy() for k in range(keys)]
        cuts = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, [len(rest)]])
        upto = len(cuts) - (1 if batch is None else 2)
        for a, b in zip(cuts[:upto], cuts[1 : upto + 1]):
            if b - a > 1:
                yield rest.slice(a, b - a)
        rest = rest.slice(int(cuts[upto])).combine_chunks()


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _whole_cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, cuts): the rows whose keys are complete, of batches that are sorted by their first `keys` columns."""

    def read(c: pa.Array) -> np.ndarray:
        if not pa.types.is_binary(c.type):
            return c.to_numpy(zero_copy_only=False)
        out = np.empty(len(c), object)
        out[:] = c.to_pylist()
        return out

    held: list[list[np.ndarray]] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = [read(c) for c in batch.columns]
            held.append(new)
            if len(held) > 1 and all(c[0] == c[-1] and h[-1] == c[0] for h, c in zip(held[-2][:keys], new[:keys])):
                continue
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*held)]
        cuts = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)) + 1, [len(columns[0])]])
        cuts = cuts if batch is None else cuts[:-1]
        yield columns, cuts
        held = [[c[cuts[-1] :] for c in columns]]


def _shared_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, id) sorted by cell to (key, id) of the cells of two or more. The key is a hash of the cell's ids, so cells of the same texts, as near copies have many, become one; should others, they are searched together."""
    for (_, ids), cuts in _whole_cells(batches, 1):
        sizes = np.diff(cuts)
        if not len(sizes):
            continue
        keys = mix(np.add.reduceat(mix(ids[: cuts[-1]].view(np.uint64)), cuts[:-1]) + sizes.astype(np.uint64)).view(np.int64)
        own = np.repeat(sizes > 1, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, sizes)[own]), pa.array(ids[: cuts[-1]][own])], names=["key", "id"])


def _link_cells(least: float):
    """Rows (key, two block numbers, id, n, counts), sorted, to the links that span each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, ids, n, counts), cuts in _whole_cells(batches, 3):
            out, parts = [], np.array([len(c) for c in counts])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a == 2:
                    if _fitting(n[a], n[a + 1], least):
                        both = _folded(counts[a:b], min(parts[a], parts[a + 1]))
                        if _near(both[:1], n[a], both[1], n[a + 1], least)[0]:
                            out.append((int(ids[a]), int(ids[a + 1])))
                elif b - a > 2:
                    # Sets of similar sizes have numbers of parts as similar.
                    for least_parts in np.unique(parts[a:b]).tolist():
                        own = a + np.flatnonzero((parts[a:b] >= least_parts) & (parts[a:b] < 2 * least_parts / least))
                        if len(own) > 1:
                            out += _spanned(ids[own], _folded(counts[own], least_parts), n[own], least)
            yield _pairs(out)

    return run


def _dealt(rows: DataFrame, root: str, size: str, block: int, carried: list[str]) -> DataFrame:
    """root, b1, b2 and the carried columns (id among them): each row once for every pair of blocks that its own is in, for `size` rows of a root in blocks of about `block`. Every two rows of a root meet."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = rows.select(root, *carried, own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return dealt.select(root, F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), *carried)


def candidate_links(nodes: DataFrame, least: float = LEAST, full_cell: int = FULL_CELL) -> DataFrame:
    """Links (a, b) of nodes (id, n, counts, prefix) that share an element of their prefixes and whose sizes and counts may be those of similar sets: a set that spans their components.

    A cell of more than full_cell nodes is dealt out as pairs of blocks, so all its pairs are searched.
    """
    cells = nodes.select(F.explode("prefix").alias("cell"), "id").repartition("cell").sortWithinPartitions("cell")
    shared = cut(cells.mapInArrow(_shared_cells, "key long, id long").distinct())
    sized = shared.join(shared.groupBy("key").agg(F.count("*").alias("size")), "key").join(nodes.select("id", "n", "counts"), "id")
    by = ["key", "b1", "b2"]
    dealt = _dealt(sized, "key", "size", full_cell, ["id", "n", "counts"]).repartition(*by).sortWithinPartitions(*by, "id")
    return dealt.mapInArrow(_link_cells(least), "a long, b long").distinct()


def _verified(least: float):
    """Rows of one group (root, two block numbers, id, n, shingles), sorted, to the links that their shingle sets bear out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            n, lists = group["n"].to_numpy(), group["shingles"].combine_chunks()
            values, offsets = lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(n)])

            def similar(k: int, others: np.ndarray) -> np.ndarray:
                own = values[offsets[k] : offsets[k + 1]]
                out = np.empty(len(others), bool)
                for i in range(0, len(others), 256):
                    some = others[i : i + 256]
                    rows = [values[offsets[x] : offsets[x + 1]] for x in some.tolist()]
                    them = np.concatenate(rows)
                    at = np.minimum(np.searchsorted(own, them), max(0, len(own) - 1))
                    hit = np.concatenate([[0], np.cumsum(own[at] == them)]) if len(own) else np.zeros(len(them) + 1, int)
                    ends = np.cumsum([len(r) for r in rows])
                    both = hit[ends] - hit[np.concatenate([[0], ends[:-1]])]
                    every = len(own) + n[some] - both
                    out[i : i + 256] = both >= least * every - 1e-9
                return out

            yield _pairs(_spanned(group["id"].to_numpy(), counts_by_part(values, n, n_parts(n.mean(), 1024)), n, least, similar))

    return run


def similar_groups(docs: DataFrame, shingle: int = WORDS, least: float = LEAST, full_cell: int = FULL_CELL, block: int = GROUP_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(nodes, dropped) of docs (doc_id, text): a node for each different text, id its smallest doc_id; dropped: the nodes, by id, that similar texts link to a smaller one.

    Words are as for the fingerprints. Texts are linked where the Jaccard similarity of their sets of
    `shingle` words is `least` or more; a group is what links reach. Equal texts are one node. Texts
    without words are alike. Every link is found.

    Candidates are found on prefixes, sizes and counts alone; the texts of candidates are
    read again for their shingles, each once and only in its candidate group, and every link is
    verified on them. A group of more than `block` texts is dealt out as pairs of blocks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("body")).where("id is not null")
    hashed = rows.select("id", "body", F.xxhash64("body").alias("h1"), F.xxhash64(F.lit("second"), "body").alias("h2"))
    sketched = hashed.mapInArrow(_sketches(shingle, least, *_popular(hashed, shingle)), "id long, h1 long, h2 long, n long, counts binary, prefix array<long>")
    nodes = cut(sketched.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("prefix").alias("prefix")).drop("h1", "h2"))
    grouped = components(candidate_links(nodes, least, full_cell)).withColumnsRenamed({"node": "id"})
    sized = cut(grouped.join(grouped.groupBy("root").agg(F.count("*").alias("size")), "root"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_steps(batch.column(4)):
                own = shingle_sets(data, offsets, shingle)
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)))
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(4)), pa.array([len(x) for x in own], pa.int64()), values], names=["root", "b1", "b2", "id", "n", "shingles"])

    # The first of equal rows of an id: a node's text, once.
    members = F.broadcast(sized) if sized.count() <= BROADCAST_ROWS else sized
    texts = rows.join(members, "id").groupBy("id", F.xxhash64("body").alias("h")).agg(F.first("body").alias("body"), F.first("root").alias("root"), F.first("size").alias("size"))
    sets = _dealt(texts, "root", "size", block, ["id", "body"]).mapInArrow(shingles, "root long, b1 int, b2 int, id long, n long, shingles array<long>")
    by = ["root", "b1", "b2"]
    links = sets.repartition(*by).sortWithinPartitions(*by, "id").mapInArrow(_verified(least), "a long, b long")
    dropped = components(links.distinct()).where("node <> root").select(F.col("node").alias("id")).distinct()
    return nodes, dropped


def _popular(hashed: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ranks): frequent shingles of a sample of hashed (body, h1), sorted, and their order by the number of texts."""
    every = max(1, hashed.count() // SAMPLE)
    sample = hashed.where((F.pmod("h1", F.lit(every)) == 0) & (F.length("body") <= SAMPLE_TEXT)).dropDuplicates(["h1"]).select("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_steps(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(data, offsets, shingle)).view(np.int64))], names=["h"])

    seen = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "h").limit(POPULAR).toArrow()
    values, n = seen["h"].to_numpy().view(np.uint64), seen["n"].to_numpy()
    ranks = np.empty(len(n), np.int64)
    ranks[np.lexsort((values, n))] = np.arange(len(n))
    order = np.argsort(values)
    return values[order], ranks[order]


def _sketches(shingle: int, least: float, popular: np.ndarray, ranks: np.ndarray):
    """id, text and two hashes to id, hashes, n, counts (no more than 255, which bounds as well) and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, cells = [], [], []
            for _, _, data, offsets in text_steps(batch.column(1)):
                own = shingle_sets(data, offsets, shingle)
                n = np.array([len(x) for x in own])
                sizes.append(n)
                counts += [np.minimum(counts_by_part(x, np.array([len(x)]), n_parts(len(x)))[0], 255).astype(np.uint8).tobytes() for x in own]
                cells += [prefix(x, popular, ranks, least) for x in own]
            ends = pa.array(np.cumsum([0, *(len(x) for x in cells)]), pa.int32())
            values = pa.array(np.concatenate([np.zeros(0, np.uint64), *cells]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]), pa.int64()), pa.array(counts, pa.binary()), pa.ListArray.from_arrays(ends, values)],
                names=["id", "h1", "h2", "n", "counts", "prefix"],
            )

    return run


def keep_representatives(docs: DataFrame, shingle: int = WORDS, least: float = LEAST) -> DataFrame:
    """docs with one document of each group of near duplicates (similar_groups), the one with the smallest doc_id.

    Rows that repeat a doc_id are one document; rows with a null doc_id stay, as nothing names them.
    """
    nodes, dropped = similar_groups(docs, shingle, least)
    kept = nodes.select("id").distinct().join(dropped, "id", "left_anti").select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*(f"`{c}`" for c in docs.columns))
    return named.union(docs.where("doc_id is null"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")

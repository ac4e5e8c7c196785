"""Sharding by a histogram sort: splitters of a hashed key are refined until shards have equal bytes, then rows move once."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spare_name

#: Bytes of one partition of the exchange; a shard is written as several partitions in key order.
PART_BYTES = 256 << 20
#: Partitions of a shard at least: the shards of a small table are small, those of a large one follow from part_bytes.
LEAST_PARTS = 5
#: Share of a shard's bytes by which a splitter may miss its target.
TOLERANCE = 0.0005
#: Candidate boundaries in each open interval and round.
PROBES = 32
_LOW, _HIGH = -(1 << 63), 1 << 63


def with_interval(rows: DataFrame, key: str, bounds: list[int], name: str) -> DataFrame:
    """rows with `name`: how many of the sorted bounds are not above the key. Columns alone.

    The first bits of a key say which few bounds to hold it against: the table of those is broadcast,
    and has a row for each bound or two, 8 bytes each.
    """
    bits = min(30, max(1, len(bounds).bit_length()))
    known = np.array(bounds, np.int64)
    lows = [t << (64 - bits) for t in range(-(1 << (bits - 1)), 1 << (bits - 1))]
    edges = np.append(np.searchsorted(known, np.array(lows, np.int64), "left"), len(known)).tolist()
    top, base, near = spare_name(rows, "top"), spare_name(rows, "base"), spare_name(rows, "near")
    table = [(t - (1 << (bits - 1)), edges[t], known[edges[t] : edges[t + 1]].tolist()) for t in range(1 << bits)]
    small = rows.sparkSession.createDataFrame(table, f"{top} long, {base} int, {near} array<long>")
    found = rows.withColumn(top, F.shiftright(F.col(key), 64 - bits)).join(F.broadcast(small), top)
    return found.withColumn(name, (F.col(base) + F.size(F.filter(near, lambda x: x <= F.col(key)))).cast("int")).drop(top, base, near)


def _histogram(sizes: DataFrame, probes: list[int]) -> dict[int, tuple[int, int]]:
    """Exact bytes and rows with key in [probes[i], probes[i + 1]), by i; keys below the first have i = -1. Partial sums: a task sends a row for each interval."""
    got = with_interval(sizes.select("key", "size"), "key", probes, "i").groupBy("i").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    return {r.i - 1: (r.bytes, r.n) for r in got.collect()}


def find_splitters(sizes: DataFrame, n_parts: int, strict_every: int = 1, tolerance: float = TOLERANCE) -> tuple[list[int], list[int], set[int]]:
    """Keys that cut sizes (key long, size long) into n_parts of near-equal bytes, the rows below each, and the keys that are too heavy to be cut so.

    Each round counts, over all partitions, the exact bytes below the candidate boundaries of every
    open splitter, and narrows it to the interval that its target falls in. A splitter is done when
    its bytes are within tolerance of the target (of a strict_every times larger share for those that
    are not multiples of strict_every), or when no key lies between the two nearest boundaries: the
    target then lies inside the rows of one key, which is heavy if these are several.
    """
    total, rows = sizes.agg(F.sum("size"), F.count("*")).collect()[0]
    if not rows:
        return [0] * (n_parts - 1), [0] * (n_parts - 1), set()
    targets = [total * k / n_parts for k in range(1, n_parts)]
    slack = [tolerance * total * strict_every / n_parts if k % strict_every == 0 else 0.05 * total / n_parts for k in range(1, n_parts)]
    # Of each splitter: the interval of keys, with the bytes and rows below its ends.
    low, high = [(_LOW, 0, 0)] * len(targets), [(_HIGH, total, rows)] * len(targets)
    best: list[tuple[int, int, int] | None] = [None] * len(targets)
    open_, heavy = set(range(len(targets))), set()
    while open_:
        candidates = {_LOW}
        for k in open_:
            a, b = low[k][0], high[k][0]
            candidates |= {a, b} | {a + (b - a) * j // (PROBES + 1) for j in range(1, PROBES + 1)}
        probes = sorted(x for x in candidates if x < _HIGH)
        counted = _histogram(sizes, probes)
        below = [(probes[0], 0, 0)]
        for i in range(len(probes)):
            got = counted.get(i, (0, 0))
            below.append(((probes[i + 1] if i + 1 < len(probes) else _HIGH), below[-1][1] + got[0], below[-1][2] + got[1]))
        mass = [b[1] for b in below]
        for k in list(open_):
            at = min(max(bisect_right(mass, targets[k]), 1), len(below) - 1)
            # The last boundary not above the target and the first above it.
            low[k], high[k] = below[at - 1], below[at]
            nearest = min(low[k], high[k], key=lambda b: (abs(b[1] - targets[k]), b[0]))
            if abs(nearest[1] - targets[k]) <= slack[k] or high[k][2] - low[k][2] <= 1 or high[k][0] - low[k][0] <= 1:
                best[k] = nearest
                open_.discard(k)
                if abs(nearest[1] - targets[k]) > slack[k] and high[k][2] - low[k][2] > 1:
                    heavy.add(low[k][0])
    done = sorted(best)
    return [b[0] for b in done], [b[2] for b in done], heavy


def _keyed(docs: DataFrame, doc_id: str, text: str, key: str, heavy: set[int]) -> DataFrame:
    """docs with size and key. Rows of a heavy key are counted by their columns, equal rows as one from each task on, and dealt out again as so many rows with a key for each."""
    sized = docs.withColumn("size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).withColumn(key, F.xxhash64(doc_id, text))
    if not heavy:
        return sized
    known = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in sorted(heavy)], f"{key} long"))
    copies, nth = spare_name(sized, "copies"), spare_name(sized, "nth")
    hot = sized.join(known, key, "left_semi").groupBy(*(F.col(f"`{c}`") for c in sized.columns)).agg(F.count("*").alias(copies))
    # Rows that are equal but for other columns are told apart by a hash of those that can be hashed.
    told = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    each = hot.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), copies))).withColumn(key, F.xxhash64(*told, nth))
    return sized.join(known, key, "left_anti").select(*(f"`{c}`" for c in sized.columns)).union(each.select(*(f"`{c}`" for c in sized.columns)))


def shard_documents(docs: DataFrame, n_shards: int = 8, text: str = "text", doc_id: str = "doc_id", part_bytes: int = PART_BYTES) -> DataFrame:
    """Every row of docs with size, shard and slot, partitioned by shard and in slot order; law `bytes`.

    size is the text's UTF-8 bytes (null: none) plus 1. Rows are ordered by a 64-bit hash of doc_id and
    text, a fixed shuffle, and cut into n_shards shards whose bytes differ by TOLERANCE or by the rows
    at a boundary. slot counts a shard's rows from 0 without gaps. Repeated rows have one key and stay
    together, unless there are so many that a boundary would have to part them: then each has a key of
    its own. An empty table gives no rows. Columns named size, shard or slot are replaced.

    Keys and sizes are computed once and written (16 bytes a row); each round of the histogram reads
    them and returns one row for each interval that has rows. A shard is several partitions, so no
    task holds a whole shard: the rows below each partition are known from the histogram, and a row's
    slot is that count and its place in the partition.
    """
    docs = docs.drop("size", "shard", "slot")
    key = spare_name(docs, "key")
    heavy: set[int] = set()
    while True:
        sized = _keyed(docs, doc_id, text, key, heavy)
        sizes = cut(sized.select(F.col(key).alias("key"), "size"))
        total = sizes.agg(F.sum("size")).collect()[0][0] or 0
        n_parts = n_shards * max(LEAST_PARTS, -(-total // (n_shards * part_bytes)))
        per_shard = n_parts // n_shards
        splitters, below, found = find_splitters(sizes, n_parts, per_shard)
        if found <= heavy:
            break
        heavy |= found
    base = [0, *below]
    part, place = spare_name(docs, "part"), spare_name(docs, "place")
    # Keys lie in order in each partition, and so do equal keys by id and size: the order of a shard.
    moved = with_interval(sized, key, splitters, part).repartitionById(n_parts, F.col(part)).sortWithinPartitions(key, doc_id, "size")
    moved = moved.withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    starts = docs.sparkSession.createDataFrame([(p, base[p] - base[p // per_shard * per_shard]) for p in range(n_parts)], f"{part} int, start long")
    moved = moved.join(F.broadcast(starts), part)
    return moved.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        "size",
        F.floor(F.col(part) / per_shard).cast("int").alias("shard"),
        (F.col("start") + F.col(place)).alias("slot"),
    )


def digest(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    got = shard_documents(docs.select("doc_id", "text"), n_shards)
    return got.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

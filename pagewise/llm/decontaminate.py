"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over training texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import byte_class, find_words, mix
from .common import cut, spare_name, text_steps

WINDOW = 10
#: Bytes of benchmark text in one broadcast set, whose windows take some 40 times that in memory; a larger benchmark is taken in several passes.
SET_BYTES = 4 << 20
#: Word bytes: 0-9, a-z (after lower-casing) and every byte of a character beyond ASCII.
WORD = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _window_hashes(words: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - m + 1), np.uint64)
    for j in range(m):
        out = out * _STEP + words[j : j + len(out)]
    return mix(out)


@dataclass
class WindowSet:
    """The windows of some benchmark items: by length, a bit filter, sorted hashes and the exact words with their items."""

    exact: dict[int, dict[bytes, list[str]]] = field(default_factory=dict)
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    bits: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> WindowSet:
        exact: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        keys: dict[int, list[np.ndarray]] = defaultdict(list)
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            found = find_words(raw, np.array([0, len(raw)]), WORD)
            n = len(found.starts)
            if not n:
                continue
            m, low, hashed = min(n, window), found.low.tobytes(), found.hashes()
            parts = [low[s:e] for s, e in zip(found.starts, found.ends)]
            for i in range(n - m + 1):
                exact[m][b" ".join(parts[i : i + m])].add(item)
            keys[m].append(_window_hashes(hashed, m))
        out = cls()
        for m, by in exact.items():
            out.exact[m] = {k: sorted(v) for k, v in by.items()}
            out.hashes[m] = h = np.unique(np.concatenate(keys[m]))
            size = 1 << max(16, int(len(h) * 16).bit_length())
            out.bits[m] = np.zeros(size, bool)
            out.bits[m][(h & np.uint64(size - 1)).astype(np.int64)] = True
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list[tuple[int, int]], set[str]]]]:
        """Words of each text, and for texts with hits the hit byte runs and words and items: {text: (runs, words hit, items)}."""
        found = find_words(data, offsets, WORD)
        counts = np.diff(found.ptr)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        if len(found.starts) and self.exact:
            hashed, owner, low = found.hashes(), found.texts(), found.low.tobytes()
            for m, keys in self.hashes.items():
                w = _window_hashes(hashed, m)
                if not len(w):
                    continue
                at = np.flatnonzero(self.bits[m][(w & np.uint64(len(self.bits[m]) - 1)).astype(np.int64)])
                at = at[owner[at] == owner[at + m - 1]]
                pos = np.searchsorted(keys, w[at])
                pos[pos == len(keys)] = 0
                for i in at[keys[pos] == w[at]].tolist():
                    own = b" ".join([low[s:e] for s, e in zip(found.starts[i : i + m].tolist(), found.ends[i : i + m].tolist())])
                    if (of := self.exact[m].get(own)) is not None:
                        hits[int(owner[i])].append((i, i + m))
                        items[int(owner[i])].update(of)
        out = {}
        for doc, ranges in hits.items():
            runs: list[list[int]] = []
            for a, b in sorted(ranges):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            base = int(offsets[doc])
            out[doc] = ([(int(found.starts[a]) - base, int(found.ends[b - 1]) - base) for a, b in runs], sum(b - a for a, b in runs), items[doc], [(a - int(found.ptr[doc]), b - int(found.ptr[doc])) for a, b in runs])
        return counts, out

    def clean(self, text: str) -> str:
        """The text without its hit runs, until none is left."""
        raw = text.encode()
        while True:
            _, found = self.scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            if not found:
                return raw.decode(errors="replace")
            keep, at = [], 0
            for a, b in found[0][0]:
                keep.append(raw[at:a])
                at = b
            raw = b"".join([*keep, raw[at:]])


#: What a scan adds to each row: words, the word ranges that are hit, and the items whose windows occur.
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_ranges", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("cleaned", T.StringType()),
    ]
)


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [tuple(r) for r in out]


def _pass(windows: WindowSet, text: str, found: str, first: bool, clean: bool, names: list[str]):
    kind = pa.struct([("n_words", pa.int64()), ("hit_ranges", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("cleaned", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(text))
            earlier = None if first else batch.column(names.index(found)).to_pylist()
            for start, end, data, offsets in text_steps(column):
                counts, hits = windows.scan(data, offsets)
                rows = [{"n_words": int(c), "hit_ranges": [], "items": [], "cleaned": None} for c in counts]
                for i, (_, _, items, ranges) in hits.items():
                    rows[i] |= {"hit_ranges": ranges, "items": sorted(items)}
                if earlier is not None:
                    for row, old in zip(rows, earlier[start:end]):
                        row["hit_ranges"] = _merged([(r["first"], r["end"]) for r in old["hit_ranges"]], row["hit_ranges"])
                        row["items"] = sorted({*old["items"], *row["items"]})
                if clean:
                    for i in hits:
                        rows[i]["cleaned"] = windows.clean(column[start + i].as_py())
                for row in rows:
                    row["hit_ranges"] = [{"first": a, "end": b} for a, b in row["hit_ranges"]]
                part = batch.slice(start, end - start)
                kept = [part.column(k) for k, n in enumerate(names) if n != found]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, kind)], names=[*(n for n in names if n != found), found])

    return run


def without_ranges(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without these ranges of its words, each from the start of its first word to the end of its last."""
    raw = text.encode()
    words = find_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), WORD)
    keep, at = [], 0
    for a, b in ranges:
        keep.append(raw[at : int(words.starts[a])])
        at = int(words.ends[b - 1])
    return b"".join([*keep, raw[at:]]).decode(errors="replace")


def _cut_hits(body: str, again: str, names: list[str]):
    """body without the hit ranges of `again`, null where there are none; `again` goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [[(r["first"], r["end"]) for r in x["hit_ranges"]] for x in batch.column(names.index(again)).to_pylist()]
            cuts = [without_ranges(t.as_py(), r) if r else None for t, r in zip(batch.column(names.index(body)), hits)]
            kept = [pa.array(cuts, pa.string()) if n == body else batch.column(k) for k, n in enumerate(names) if n != again]
            yield pa.RecordBatch.from_arrays(kept, names=[n for n in names if n != again])

    return run


def _clean_in_rounds(rows: DataFrame, sets: list[Callable[[], WindowSet]], text: str, found: str) -> DataFrame:
    """rows with `cleaned`: all sets' hits are cut at once, and every set scans the cut texts again, until none hits.

    A text is what it would be with one set of all windows. Each round is written to the checkpoint
    folder; only rows that the round before has cut go into it.
    """
    body = spare_name(rows, "body")
    rows = rows.withColumn(body, F.col(text).cast("string"))
    again = spare_name(rows, "again")
    rows, done = rows.withColumn(again, F.col(found)), None
    while True:
        kept = [f for f in rows.schema.fields if f.name != again]
        cutted = rows.mapInArrow(_cut_hits(body, again, rows.columns), T.StructType(kept))
        rows = cut(cutted.withColumn(found, F.col(found).withField("cleaned", F.coalesce(F.col(body), F.col(f"{found}.cleaned")))))
        over = rows.where(F.col(body).isNull()).drop(body)
        done = over if done is None else done.union(over)
        rows = rows.where(F.col(body).isNotNull())
        if not rows.take(1):
            return done
        schema = T.StructType([*rows.schema.fields, T.StructField(again, FOUND)])
        for k, build in enumerate(sets):
            rows = cut(rows.mapInArrow(_pass(build(), body, again, k == 0, False, rows.columns), schema))


def _pieces(items: DataFrame, window: int, set_bytes: int) -> DataFrame:
    """items (item, body) with those of more than set_bytes cut into pieces of words that overlap by all but one word of a window: together they have the item's windows."""
    words = F.regexp_extract_all(F.translate("body", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    step = max(1, set_bytes // 16)
    large = items.where(F.octet_length("body") > set_bytes).select("item", words.alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window), F.lit(step))
    cut_up = large.select("item", "w", F.explode(starts).alias("at")).select("item", F.array_join(F.slice("w", F.col("at") + 1, step + window - 1), " ").alias("body"))
    return items.where(F.octet_length("body") <= set_bytes).union(cut_up)


def _sets(benchmark: DataFrame, window: int, set_bytes: int) -> list[Callable[[], WindowSet]]:
    """What builds the set of each part of the benchmark: one part where it is below the bound, which is counted first. A part's rows come to the driver when its set is built."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body")).where("item is not null and body is not null")
    total = items.agg(F.sum(F.octet_length("body"))).collect()[0][0] or 0
    parts = -(-total // set_bytes) or 1
    items = items if parts == 1 else _pieces(items, window, set_bytes)
    part = F.pmod(F.xxhash64("item", "body"), F.lit(parts))
    return [lambda own=items if parts == 1 else items.where(part == k): WindowSet.of([(r.item, r.body) for r in own.collect()], window) for k in range(parts)]


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", found: str = "found", window: int = WINDOW, clean: bool = False, set_bytes: int = SET_BYTES) -> DataFrame:
    """Every row of docs, with a struct `found` (n_words, hit_ranges, items, cleaned).

    A word is a run of 0-9, A-Z, a-z and characters beyond ASCII, A-Z in lower case. An item's
    windows are its runs of `window` words; an item of fewer words, but not none, is one window. A
    text word in any occurrence of a window is hit; hit_ranges are the maximal runs of hit words, in
    words; items are the ids whose windows occur, sorted as strings. With clean, `cleaned` is the
    text without its hit runs, cut again until none is left (null where nothing was hit).

    Windows are looked up by hash and then compared word by word. The set is broadcast with the
    function, and its size is bounded: the benchmark is measured first, and one of more than
    set_bytes is taken in parts, one job over the rows for each, with no shuffle: its result is written
    to the checkpoint folder, and its set is gone before the next one is built. An item of more than
    set_bytes is cut into overlapping pieces. With clean, the parts' hits are cut together, and cut rows
    are passed again until no part hits: the texts don't depend on the parts.

    Null and empty texts have no words. Null items and items with null texts are left out; an
    item_id that repeats counts once. Repeated rows stay. With an empty benchmark nothing is hit.
    A column of docs named like `found` is replaced.
    """
    docs = docs.drop(found) if found in docs.columns else docs
    schema = T.StructType([*docs.schema.fields, T.StructField(found, FOUND)])
    out, sets = docs, _sets(benchmark, window, set_bytes)
    if len(sets) == 1:
        return out.mapInArrow(_pass(sets[0](), text, found, True, clean, out.columns), schema)
    for k, build in enumerate(sets):  # a job for each: one set is alive at a time, on the driver and on the workers
        out = cut(out.mapInArrow(_pass(build(), text, found, k == 0, False, out.columns), schema))
    return _clean_in_rounds(out, sets, text, found) if clean else out


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, drop_share: float = 0.5) -> DataFrame:
    """docs without benchmark passages: hit spans are cut, and a row of which drop_share of the words or more are hit goes.

    Columns and other rows stay as they are; a column n_chars, if there is one, follows a cut text.
    """
    mark = spare_name(docs, "found")
    got = scan_benchmark(docs, benchmark, text, mark, window, clean=True)
    n_hit = F.aggregate(f"{mark}.hit_ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["first"])
    got = got.where((n_hit == 0) | (n_hit < drop_share * F.col(f"{mark}.n_words")))
    cleaned = F.coalesce(F.col(f"{mark}.cleaned"), F.col(text))
    changed = {text: cleaned}
    if "n_chars" in docs.columns and text == "text":
        changed["n_chars"] = F.when(F.col(f"{mark}.cleaned").isNotNull(), F.length(cleaned)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return got.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    got = scan_benchmark(docs.select("doc_id", "text"), benchmark).drop("text")
    n_hit = F.aggregate("found.hit_ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["first"])
    return got.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "found.items").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


DIGEST_SQL = r"""
with docs as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), items as (
  select cast(item_id as varchar) as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), item_windows as (
  select distinct item, m, array_to_string(list_slice(w, i, i + m - 1), ' ') as win
  from (select item, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0)
), doc_windows as (
  select r, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') as win
  from (select r, w, m, unnest(range(1, len(w) - m + 2)) as i from docs, (select distinct m from item_windows) where len(w) >= m)
), hits as (
  select d.r, d.m, d.i, t.item from doc_windows d join item_windows t on d.m = t.m and d.win = t.win
), hit_words as (
  select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + m)) as p from hits) group by r
), hit_items as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hits) group by r
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit_words using (r) left join hit_items using (r)
"""

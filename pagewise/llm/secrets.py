"""Secret scan: patterns of assigned, access and hex secrets, and password guess costs of values in credential contexts."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import byte_class
from .common import text_steps

#: Kinds of findings, in the order that ranks them where they start together. `guess` is the one that costs add.
KINDS = ("assign", "access", "hex", "guess")
#: Decimal digits of the guesses from which a value counts as a secret, by its kinds of characters (small letters, capitals inside it, digits, signs inside it).
#: Ordinary words are long but of one kind, passwords of people are short and of several.
LEAST_COST = {0: 24.0, 1: 24.0, 2: 14.0, 3: 10.0, 4: 10.0}

# The patterns of the base findings and the fewest characters of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Each match of ASSIGN has one of these, in lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: A credential context and its value, which has more letters than a base value may have.
CONTEXT = re.compile(
    r"""(?<![a-z0-9])(?:[a-z0-9]+[_.-])*(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|auth|login|(?:api|access|private|secret|account|signing|encryption)[_-]?key)["']?[\x20\t]*(?:[:=]|=>|:=)[\x20\t]*(?:"([^"\s]{6,})"|'([^'\s]{6,})'|(?!["'])([^\s"'<>,;]{6,}))""",
    re.IGNORECASE | re.ASCII,
)
CONTEXT_WORDS = ("pass", "pwd", "pin", "secret", "token", "credential", "auth", "login", "key")

#: Common parts of passwords, most common first: a word's rank is its cost.
WORDS = (
    "password pass admin welcome login letmein qwerty monkey dragon master hello freedom whatever secret summer winter spring autumn sunshine princess "
    "football baseball superman batman shadow michael jordan jennifer hunter ranger buster soccer hockey killer george charlie andrew love angel "
    "test guest user root default change changeme example sample demo temp token key access private public system server database backup office "
    "company internet computer google apple orange purple silver golden flower cookie cheese pepper ginger tigger thomas robert daniel jessica ashley "
    "the and for you not all new one two your my this that none null true false string value enter here"
).split()
RANKS = {w: k + 2 for k, w in enumerate(WORDS)}
LONGEST_WORD = max(map(len, WORDS))
#: Rows of keys, for walks along them; a walk goes either way.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "0123456789")
_NEXT = {(row[i], row[i + 1]): 1 for row in KEY_ROWS for i in range(len(row) - 1)} | {(row[i + 1], row[i]): -1 for row in KEY_ROWS for i in range(len(row) - 1)}
_LEET = str.maketrans("@4310$57!", "aaeiosst" + "i")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")
_LOG = math.log10


def _per_character(c: str) -> float:
    """Of as many characters as a guesser has tried by then: digits, small letters, capitals, signs, others."""
    return _LOG(10 if c.isdigit() else (26 if c.islower() else 52) if c.isascii() and c.isalpha() else 95 if c.isascii() else 200)


_ENDS = re.compile(r"\A[\W_]+|[\W_]+\Z")


def character_kinds(value: str) -> int:
    """How many of small letters, capitals, digits and signs the value has. A capital at its start, capitals alone and signs at its ends are how words are written."""
    core = _ENDS.sub("", value)
    capitals = not core.isupper() and any(c.isupper() for c in core[1:])
    return any(c.islower() or not capitals and c.isalpha() for c in core) + capitals + any(c.isdigit() for c in core) + any(not c.isalnum() for c in core)


def is_secret(value: str, cost: float) -> bool:
    return cost >= LEAST_COST[character_kinds(value)]


def _readings(value: str) -> tuple[str, str]:
    """The value in lower case, and that with letters for the signs that stand for them."""
    low = value.lower()
    if len(low) != len(value):
        low = value
    return low, low.translate(_LEET)


def _short_segments(value: str, low: str, plain: str, i: int) -> list[tuple[int, float, str]]:
    """The (end, cost, kind) of the words and dates that start at i."""
    n, out = len(value), []
    for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
        for read, extra in ((low[i:j], 0.0), (plain[i:j], 0.5)):
            if rank := RANKS.get(read):
                own = value[i:j]
                case = 0.0 if own == own.lower() else 0.3 if own == own.upper() or own[1:] == own[1:].lower() else 1.0
                out.append((j, _LOG(rank) + extra + case, "word"))
                break
    for m in {_DATE.match(value, i, k) for k in range(min(n, i + 10), i + 3, -1)} - {None}:
        out.append((m.end(), _LOG(366 * 120) + (0.6 if re.search(r"\D", m[0]) else 0) if m.end() - i > 4 else _LOG(120), "date"))
    return out


def segment_costs(value: str) -> list[list[tuple[int, float, str]]]:
    """For each start, the (end, cost, kind) of the segments that a guesser would try: all of them, so their number grows with the square of a repeat."""
    n, (low, plain) = len(value), _readings(value)
    out = [_short_segments(value, low, plain, i) for i in range(n)]
    for i in range(n):
        for width in (1, 2, 3, 4):
            k = i + width
            while value[k : k + width] == value[i : i + width] and len(value[k : k + width]) == width:
                k += width
            if k - i >= max(3, 2 * width):
                base = sum(map(_per_character, value[i : i + width]))
                out[i] += [(e, base + _LOG((e - i) // width), "repeat") for e in range(i + 2 * width, k + 1, width) if e - i >= 3]
        k, way = i + 1, 0
        while k < n and (step := _NEXT.get((low[k - 1], low[k]))) and way in (0, step):
            way, k = step, k + 1
            if k - i >= 3:
                out[i].append((k, _LOG(len(KEY_ROWS) * 12 * 2) + _LOG(k - i), "walk"))
    return out


class _Starts:
    """Open starts of a repeat or walk, and the least cost of a segment from one of them.

    A segment's cost grows with the logarithm of its length, so a start that an earlier one undercuts
    never leads again, and neither does one behind which a start of no higher cost lies: both are dropped.
    """

    def __init__(self) -> None:
        self.open: list[tuple[int, float]] = []

    def add(self, start: int, cost: float) -> None:
        while self.open and self.open[-1][1] >= cost:
            self.open.pop()
        self.open.append((start, cost))

    def least(self, end: int, width: int) -> float:
        best, at = math.inf, -1
        for k, (start, cost) in enumerate(self.open):
            if (c := cost + _LOG((end - start) // width)) <= best:
                if c < best:
                    best, at = c, k
        del self.open[at + 1 :]
        return best


def guess_cost(value: str) -> float:
    """The decimal digits of the guesses for the cheapest way to cut value into words, dates, repeats, keyboard walks and brute-force spans.

    Each segment beyond the first doubles the guesses, for its place and kind. The whole value counts, however long.
    """
    n, low, plain = len(value), *_readings(value)
    each = [_per_character(c) for c in value]
    # closed[i]: the least cost of value[:i] with a closed last segment; raw[i]: with an open brute-force span; now[i]: of both, with the next segment's place.
    closed, raw, now = [math.inf] * (n + 1), [math.inf] * (n + 1), [math.inf] * (n + 1)
    closed[0] = 0.0
    repeats = {w: [_Starts() for _ in range(w)] for w in (1, 2, 3, 4)}
    since = dict.fromkeys(repeats, 0)
    walks, walk_since, way = _Starts(), 0, 0
    for i in range(n + 1):
        for width, by in repeats.items():
            # Text from since[width] to i repeats after width characters; a start counts from its least length on.
            if i > width and value[i - 1] != value[i - 1 - width]:
                since[width], repeats[width] = i - width, [_Starts() for _ in range(width)]
                by = repeats[width]
            start = i - max(3, 2 * width)
            if start >= since[width]:
                own = by[i % width]
                own.add(start, now[start] + sum(each[start : start + width]))
                closed[i] = min(closed[i], own.least(i, width))
        if i > 1:
            step = _NEXT.get((low[i - 2], low[i - 1]), 0)
            if step != way:
                walks, walk_since, way = _Starts(), i - 2 if step else i - 1, step
            elif not step:
                walk_since = i - 1
            if i - 3 >= walk_since:
                walks.add(i - 3, now[i - 3] + _LOG(len(KEY_ROWS) * 12 * 2))
                closed[i] = min(closed[i], walks.least(i, 1))
        join = 0.0 if i == 0 else _LOG(2)
        now[i] = min(closed[i], raw[i]) + join
        if i < n:
            raw[i + 1] = min(raw[i] + each[i], closed[i] + join + each[i])
            for end, cost, _ in _short_segments(value, low, plain, i):
                closed[end] = min(closed[end], now[i] + cost)
    return max(0.0, min(closed[n], raw[n]))


def find_secrets(text: str, hex_runs: bool = True) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, guess cost) in code points, by start and then kind; the cost is null but for assign and guess.

    Base kinds are whole matches, leftmost and non-overlapping within a kind. A guess is the value of a
    credential context that is hard to guess for its kind (is_secret) and that no assign or access finding covers.
    """
    out: list[tuple[str, int, int, float | None]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                out.append(("assign", m.start(), m.end(), round(guess_cost(m[2]), 3)))
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if hex_runs:
        out += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    if (":" in text or "=" in text) and any(w in low for w in CONTEXT_WORDS):
        # Base spans of a kind don't overlap, so the last one that starts before a value is the only one of its kind that may cover it.
        base = [sorted((s, e) for k, s, e, _ in out if k == kind) for kind in ("assign", "access")]
        for m in CONTEXT.finditer(text):
            group = 1 if m[1] is not None else 2 if m[2] is not None else 3
            start, end = m.span(group)
            before = (own[k - 1] for own in base if (k := bisect_right(own, (start, len(text)))))
            if not any(end <= e for _, e in before) and is_secret(m[group], cost := guess_cost(m[group])):
                out.append(("guess", start, end, round(cost, 3)))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_IS_HEX = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x66)


def _with_long_hex(data: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Texts that have a run of LEAST_HEX hex digits or more."""
    mask = np.concatenate([[False], _IS_HEX[data], [False]])
    edges = np.flatnonzero(mask[1:] != mask[:-1])
    long = edges[1::2] - edges[::2] >= LEAST_HEX
    # A run may reach over a border of texts, and then only looks long: the pattern decides.
    first = np.searchsorted(offsets, edges[::2][long], "right") - 1
    last = np.searchsorted(offsets, edges[1::2][long] - 1, "right") - 1
    return {k for a, b in zip(first.tolist(), last.tolist()) for k in range(a, b + 1)}


FINDING = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("cost", T.DoubleType())])


def scan_secrets(docs: DataFrame, text: str = "text", found: str = "secrets") -> DataFrame:
    """Every row of docs with an array of findings (kind, start, end, cost), whole texts, null as empty.

    Repeated rows are scanned each; a column named like `found` is replaced; other columns stay.
    """
    docs = docs.drop(found)
    names, kind = docs.columns, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, rows = batch.column(names.index(text)), []
            for start, end, data, offsets in text_steps(column):
                hexed = _with_long_hex(data, offsets)
                for k in range(end - start):
                    body = column[start + k].as_py()
                    rows.append([{"kind": a, "start": s, "end": e, "cost": c} for a, s, e, c in find_secrets(body, k in hexed)] if body else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*names, found])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(found, T.ArrayType(FINDING))]))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs."""
    got = scan_secrets(docs.select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda x: x["kind"] != "guess")
    return got.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"))

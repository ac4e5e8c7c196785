"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, spare_name, windows

#: n-grams in a profile, of a language and of a document.
DEPTH = 400
#: Training documents of each language, about: documents are drawn by a hash of their id and text.
PER_LANGUAGE = 800
#: Characters of a training document at most; longer ones are read in windows over their whole length.
MAX_TRAIN_CHARS = 50_000
#: Languages that are learned at most, the most frequent ones.
MAX_LANGUAGES = 1000
UNKNOWN = "und"
#: Characters that are counted at once; a longer text is counted piece by piece.
PIECE = 1 << 20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams, n from 1 to 3, of the lower-cased words with a mark at each word's ends.

    A code is made of code points plus 2, 21 bits each; the mark is 1. No letters: both are empty.
    """
    table, total, counts = letters(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    tail = np.ones(1, np.int64)
    for at in range(0, len(text), PIECE):
        last = at + PIECE >= len(text)
        points = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        c = np.where(table[points], points + 2, 1)
        # The last two codes of the piece before have been counted as far as they end an n-gram.
        c = np.concatenate([tail, c, [1]] if last else [tail, c])
        c = c[np.concatenate([[True], (c[1:] != 1) | (c[:-1] != 1)])]
        old = len(tail) if at else 1
        one = c[old:][c[old:] != 1]
        two = (c[:-1] << 21) | c[1:]
        three = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        two, three = two[max(0, old - 1) :], three[max(0, old - 2) :]
        three = three[(three >> 21) & 0x1FFFFF != 1]
        codes, n = np.unique(np.concatenate([one, two, three]), return_counts=True)
        if len(total):
            both, back = np.unique(np.concatenate([total, codes]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
            total = both
        else:
            total, counts = codes, n
        tail = c[-2:]
    return (total, counts) if len(total) > 1 else (total[:0], counts[:0])


def ranked(codes: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams and their ranks; n-grams of one count share the middle of their places."""
    order = np.lexsort((codes, -counts))
    codes, counts = codes[order], counts[order]
    _, first, back, n = np.unique(-counts, return_index=True, return_inverse=True, return_counts=True)
    places = (first + (n - 1) / 2)[back]
    return codes[:depth], np.minimum(places[:depth], depth)


@dataclass
class Profiles:
    """languages; codes: sorted, of all profiles; ranks: (code, language), depth where a profile lacks it."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    depth: int

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], depth: int = DEPTH) -> Profiles:
        """rows: text and language. Repeated texts of a language count once."""
        by = defaultdict(list)
        for text, lang in sorted(set(rows)):
            codes, counts = ngram_counts(text)
            if len(codes):
                by[lang].append((codes, counts / counts.sum()))
        own = {}
        for lang, docs in by.items():
            codes, back = np.unique(np.concatenate([c for c, _ in docs]), return_inverse=True)
            own[lang] = ranked(codes, np.round(np.bincount(back, weights=np.concatenate([n for _, n in docs])), 9), depth)
        languages = sorted(own)
        codes = np.unique(np.concatenate([own[x][0] for x in languages])) if own else np.zeros(0, np.int64)
        ranks = np.full((len(codes), len(languages)), float(depth))
        for k, lang in enumerate(languages):
            ranks[np.searchsorted(codes, own[lang][0]), k] = own[lang][1]
        return cls(languages, codes, ranks, depth)

    def distances(self, text: str) -> np.ndarray | None:
        """The mean out-of-place distance to each language as a share of the depth; None if the text has no letter."""
        codes, counts = ngram_counts(text)
        if not len(codes) or not self.languages:
            return None
        codes, places = ranked(codes, counts, self.depth)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        off = np.abs(places[known][:, None] - self.ranks[at[known]]).clip(max=self.depth)
        off[self.ranks[at[known]] >= self.depth] = self.depth
        return (off.sum(0) + self.depth * (~known).sum()) / (self.depth * len(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, ties to the first by name, and how near it is: 1 minus its distance."""
        far = self.distances(text) if text else None
        if far is None:
            return UNKNOWN, 0.0
        k = int(np.argmin(far))
        return self.languages[k], float(1 - far[k])


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_TRAIN_CHARS) -> list[tuple[str, str]]:
    """About per_language texts of each language among rows with crc32(doc_id as text) % 5 <> 0, at most twice as many on average.

    A hash of doc_id and text decides, against a share that comes from the language's exact count of
    rows, so rare languages are drawn in full; equal texts of a language come once. A text over max_chars
    is read in windows over its whole length. Null texts and null languages take no part, nor do
    languages beyond the MAX_LANGUAGES most frequent.
    """
    fit = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (id_crc(F.col("doc_id")) % 5 != 0))
    counts = {r.lang: r["count"] for r in fit.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))))
    drawn = fit.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < share[F.col("lang")] * float(1 << 40))
    # A key of very many drawn rows is the same text again and again: partial aggregates make it one row.
    each = drawn.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.first(windows(F.col("text"), max_chars)).alias("text"))
    return [(r.text, r.lang) for r in each.orderBy("h", "lang").limit(2 * per_language * len(counts)).select("text", "lang").collect()]


#: What identification gives for each text.
FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", found: str = "language") -> DataFrame:
    """Every row of docs with a struct `found` (lang_pred, score from 0 to 1).

    The whole text counts. Null texts and texts without a letter give `und` and 0, and so does every
    text where no language was learned. Repeated rows stay; a column named like `found` is replaced.
    """
    docs = docs.drop(found)
    names, kind = docs.columns, pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [profiles.predict(x.as_py()) for x in batch.column(names.index(text))]
            column = pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*names, found])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(found, FOUND)]))


def learn(docs: DataFrame) -> Profiles:
    """Profiles from docs (doc_id, text, lang), by training_rows()."""
    return Profiles.fit(training_rows(docs))


def keep_known(docs: DataFrame, profiles: Profiles, least: float) -> DataFrame:
    """docs without the rows that are no text of a learned language: `und`, or a score below least."""
    mark = spare_name(docs, "language")
    got = identify(docs, profiles, found=mark)
    return got.where((F.col(f"{mark}.lang_pred") != UNKNOWN) & (F.col(f"{mark}.score") >= least)).drop(mark)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs, learned from docs."""
    got = identify(docs.select("doc_id", "text"), learn(docs)).drop("text")
    return got.select("doc_id", (id_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))

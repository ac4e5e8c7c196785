"""The page quality score: damage, plausible words, density and confidence, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import tokens

#: U+FFFD, and controls other than the usual white space.
DAMAGE = r"[\x{FFFD}[\p{Cc}&&[^\n\t\r]]]"
#: A word that text has: letters, digits, punctuation, symbols; no marks, no format characters.
PLAUSIBLE = r"\A[\p{L}\p{Nd}\p{P}\p{S}&&[^\x{FFFD}]]+\z"
#: Characters of a full page, and the share of text that must be measured before the measure rules.
EXPECTED_CHARS, MEASURED_COVERAGE = 400, 0.5


@dataclass(frozen=True)
class Weights:
    density: float = 0.30
    integrity: float = 0.25
    words: float = 0.30
    confidence: float = 0.15


def clamp01(x: Column) -> Column:
    """Between 0 and 1; NaN is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(x, F.lit(0.0))))


def plain_text(texts: Column) -> Column:
    """The non-empty texts in order, each with a line end behind it."""
    return F.array_join(F.transform(F.filter(texts, lambda t: F.length(t) > 0), lambda t: F.concat(t, F.lit("\n"))), "")


def damaged_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DAMAGE))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def word_ratio(text: Column) -> Column:
    words = tokens(text)
    return ratio(F.size(F.filter(words, lambda w: w.rlike(PLAUSIBLE))), F.size(words))


def additive_score(density: Column, replacement: Column, words: Column, confidence: Column, w: Weights = Weights()) -> Column:
    total = w.density + w.integrity + w.words + w.confidence
    parts = w.density * density + w.integrity * (1 - replacement) + w.words * words + w.confidence * confidence
    return clamp01(parts / (total if total > 0 else 1.0))


def measured_score(density: Column, replacement: Column, words: Column, measured: Column, w: Weights = Weights()) -> Column:
    total = w.density + w.integrity + w.words
    parts = w.density * density + w.integrity * (1 - replacement) + w.words * words
    return clamp01(parts / (total if total > 0 else 1.0)) * measured


def score_pages(pages: DataFrame, weights: Weights = Weights(), escalated: Column | None = None) -> DataFrame:
    """pages (blocks array of structs with text and confidence, in reading order; type; confidence) with a struct `quality`.

    No row leaves its page, so nothing is shuffled. The regular expressions run once for each page:
    intermediate values are columns of their own.
    """
    text = F.col("_plain")
    sized = F.transform(F.col("blocks"), lambda b: F.struct(F.length(F.coalesce(b["text"], F.lit(""))).alias("n"), b["confidence"].alias("c")))
    measured_chars = F.aggregate("_sized", F.lit(0).cast("long"), lambda a, b: a + F.when(b["c"].isNotNull(), b["n"]).otherwise(0))
    weighted = F.aggregate("_sized", F.lit(0.0), lambda a, b: a + F.when(b["c"].isNotNull(), clamp01(b["c"]) * b["n"]).otherwise(0.0))
    chars = F.aggregate("_sized", F.lit(0).cast("long"), lambda a, b: a + b["n"])
    step = (
        pages.withColumns({"_plain": plain_text(F.transform(F.col("blocks"), lambda b: F.coalesce(b["text"], F.lit("")))), "_sized": sized})
        .withColumns({"_n": F.length(text), "_damage": damaged_chars(text), "_words": word_ratio(text), "_mc": measured_chars, "_mw": weighted, "_all": chars})
        .withColumns(
            {
                "_r": ratio(F.col("_damage"), F.col("_n")),
                "_d": F.least(F.lit(1.0), F.col("_n") / F.lit(float(EXPECTED_CHARS))),
                "_e": F.when((F.col("confidence") > 0) | (F.col("type") != "scanned"), F.col("confidence")),
                "_m": F.when(F.col("_mc") > 0, clamp01(F.col("_mw") / F.col("_mc"))),
                "_cov": ratio(F.col("_mc"), F.col("_all")),
            }
        )
    )
    trusted = F.col("_m").isNotNull() & (F.col("_cov") >= MEASURED_COVERAGE)
    score = (
        F.when(F.col("_n") == 0, F.lit(0.0))
        .when(trusted, measured_score(F.col("_d"), F.col("_r"), F.col("_words"), F.col("_m"), weights))
        .otherwise(additive_score(F.col("_d"), F.col("_r"), F.col("_words"), F.coalesce(F.col("_e"), F.lit(0.0)), weights))
    )
    quality = F.struct(
        score.alias("score"),
        F.col("_n").cast("long").alias("char_count"),
        F.col("_r").alias("replacement_ratio"),
        F.col("_words").alias("word_ratio"),
        F.col("_e").alias("engine_confidence"),
        F.col("_m").alias("measured_confidence"),
        F.col("_cov").alias("measured_coverage"),
        (escalated if escalated is not None else F.lit(False)).alias("escalated"),
    )
    return step.withColumn("quality", quality).drop("_plain", "_sized", "_n", "_damage", "_words", "_mc", "_mw", "_all", "_r", "_d", "_e", "_m", "_cov")

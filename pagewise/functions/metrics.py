"""Accuracy metrics: disagreement of two readings, character and word error rates, table cells."""

from __future__ import annotations

import tempfile
import zipfile
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import collapse, tokens

#: Characters that a comparison looks at: edit distance is quadratic.
MAX_COMPARED = 4000
#: Name of the edit distance in a session.
DISTANCE = "pagewise_edit_distance"


def _register_distance(spark: SparkSession) -> None:
    """EditDistance.java as a function of the session: compiled by the compiler that Spark brings for its own code, and sent to the executors as a jar of one class."""
    if spark.catalog.functionExists(DISTANCE):
        return
    compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(files(__package__).joinpath("EditDistance.java").read_text())
    codes, jar = compiler.getBytecodes(), f"{tempfile.mkdtemp(prefix='pagewise-jvm-')}/edit-distance.jar"
    with zipfile.ZipFile(jar, "w") as out:
        for name in codes:
            out.writestr(f"{name.replace('.', '/')}.class", bytes(codes[name]))
    session = spark._jsparkSession
    session.sessionState().resourceLoader().addJar(jar)
    made = session.sharedState().jarClassLoader().loadClass("pagewise.EditDistance").getDeclaredConstructors()[0].newInstance(spark.sparkContext._gateway.new_array(spark._jvm.Object, 0))
    session.udf().register(DISTANCE, made, spark._jvm.org.apache.spark.sql.types.DataTypes.IntegerType)


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance in code points, of texts of any length. It stays in the JVM; 64 cells of the table of distances are a few operations on whole numbers, of which the built-in one does each by itself."""
    _register_distance(SparkSession.active())
    return F.call_function(DISTANCE, a, b)


def disagreement(a: Column, b: Column) -> Column:
    """Edit distance of the collapsed texts as a share of the longer, over the first MAX_COMPARED characters. Symmetric."""
    x, y = (F.substring(collapse(F.coalesce(t, F.lit(""))), 1, MAX_COMPARED) for t in (a, b))
    n, m = F.length(x), F.length(y)
    return F.when((n == 0) & (m == 0), F.lit(0.0)).when((n == 0) | (m == 0), F.lit(1.0)).otherwise(edit_distance(x, y) / F.greatest(n, m))


def error_rate(distance: Column, expected: Column, actual: Column) -> Column:
    """distance as a share of what was expected, at most 1; with nothing expected, 1 if there is anything."""
    return F.when(expected == 0, F.when(actual > 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), distance / expected))


def cer(expected: Column, actual: Column) -> Column:
    x, y = collapse(F.coalesce(expected, F.lit(""))), collapse(F.coalesce(actual, F.lit("")))
    return error_rate(edit_distance(x, y), F.length(x), F.length(y))


def wer(expected: Column, actual: Column) -> Column:
    """Edit distance over words. Each word becomes one private letter, its first place among the pair's distinct words, so the built-in distance counts words.

    There are letters for 1 048 576 distinct words: a pair with more has a table of 10**12 distances, which no page has.
    """
    x, y = tokens(collapse(F.coalesce(expected, F.lit("")))), tokens(collapse(F.coalesce(actual, F.lit(""))))
    codes = F.map_from_entries(F.transform(F.array_distinct(F.concat(x, y)), lambda w, i: F.struct(w, i)))
    # CJK and the areas behind it give letters that are one code point each; surrogates are left out.
    letter = lambda i: F.decode(F.unhex(F.lpad(F.hex(F.when(i < 0xA800 - 0x3000, i + 0x3000).otherwise(i + 0x10000)), 8, "0")), "UTF-32")
    coded = lambda words: F.array_join(F.transform(words, lambda w: letter(codes[w])), "")
    return error_rate(F.levenshtein(coded(x), coded(y)), F.size(x), F.size(y))


def cell_accuracy(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys and cell_accuracy: the share of expected cells (row, col, text) that stand, collapsed, at their place in actual.

    A table with no expected cells is no row here; one that is missing from actual scores 0.
    """
    on = [*keys, "row", "col"]
    both = expected.select(*on, collapse(F.col("text")).alias("want")).join(actual.select(*on, collapse(F.col("text")).alias("got")), on, "left")
    return both.groupBy(*keys).agg(F.avg(F.when(F.col("want") == F.col("got"), 1.0).otherwise(0.0)).alias("cell_accuracy"))


def score_documents(truth: DataFrame, pages: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """document, cer and wer: means over the truth's pages (document, number, text); a missing page counts 1 for each."""
    both = truth.join(pages.select("document", "number", F.col("text").alias("got")), ["document", "number"], "left")
    missing = F.col("got").isNull()
    per = both.select("document", F.when(missing, 1.0).otherwise(cer(F.col("text"), F.col("got"))).alias("cer"), F.when(missing, 1.0).otherwise(wer(F.col("text"), F.col("got"))).alias("wer"))
    out = per.groupBy("document").agg(F.avg("cer").alias("cer"), F.avg("wer").alias("wer"))
    return out if cells is None else out.join(cells.groupBy("document").agg(F.avg("cell_accuracy").alias("cell_accuracy")), "document", "left")


def corpus_summary(documents: DataFrame) -> DataFrame:
    """One row for scored documents (cer, cell_accuracy, wall_ms, error): their number, mean cer and cell accuracy, and their wall seconds. Documents with an error count nowhere; nulls not in the means."""
    good = documents.where("error is null")
    return good.agg(F.count("*").alias("documents"), F.avg("cer").alias("mean_cer"), F.avg("cell_accuracy").alias("mean_cell_accuracy"), F.coalesce(F.sum("wall_ms") / 1000, F.lit(0.0)).alias("wall_seconds"))

"""What the operators of this subpackage share: reading tables, checkpoints, Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..session import materialise as cut

__all__ = ["STEP_BYTES", "cut", "ensure_checkpoint_dir", "id_crc", "model_rows", "read_table", "spare_name", "text_steps", "tokenizer_path", "windows"]

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Characters that the texts of a fit have together, before the longest of them are read in windows; and windows of such a text.
SAMPLE_CHARS, WINDOWS = 64 << 20, 21


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: Column) -> Column:
    """crc32 of the id written as text; 0, as for an empty text, where the id is null."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")), F.lit(0))


def spare_name(df: DataFrame, wanted: str) -> str:
    """wanted, or with underscores before it where df has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def windows(text: Column, most: Column | int) -> Column:
    """The text where it has no more than `most` characters, else WINDOWS stretches of it at equal distances from start to end, joined by spaces, of `most` characters or a few fewer."""
    most = F.lit(most) if isinstance(most, int) else most
    size, width = F.length(text), F.floor((most + 1) / WINDOWS).cast("int") - 1
    starts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda k: F.floor((size - width).cast("long") * k / (WINDOWS - 1)).cast("int") + 1)
    return F.when(size <= most, text).otherwise(F.array_join(F.transform(starts, lambda at: F.substring(text, at, width)), " "))


def fair_length(lengths: list[int], total: int) -> int:
    """The largest length to which texts can be cut so that all together have `total` characters at most; the longest one's length if none has to be cut."""
    left, out = total, 0
    for k, n in enumerate(sorted(lengths)):
        out = min(n, left // (len(lengths) - k))
        left -= out
    return out


def model_rows(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, bound: int, max_chars: int, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most `bound` labelled texts for a fit, by the order of a hash of doc_id.

    Rows with crc32(doc_id as text) % modulus == left_out take no part, nor do null labels and null
    texts. A doc_id that has several labels counts with the largest; one that has several texts, with
    each of them. Texts are whole as long as the sample has no more than sample_chars characters; else
    the longest are read in windows over their whole length, but none of max_chars or fewer.
    """
    id_type = docs.schema["doc_id"].dataType
    chosen = (
        labels.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (id_crc(F.col("doc_id")) % modulus != left_out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    rows = chosen.collect()
    if not rows:
        return []
    labelled = T.StructType([T.StructField("doc_id", id_type), T.StructField("y", T.IntegerType())])
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(spark.createDataFrame([(r.doc_id, r.y) for r in rows], labelled)), "doc_id").withColumn("h", F.xxhash64("text"))
    # Lengths first, of different texts: repeated rows of a doc_id would go beyond the bound.
    sizes = found.select("doc_id", "h", "y", F.length("text").alias("n")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h", "y", "n").limit(bound).collect()
    if not sizes:
        return []
    most = max(max_chars, fair_length([r.n for r in sizes], sample_chars))
    picked = T.StructType([T.StructField("doc_id", id_type), T.StructField("h", T.LongType())])
    small = F.broadcast(spark.createDataFrame(sorted({(r.doc_id, r.h) for r in sizes}), picked))
    texts = found.join(small, ["doc_id", "h"]).select("doc_id", "h", "y", windows(F.col("text"), most).alias("text"))
    got = texts.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "h").select("text", "y").toArrow()
    seen: dict[str, int] = {}
    for text, y in zip(got["text"], got["y"].to_pylist()):
        text = text.as_py()
        seen[text] = max(seen.get(text, 0), y)
    return list(seen.items())


def text_steps(column: pa.ChunkedArray | pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into steps: first row, end row, the bytes, and n + 1 offsets into them. Null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count and (ends := offs[1:] - offs[:-1])[~column.is_valid().to_numpy(zero_copy_only=False)].any():
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
        yield from text_steps(column, step_bytes)
        return
    first = 0
    while first < n:
        last = int(np.searchsorted(offs, offs[first] + step_bytes, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file is: PAGEWISE_TOKENIZERS names the folder, else the installed package does."""
    if folder := os.environ.get("PAGEWISE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)

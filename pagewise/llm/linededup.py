"""Line dedup on DataFrame functions alone: the first document that holds a line keeps it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, spare_name

MIN_CHARS = 10
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case; lower() does that, and faster, where all is ASCII."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """h1, h2 (128 bits of the key), doc, pos, part: one row for each line whose key is long enough, ranged by hash and sorted.

    Rows are range-partitioned by hash, document and position, so a key that very many documents
    share is dealt over many partitions, and sorted so that a key's first occurrence comes first, in its
    partition and over all of them. part is the partition.
    """
    lines = docs.where(F.col(doc_id).isNotNull() & (F.length(text) >= min_chars)).select(F.col(doc_id).alias("doc"), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
    keys = lines.select("doc", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    # Written first: finding the ranges reads these rows twice, and texts should be split once.
    hashed = cut(keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "pos"))
    ranged = hashed.repartitionByRange("h1", "h2", "doc", "pos").sortWithinPartitions("h1", "h2", "doc", "pos")
    return cut(ranged.withColumn("part", F.spark_partition_id()))


def first_documents(seen: DataFrame) -> DataFrame:
    """seen with holder, the document of its key's first occurrence.

    In a partition it streams from the sorted rows of a key: the first one's document goes on to the
    others, and no more than that is held. A key can go on from one partition to the next only as the
    last of one and the first of the other, so a table of each partition's first and last key, one row
    for each, tells the keys whose first occurrence is in an earlier partition.
    """
    run = Window.partitionBy("part", "h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = seen.withColumn("own", F.first("doc").over(run))
    ends = seen.groupBy("part").agg(F.min(F.struct("h1", "h2", "doc")).alias("first"), F.max(F.struct("h1", "h2")).alias("last"))
    # The first document of a partition's last key: only those two keys matter, and in a partition of one key they are the same.
    heads = seen.join(F.broadcast(ends.select("part", F.col("last.h1").alias("h1"), F.col("last.h2").alias("h2"))), ["part", "h1", "h2"], "left_semi").groupBy("part", "h1", "h2").agg(F.min("doc").alias("doc"))
    both = heads.select("part", "h1", "h2", "doc").union(ends.select("part", "first.h1", "first.h2", "first.doc")).groupBy("part", "h1", "h2").agg(F.min("doc").alias("doc"))
    earlier = Window.partitionBy("h1", "h2").orderBy("part")
    carried = both.withColumn("holder", F.first("doc").over(earlier)).where("holder < doc").drop("doc")
    return streamed.join(F.broadcast(carried), ["part", "h1", "h2"], "left").select("doc", "pos", F.coalesce("holder", "own").alias("holder"))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id and dropped: for each document that loses lines, its bitmap in run-length form.

    dropped is array<struct<first, end>>, the maximal runs of line positions that go, in order. A key
    of at least min_chars code points that two or more documents hold stays in the smallest doc_id
    alone, with all its lines there: that is the document of its first occurrence, and what stands in
    any other document goes.

    Only hashes, ids and positions move, never text. Rows with a null doc_id neither hold nor lose
    lines; rows that repeat a doc_id count as one document and share a bitmap, by position.
    """
    lost = first_documents(occurrences(docs, doc_id, text, min_chars)).where("doc <> holder").select("doc", "pos")
    # A run is what stays equal in pos minus the rank: gathered positions, sorted, cut where a gap is.
    runs = lost.groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("gone")).select(
        F.col("doc").alias(doc_id),
        F.expr("filter(transform(gone, (p, i) -> if(i = 0 or gone[i - 1] < p - 1, p, -1)), x -> x >= 0)").alias("firsts"),
        F.expr("filter(transform(gone, (p, i) -> if(i = size(gone) - 1 or gone[i + 1] > p + 1, p + 1, -1)), x -> x >= 0)").alias("ends"),
    )
    return runs.select(doc_id, F.expr("transform(firsts, (f, i) -> named_struct('first', f, 'end', ends[i]))").alias("dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with columns n_lines, n_dropped and kept: the text after its bitmap has been applied."""
    mark = spare_name(docs, "dropped")
    got = docs.drop("n_lines", "n_dropped", "kept").join(bitmaps.select(F.col(doc_id), F.col("dropped").alias(mark)), doc_id, "left")
    lines = spare_name(docs, "lines")
    got = got.withColumn(lines, F.when(F.col(mark).isNotNull(), _lines(F.col(text))))
    whole = F.coalesce(F.col(text), F.lit(""))
    stays = F.expr(
        f"""flatten(transform(sequence(0, size({mark})), i -> slice({lines},
              if(i = 0, 0, {mark}[i - 1].end) + 1,
              if(i = size({mark}), size({lines}), {mark}[i].first) - if(i = 0, 0, {mark}[i - 1].end))))"""
    )
    gone = F.aggregate(mark, F.lit(0), lambda a, r: a + r["end"] - r["first"])
    return got.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")),
        (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col(mark).isNull(), whole).otherwise(F.array_join(stays, "\n")).alias("kept"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs (doc_id, text and any more columns) with n_lines, n_dropped and kept for every row.

    A null or empty text is one empty line; so is the kept text of a document that loses all.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars=min_chars))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of docs."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


DIGEST_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), shared as (
  select key, min(doc_id) as holder from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2
), marked as (
  select k.doc_id, k.pos, k.line, s.holder is not null and k.doc_id <> s.holder as gone
  from keyed k left join shared s on k.key = s.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

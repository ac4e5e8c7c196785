"""The registered queries of the document operators, each with its SQL where SQL can express it.

The driver's tables stand in for engine output: texts are pages, conversations are documents of several
pages, orders and line items are boxes and table cells. Classes and damage follow from ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, quality, text
from ..operators import checks, jobs, layout, routing, tables, tiers
from ..operators.render import render_documents
from ..schemas import BLOCK
from ..session import spread
from ..sources import store
from . import router
from .engines import ImageEngine, NativeEngine, PdfEngine, StubOcr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents for queries that work long on each text."""
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def rounded(c: Column) -> Column:
    return F.round(c, 6)


# What queries share, in Spark and in SQL.


def damaged(body: Column, doc_id: Column) -> Column:
    """Every lower-case letter, or every vowel, of some documents becomes U+FFFD; of some, only a short start is left."""
    vowels = lambda c: F.regexp_replace(c, "[aeiou]", "�")
    return F.when(doc_id % 5 == 0, F.regexp_replace(body, "[a-z]", "�")).when(doc_id % 5 == 1, vowels(body)).when(doc_id % 5 == 2, vowels(F.substring(body, 1, 60))).otherwise(body)


def one_block(body: Column, confidence: Column) -> Column:
    """A page of one paragraph."""
    return F.array(F.struct(body.alias("text"), confidence.cast("double").alias("confidence")))


DAMAGED = """case doc_id % 5 when 0 then regexp_replace(text, '[a-z]', '�', 'g') when 1 then regexp_replace(text, '[aeiou]', '�', 'g')
 when 2 then regexp_replace(substr(text, 1, 60), '[aeiou]', '�', 'g') else text end"""
BODY = "case when length(body) > 0 then body || chr(10) else '' end"
#: Macros are not allowed in the oracle, so the score's parts are a common table over (keys, body).
PARTS = f"""parts as (
  select * exclude (plain), plain, length(plain) as n,
    length(regexp_replace(plain, '[^\\x{{FFFD}}\\x{{0}}-\\x{{8}}\\x{{B}}\\x{{C}}\\x{{E}}-\\x{{1F}}\\x{{7F}}-\\x{{9F}}]', '', 'g')) as bad,
    list_filter(string_split_regex(plain, '[\\s\\x{{B}}\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '') as words
  from (select *, {BODY} as plain from src)
), rated as (
  select *, case when n > 0 then bad / n else 0.0 end as r,
    case when len(words) > 0 then len(list_filter(words, lambda x: regexp_full_match(x, '[\\p{{L}}\\p{{Nd}}\\p{{P}}\\p{{S}}]+') and not contains(x, '�'))) / len(words) else 0.0 end as w,
    least(1.0, n / 400.0) as d
  from parts
)"""
ADDITIVE = "case when n = 0 then 0.0 else 0.30 * d + 0.25 * (1 - r) + 0.30 * w + 0.15 end"


def scored_documents(spark: SparkSession, sf_dir: str, body: Column) -> DataFrame:
    docs = texts(spark, sf_dir)
    pages = docs.select("doc_id", "lang", "source", one_block(body, F.lit(None)).alias("blocks"), F.lit("native").alias("type"), F.lit(1.0).alias("confidence"))
    return quality.score_pages(pages)


@query(
    f"""with src as (select doc_id, text as body from documents), {PARTS}
select doc_id, n as char_count, round(r, 6) as replacement_ratio, round(w, 6) as word_ratio, round({ADDITIVE}, 6) as score from rated"""
)
def page_quality(spark, sf_dir):
    """The score of every document as one native page."""
    q = scored_documents(spark, sf_dir, F.col("text"))
    return q.select("doc_id", F.col("quality.char_count").alias("char_count"), *(rounded(F.col(f"quality.{c}")).alias(c) for c in ("replacement_ratio", "word_ratio", "score")))


@query(
    f"""with src as (select doc_id, {DAMAGED} as body from documents), {PARTS}
select doc_id, n as char_count, bad as damaged_chars, round(r, 6) as replacement_ratio, round({ADDITIVE}, 6) as score from rated"""
)
def replacement_ratio_degraded(spark, sf_dir):
    q = scored_documents(spark, sf_dir, damaged(F.col("text"), F.col("doc_id")))
    ratio = F.col("quality.replacement_ratio")
    return q.select("doc_id", F.col("quality.char_count").alias("char_count"), F.round(ratio * F.col("quality.char_count")).cast("long").alias("damaged_chars"), rounded(ratio).alias("replacement_ratio"), rounded(F.col("quality.score")).alias("score"))


@query(
    f"""with src as (select doc_id, lang, {DAMAGED} as body from documents), {PARTS}
select lang, count(*) as pages, count(*) filter (where {ADDITIVE} < 0.6) as escalated, round(min({ADDITIVE}), 6) as worst from rated group by lang"""
)
def escalation_by_lang(spark, sf_dir):
    """Pages that fall below the OCR threshold, by language."""
    q = scored_documents(spark, sf_dir, damaged(F.col("text"), F.col("doc_id")))
    score = F.col("quality.score")
    return q.groupBy("lang").agg(F.count("*").alias("pages"), F.count_if(score < 0.6).alias("escalated"), rounded(F.min(score)).alias("worst"))


@query(
    """with lines as (select doc_id, line, i, case when i % 4 = 3 then null else ((doc_id * 7 + i * 13) % 100) / 100.0 end as c
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)),
agg as (select doc_id, sum(length(line)) as total, sum(case when c is not null then length(line) else 0 end) as measured, sum(case when c is not null then c * length(line) else 0 end) as weighted from lines group by doc_id)
select doc_id, round(case when measured > 0 then weighted / measured end, 6) as measured_confidence, round(case when total > 0 then measured / total else 0.0 end, 6) as measured_coverage from agg"""
)
def measured_confidence(spark, sf_dir):
    """Confidence by length over the lines that have one, and the share of text that they are."""
    docs = texts(spark, sf_dir)
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(line.alias("text"), F.when(i % 4 == 3, F.lit(None)).otherwise(((F.col("doc_id") * 7 + i * 13) % 100) / 100.0).cast("double").alias("confidence")),
    )
    pages = docs.select("doc_id", lines.alias("blocks"), F.lit("scanned").alias("type"), F.lit(0.5).alias("confidence"))
    q = quality.score_pages(pages)
    return q.select("doc_id", *(rounded(F.col(f"quality.{c}")).alias(c) for c in ("measured_confidence", "measured_coverage")))


# Routing over synthetic pages: each conversation is a document, each turn a page.

TYPES = ("text_based", "scanned", "image_based", "mixed", "native")


def turn_pages(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), ((F.col("conv_id") * 3 + F.col("turn") * 7) % 5 + 1).cast("int"))
    score = ((F.col("conv_id") * 31 + F.col("turn") * 17) % 100) / 100.0
    return c.select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("number"), kind.alias("type"), score.alias("score"), "text")


PAGES = """pages as (select conv_id as document_id, cast(turn + 1 as int) as number,
  list_extract(['text_based', 'scanned', 'image_based', 'mixed', 'native'], (conv_id * 3 + turn * 7) % 5 + 1) as type, ((conv_id * 31 + turn * 17) % 100) / 100.0 as score, text from conversations)"""


@query(f"with {PAGES} select document_id, number, type, case when type in ('scanned', 'image_based') then 'ocr' else 'native' end as tier from pages")
def route_partition(spark, sf_dir):
    return routing.partition_pages(turn_pages(spark, sf_dir)).select("document_id", "number", "type", "tier")


@query(f"with {PAGES}, c as (select document_id, type, count(*) as n from pages group by all) select document_id, string_agg(type || '=' || n, ',' order by type) as page_types from c group by document_id")
def page_types(spark, sf_dir):
    got = routing.page_types(turn_pages(spark, sf_dir))
    return got.select("document_id", F.array_join(F.transform(F.map_entries("page_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("page_types"))


@query(f"with {PAGES} select distinct document_id, number from pages where type in ('scanned', 'image_based') or score < 0.6")
def ocr_worklist(spark, sf_dir):
    p = turn_pages(spark, sf_dir)
    return routing.ocr_worklist(p.where(routing.to_ocr(F.col("type"))), p.where("score < 0.6"))


@query(f"with {PAGES} select document_id, number, score, row_number() over (partition by document_id order by score, number) as rank from pages where type in ('scanned', 'image_based')")
def rank_ocr_pages(spark, sf_dir):
    p = turn_pages(spark, sf_dir).where(routing.to_ocr(F.col("type")))
    return routing.rank_pages(p, F.col("score")).select("document_id", "number", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {PAGES} select document_id, number from (select *, row_number() over (partition by document_id order by score, number) as rank from pages) where rank <= 5")
def vision_cap(spark, sf_dir):
    p = routing.rank_pages(turn_pages(spark, sf_dir), F.col("score"))
    return routing.cap_worst_first(p, 5).select("document_id", "number")


@query(f"with {PAGES} select document_id, least(count(*), 2) as kept, greatest(count(*) - 2, 0) as dropped from pages group by document_id")
def vision_cap_dropped(spark, sf_dir):
    return routing.dropped_by_cap(turn_pages(spark, sf_dir), 2)


ENGINES = (("pdf", 0), ("native", 1), ("image", 2), ("fallback", 3))


@query(
    """with c as (select doc_id as document_id, e.name as engine, e.k as reg_order,
  case when (doc_id + e.k * 3) % 4 = 0 then 0 when (doc_id + e.k) % 3 = 0 then 90 when (doc_id + e.k) % 3 = 1 then 50 else 10 end as support,
  case when (doc_id * 5 + e.k) % 7 = 0 then 'malformed' when (doc_id * 5 + e.k) % 7 = 1 then 'unsupported' end as error_kind
  from documents, (values ('pdf', 0), ('native', 1), ('image', 2), ('fallback', 3)) e(name, k)),
w as (select *, row_number() over (partition by document_id order by support desc, reg_order) as r from c where support > 0 and error_kind is null),
x as (select document_id, arg_min(error_kind, reg_order) filter (where error_kind is not null and error_kind <> 'unsupported') as e from c group by document_id)
select x.document_id, w.engine, w.support, case when w.engine is null then coalesce(x.e, 'unsupported') end as error_kind from x left join w on x.document_id = w.document_id and w.r = 1"""
)
def engine_argmax(spark, sf_dir):
    """The engine of most support; the first registered of equals."""
    d, k = F.col("document_id"), F.col("reg_order")
    support = F.when((d + k * 3) % 4 == 0, 0).when((d + k) % 3 == 0, 90).when((d + k) % 3 == 1, 50).otherwise(10)
    error = F.when((d * 5 + k) % 7 == 0, "malformed").when((d * 5 + k) % 7 == 1, "unsupported")
    engines = F.array(*(F.struct(F.lit(n).alias("engine"), F.lit(i).alias("reg_order")) for n, i in ENGINES))
    c = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.inline(engines)).withColumns({"support": support, "error_kind": error})
    return routing.choose_engine(c).select("document_id", "engine", "support", "error_kind")


@query(f"with {PAGES} select document_id, number, ntile(3) over (partition by document_id order by number) as shard from pages")
def shard_ntile(spark, sf_dir):
    return routing.shard_pages(turn_pages(spark, sf_dir), 3).select("document_id", "number", F.col("shard").cast("long").alias("shard"))


@query("with r as (select conv_id as document_id, cast(turn + 1 as int) as number, case when (conv_id + turn) % 4 = 0 then 'failed' end as error, (conv_id * 13 + turn * 29) % 1000 as duration_ms from conversations) select document_id, bool_and(error is not null) as failed, max(duration_ms) as duration_ms, count(error) as failed_shards from r group by document_id")
def shard_outcome(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    runs = c.select(F.col("conv_id").alias("document_id"), F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "failed").alias("error"), ((F.col("conv_id") * 13 + F.col("turn") * 29) % 1000).alias("duration_ms"))
    return routing.shard_outcome(runs)


@query(f"with {PAGES} select document_id, number from pages where not ((document_id * 11 + number) % 3 = 0 or number = 1)")
def cache_misses(spark, sf_dir):
    p = turn_pages(spark, sf_dir)
    kept = p.where((F.col("document_id") * 11 + F.col("number")) % 3 == 0).select("document_id", "number").union(p.where("number = 1").select("document_id", "number"))
    return routing.without(p.select("document_id", "number"), kept, ["document_id", "number"])


@query(f"with {PAGES}, r as (select *, row_number() over (partition by document_id order by score, number) as rank from pages) select document_id, number from r where rank <= 5 and not (rank = 1 and document_id % 2 = 0)")
def probe_remaining(spark, sf_dir):
    """Pages of the cap that are still to be asked for, once disagreeing probes have been read."""
    p = routing.rank_pages(turn_pages(spark, sf_dir), F.col("score"))
    return routing.without(routing.cap_worst_first(p, 5), p.where("rank = 1 and document_id % 2 = 0"), ["document_id", "number"]).select("document_id", "number")


@query(f"with {PAGES}, b as (select * from pages where score >= 0.3), o as (select document_id, number, '[ocr] ' || text as text from pages where type in ('scanned', 'image_based')) select coalesce(b.document_id, o.document_id) as document_id, coalesce(b.number, o.number) as number, case when o.number is not null then o.text else b.text end as text from b full join o on b.document_id = o.document_id and b.number = o.number")
def merge_pages(spark, sf_dir):
    """OCR pages replace native ones."""
    p = turn_pages(spark, sf_dir)
    ocr = p.where(routing.to_ocr(F.col("type"))).select("document_id", "number", F.concat(F.lit("[ocr] "), "text").alias("text"))
    return routing.merge_pages(p.where("score >= 0.3").select("document_id", "number", "text"), ocr, ["text"])


GAPS = f"""{PAGES}, kept as (select * from pages where score >= 0.4), d as (select document_id, max(number) + document_id % 2 as page_count from pages group by document_id),
  wanted as (select document_id, unnest(range(1, page_count + 1)) as number from d),
  filled as (select w.document_id, cast(w.number as int) as number, coalesce(k.type, 'scanned') as type, k.number is null as gap from wanted w left join kept k on w.document_id = k.document_id and w.number = k.number)"""


def filled_pages(spark, sf_dir) -> DataFrame:
    p = turn_pages(spark, sf_dir)
    d = p.groupBy("document_id").agg((F.max("number") + F.col("document_id") % 2).cast("int").alias("page_count"))
    kept = p.where("score >= 0.4").select("document_id", "number", "type", F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("reasons"))
    return routing.fill_gaps(kept, d, ["type", "confidence", "reasons"])


@query(f"with {GAPS} select document_id, number, type, case when gap then 'not_extracted' else '' end as reasons from filled")
def gap_fill(spark, sf_dir):
    return filled_pages(spark, sf_dir).select("document_id", "number", "type", F.array_join("reasons", ",").alias("reasons"))


@query(f"with {GAPS} select document_id, min(number) as number, 'not_extracted' as reason from filled where gap group by document_id")
def incomplete_docs(spark, sf_dir):
    return routing.incomplete_documents(filled_pages(spark, sf_dir))


@query(f"with {GAPS}, bad as (select distinct document_id from filled where gap) select document_id from d where document_id % 3 <> 0 and document_id not in (select document_id from bad)")
def stored_documents_reused(spark, sf_dir):
    """The whole-document short cut: same versions, both views, no page owed."""
    p = turn_pages(spark, sf_dir)
    docs = p.select("document_id").distinct().select("document_id", F.lit("1.0").alias("schema_version"), F.when(F.col("document_id") % 3 == 0, "1").otherwise("2").alias("pipeline_version"), F.lit(True).alias("has_json"), F.lit(True).alias("has_markdown"))
    return routing.reusable_documents(docs, filled_pages(spark, sf_dir))


@query(
    """select doc_id, coalesce(case when doc_id % 2 = 0 then nullif(trim(source), '') end, lang) as title, case when doc_id % 3 = 0 then 'first' else 'second' end as both,
  cast(case when doc_id % 3 = 0 then 3 else 2 end as bigint) as n_custom from documents"""
)
def metadata_merge(spark, sf_dir):
    """Inspection's metadata wins, extraction's fills blanks; settings are added where absent."""
    d = read(spark, sf_dir, "documents")
    blank = F.lit(None).cast("string")
    one = lambda title, custom: F.struct(title.alias("title"), blank.alias("author"), blank.alias("language"), F.lit(1).alias("page_count"), custom.alias("custom"))
    a = one(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit("  ")), F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("k"), F.lit("first"), F.lit("a"), F.lit("1"))))
    b = one(F.col("lang"), F.create_map(F.lit("k"), F.lit("second"), F.lit("b"), F.lit("2")))
    m = d.select("doc_id", routing.merge_metadata(a, b).alias("m"))
    return m.select("doc_id", F.col("m.title").alias("title"), F.col("m.custom")["k"].alias("both"), F.size("m.custom").cast("long").alias("n_custom"))


# Identity, formats and names.


@query("select sha256(text) as sha256, min(doc_id) as doc_id, count(*) as copies, 'blobs/' || substr(sha256(text), 1, 2) || '/' || sha256(text) as path from documents group by sha256(text)")
def content_address(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id")
    return d.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).withColumn("path", text.blob_path(F.col("sha256")))


@query(
    """select doc_id, sha256(text) || '|2|native@1|' || (doc_id % 7 + 1) || case when doc_id % 3 = 0 then '' else '|' || substr(sha256('dpi' || chr(0) || '200' || chr(0) || 'tier' || chr(0) || lang || chr(0)), 1, 16) end as key from documents"""
)
def cache_key(spark, sf_dir):
    config = F.when(F.col("doc_id") % 3 != 0, F.create_map(F.lit("tier"), F.col("lang"), F.lit("dpi"), F.lit("200")))
    key = text.cache_key(F.sha2(F.col("text").cast("binary"), 256), F.lit("2"), F.lit("native"), F.lit("1"), (F.col("doc_id") % 7 + 1), config)
    return read(spark, sf_dir, "documents").select("doc_id", key.alias("key"))


NAMES = ("a.PDF", "b.md", "c", "d.docx", "e.unknown", "dir.x/f", "g.csv", "h.jpeg")


@query(
    """select page_id, case page_id % 8 when 0 then 'application/pdf' when 1 then 'text/markdown' when 3 then 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
  when 6 then 'text/csv' when 7 then 'image/jpeg' else case when page_id % 3 = 0 then 'text/x-declared' else 'application/octet-stream' end end as media_type,
  case page_id % 8 when 1 then 'markdown' when 3 then 'word' when 6 then 'csv' end as format from pages"""
)
def media_type(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("page_id") % 8 + 1).cast("int"))
    declared = F.when(F.col("page_id") % 3 == 0, "text/x-declared").when(F.col("page_id") % 3 == 1, "application/octet-stream").otherwise("")
    return read(spark, sf_dir, "pages").select("page_id", text.media_type(name, declared).alias("media_type"), text.detect_format(F.lit("plain").cast("binary"), name).alias("format"))


HEADS = {"jpeg": "FFD8FFE0", "png": "89504E470D0A1A0A00", "gif": "47494638396100", "tiff": "4D4D002A00", "webp": "524946460000000057454250", "bmp": "424D" + "00" * 24, "none": "424D0000", "pdf": "255044462D312E37"}


@query(
    """with h as (select event_id, event_id % 8 as k from events) select event_id, case k when 0 then 'jpeg' when 1 then 'png' when 2 then 'gif' when 3 then 'tiff' when 4 then 'webp' when 5 then 'bmp' end as image_format,
  case when k = 7 then 'pdf' when k < 6 then 'image' end as format from h"""
)
def magic_sniff(spark, sf_dir):
    heads = F.array(*(F.unhex(F.lit(h)) for h in HEADS.values()))
    content = F.element_at(heads, (F.col("event_id") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", text.image_format(content).alias("image_format"), text.detect_format(content, F.lit("x")).alias("format"))


@query("select doc_id, doc_id % 4 = 0 as valid from documents")
def valid_document_id(spark, sf_dir):
    sha = F.sha2(F.col("text").cast("binary"), 256)
    made = F.when(F.col("doc_id") % 4 == 0, sha).when(F.col("doc_id") % 4 == 1, F.upper(F.concat(F.lit("a"), F.substring(sha, 2, 63)))).when(F.col("doc_id") % 4 == 2, F.substring(sha, 1, 63)).otherwise(F.concat(sha, F.lit("\n")))
    return read(spark, sf_dir, "documents").select("doc_id", text.valid_document_id(made).alias("valid"))


@query("select page_id, case page_id % 6 when 0 then 'etc' when 1 then '_' when 2 then 'b.md' when 3 then 'x' when 4 then '_' else regexp_extract(rtrim(url, '/'), '[^/]*$') end as segment from pages")
def safe_segment(spark, sf_dir):
    k = F.col("page_id") % 6
    raw = F.when(k == 0, "../../etc").when(k == 1, "a/..").when(k == 2, "dir\\b.md").when(k == 3, "a/b/../../x/").when(k == 4, "").otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", text.safe_segment(raw).alias("segment"))


@query(r"""with t as (select doc_id, regexp_replace(source || '_[' || lang || ']|`' || text, '([\\`*_\[\]<|])', '\\\1', 'g') as escaped, trim(regexp_replace(text, '[\s\x{B}\x{85}\p{Z}]+', ' ', 'g')) as collapsed from documents)
  select doc_id, sha256(escaped) as escaped_sha256, length(escaped) as escaped_chars, sha256(collapsed) as collapsed_sha256, length(collapsed) as collapsed_chars, doc_id % 5 as longest_run from t""")
def text_functions(spark, sf_dir):
    """escape_markdown and collapse of every whole text, as digests and lengths, and the longest run of backticks of a short one."""
    runs = F.concat(F.lit("x"), F.repeat(F.lit("`"), (F.col("doc_id") % 5).cast("int")), F.lit("y"), F.when(F.col("doc_id") % 5 > 0, "`").otherwise(""))
    d = read(spark, sf_dir, "documents")
    t = d.select("doc_id", *whole_text_functions(), text.longest_backtick_run(runs).cast("long").alias("longest_run"))
    return t.select("doc_id", *_digests(), "longest_run")


def whole_text_functions() -> list[Column]:
    return [text.escape_markdown(F.concat("source", F.lit("_["), "lang", F.lit("]|`"), "text")).alias("escaped"), text.collapse(F.col("text")).alias("collapsed")]


def _digests() -> list[Column]:
    return [c for n in ("escaped", "collapsed") for c in (F.sha2(F.col(n).cast("binary"), 256).alias(f"{n}_sha256"), F.length(n).cast("long").alias(f"{n}_chars"))]


@query(r"""with t as (select doc_id, regexp_replace(source || '_[' || lang || ']|`' || text, '([\\`*_\[\]<|])', '\\\1', 'g') as escaped, trim(regexp_replace(text, '[\s\x{B}\x{85}\p{Z}]+', ' ', 'g')) as collapsed from documents)
  select doc_id, sha256(escaped) as escaped_sha256, length(escaped) as escaped_chars, sha256(collapsed) as collapsed_sha256, length(collapsed) as collapsed_chars from t""")
def text_functions_whole(spark, sf_dir):
    """The same without the runs, under the name that earlier figures have."""
    return read(spark, sf_dir, "documents").select("doc_id", *whole_text_functions()).select("doc_id", *_digests())


@query("select event_id, case event_id % 5 when 0 then 415 when 1 then 422 when 2 then 422 when 3 then 413 else 500 end as status, case event_id % 5 when 1 then 'unsupported' when 2 then 'malformed' when 3 then 'encrypted' when 4 then 'internal' end as exit_kind, greatest(72, least(600, event_id % 1000)) as dpi from events")
def status_mapping(spark, sf_dir):
    k = F.col("event_id") % 5
    kind = F.when(k == 0, "unsupported").when(k == 1, "malformed").when(k == 2, "encrypted").when(k == 3, "too_large").otherwise("other")
    code = F.when(k == 0, 0).when(k == 1, 2).when(k == 2, 3).when(k == 3, 4).otherwise(1)
    return read(spark, sf_dir, "events").select("event_id", text.http_status(kind).alias("status"), text.exit_error_kind(code).alias("exit_kind"), text.clamp_dpi(F.col("event_id") % 1000).cast("long").alias("dpi"))


# Parsing.


def broken_up(body: Column) -> Column:
    """A text with blank lines between its lines, trailing white space, an indent and an empty part."""
    return F.concat(F.regexp_replace(body, "\n", "  \n\n  "), F.lit("\n\n \n\nlast \t\nline"))


@query(
    r"""with p as (select doc_id, unnest(string_split(regexp_replace(text, '\n', '  ' || chr(10) || chr(10) || '  ', 'g') || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || 'last ' || chr(9) || chr(10) || 'line', chr(10) || chr(10))) as part,
  generate_subscripts(string_split(regexp_replace(text, '\n', '  ' || chr(10) || chr(10) || '  ', 'g') || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || 'last ' || chr(9) || chr(10) || 'line', chr(10) || chr(10)), 1) as i from documents),
t as (select doc_id, i, array_to_string(list_transform(string_split(part, chr(10)), lambda x: regexp_replace(x, '[\s\x{B}\x{85}\p{Z}]+$', '')), chr(10)) as text from p)
select doc_id, row_number() over (partition by doc_id order by i) - 1 as position, text from t where regexp_matches(text, '[^\s\x{B}\x{85}\p{Z}]')"""
)
def text_paragraphs(spark, sf_dir):
    d = texts(spark, sf_dir)
    return d.select("doc_id", F.posexplode(text.paragraphs(broken_up(F.col("text")))).alias("position", "text")).withColumn("position", F.col("position").cast("long"))


def markdown_sources(spark, sf_dir) -> DataFrame:
    """Each document as a Markdown file: a title, a list and a table of its own words, and its text."""
    d = texts(spark, sf_dir)
    words = F.slice(text.tokens(F.col("text")), 1, 6)
    body = F.concat(
        F.lit("# "), "source", F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n"), F.lit("\n\n- "), F.array_join(words, "\n- "), F.lit("\n\n| word | length |\n|---|---|\n"),
        F.array_join(F.transform(words, lambda w: F.concat(F.lit("| "), F.translate(w, "|", ""), F.lit(" | "), F.length(w).cast("string"), F.lit(" |"))), "\n"), F.lit("\n"),
    )
    return store.from_table(d.select("doc_id", body.alias("body")), "doc_id", "body", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))


@query()
def md_blocks(spark, sf_dir):
    """Every block of every document's Markdown, flat."""
    src = markdown_sources(spark, sf_dir).dropDuplicates(["document_id"])
    got = NativeEngine().extract(src.withColumn("numbers", F.lit(None).cast("array<int>")))
    return got.select("document_id", F.inline("blocks")).select("document_id", "block_id", F.array_join(F.transform("path", lambda p: F.lpad(p.cast("string"), 4, "0")), ".").alias("path"), "type", "level", "text", "row", "col")


@query()
def markdown_view(spark, sf_dir):
    """Markdown read and written again: one view for each document."""
    src = markdown_sources(spark, sf_dir).dropDuplicates(["document_id"])
    pages = NativeEngine().extract(src.withColumn("numbers", F.lit(None).cast("array<int>"))).select("document_id", "number", "kind", "width", "height", "type", "confidence", "reasons", "blocks", "items", "cells")
    return render_documents(src.select("document_id", F.lit("1.0").alias("schema_version")), pages).select("document_id", "markdown", F.length("json").alias("json_chars"))


#: Paragraphs of plain text as the engine reads them: parts between blank lines, lines without white space at their ends, blank parts left out.
READ_PAGES = r"""docs as (select sha256(text) as document_id, min(doc_id) as doc_id, min(text) as text from documents group by sha256(text)),
told as (select document_id, doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: array_to_string(list_transform(string_split(case when suffix(p, chr(10)) then p[:-2] else p end, chr(10)), lambda x: regexp_replace(x, '[\s\x{B}\x{1C}-\x{1F}\x{85}\p{Z}]+$', '')), chr(10))),
  lambda p: regexp_matches(p, '[^\s\x{B}\x{1C}-\x{1F}\x{85}\p{Z}]')) as told from docs),
src as (select document_id, doc_id, len(told) as n_blocks, array_to_string(told, chr(10)) as body from told)"""
STUB = "'[ocr-stub] page 1 of ' || doc_id || '.txt was routed to OCR and not actually read. Configure a real OCR engine to extract this page.'"


@query(
    f"""with {READ_PAGES}, {PARTS}, first as (select document_id, doc_id, n_blocks, {ADDITIVE} as score from rated),
again as (select document_id, length({STUB}) + 1 as m, score, n_blocks, score < 0.6 as low from first)
select document_id, 1 as number, case when low then 'scanned' else 'native' end as type, case when low then 1 else n_blocks end as n_blocks,
  round(case when low then 0.10 * (0.30 * least(1.0, m / 400.0) + 0.25 + 0.30) / 0.85 else score end, 6) as score, low as escalated from again"""
)
def process_documents(spark, sf_dir):
    """The whole pipeline over every document as a text file: pages with their scores. Equal texts are one document, named by the smallest id."""
    d = texts(spark, sf_dir).groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    src = store.from_table(d, "doc_id", "text", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).drop("key")
    pages = router.process(src, [NativeEngine(), ImageEngine()], StubOcr()).pages
    return pages.select("document_id", "number", "type", F.size("blocks").alias("n_blocks"), rounded(F.col("quality.score")).alias("score"), F.col("quality.escalated").alias("escalated"))


@query(
    """with d as (select distinct sha256(text) as document_id from documents), v as (select document_id, unnest(case substr(document_id, 1, 1) when '0' then ['confidence'] when '1' then ['kind', 'geometry'] when '2' then ['heading_level']
  when '3' then ['duplicate_block'] when '4' then ['schema_version'] when '5' then ['page_count'] else [] end) as violation from d) select document_id, violation from v"""
)
def invariant_violations(spark, sf_dir):
    """Broken invariants of the pages that the pipeline makes of every document: none but those that are planted by the first digit of its hash."""
    d = texts(spark, sf_dir)
    src = store.from_table(d, "doc_id", "text", F.lit("x.txt")).drop("key").dropDuplicates(["document_id"])
    result = router.process(src, [NativeEngine(), PdfEngine(), ImageEngine()], StubOcr())
    plant = lambda digit, broken, column: F.when(F.substring("document_id", 1, 1) == digit, broken).otherwise(column)
    first = lambda change: F.transform("blocks", lambda b, i: F.when(i == 0, change(b)).otherwise(b))
    pages = result.pages.withColumns(
        {
            "confidence": plant("0", F.lit(2.0), F.col("confidence")),
            "kind": plant("1", F.lit("odd"), F.col("kind")),
            "width": plant("1", F.lit(1.0), F.col("width")),
            "blocks": plant("2", first(lambda b: b.withField("type", F.lit("heading")).withField("level", F.lit(0))), plant("3", F.concat("blocks", F.slice("blocks", 1, 1)), F.col("blocks"))),
        }
    )
    documents = result.documents.withColumns({"schema_version": plant("4", F.lit("0"), F.col("schema_version")), "metadata": plant("5", F.col("metadata").withField("page_count", F.lit(7)), F.col("metadata"))})
    return checks.page_violations(pages).select("document_id", "violation").union(checks.document_violations(documents, pages).select("document_id", "violation")).distinct()


@query("select conv_id as document_id, string_agg(distinct case when turn % 3 = 0 then 'ocr' when turn % 3 = 1 then 'pdf' else 'vision' end, ',' order by case when turn % 3 = 0 then 'ocr' when turn % 3 = 1 then 'pdf' else 'vision' end) as engines, count(*) as pages from conversations group by conv_id")
def engines_used(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    name = F.when(F.col("turn") % 3 == 0, "ocr").when(F.col("turn") % 3 == 1, "pdf").otherwise("vision")
    pages = c.select(F.col("conv_id").alias("document_id"), F.array(F.struct(F.struct(name.alias("engine")).alias("provenance"))).alias("blocks"))
    n = c.groupBy(F.col("conv_id").alias("document_id")).agg(F.count("*").alias("pages"))
    return checks.engines_used(pages).select("document_id", F.array_join("engines", ",").alias("engines")).join(n, "document_id")


@query("select doc_id, case when doc_id % 4 = 0 then 200 when doc_id % 4 = 1 then 200 else 415 end as status, case when doc_id % 4 = 0 then 'native' when doc_id % 4 = 1 then 'image' end as engine from documents")
def inspect_documents(spark, sf_dir):
    """Which engine knows a file, before any is read: Markdown, an image under any name, unknown, and an old binary format."""
    d = texts(spark, sf_dir)
    k = F.col("doc_id") % 4
    name = F.when(k == 0, "x.md").when(k == 3, "x.doc").otherwise("x.unknown")
    content = F.when(k == 1, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.col("text").cast("binary"))
    src = d.select(F.col("doc_id").alias("document_id"), name.alias("filename"), F.lit(None).cast("string").alias("media_type"), F.lit("").alias("sha256"), F.lit(0).cast("long").alias("size_bytes"), content.alias("content"))
    seen = router.inspect(src.withColumn("document_id", F.col("document_id").cast("string")), [NativeEngine(), ImageEngine()])
    return seen.select(F.col("document_id").cast("long").alias("doc_id"), F.when(F.col("engine").isNull(), text.http_status(F.col("error_kind"))).otherwise(200).alias("status"), "engine")


@query()
def layout_pages(spark, sf_dir):
    """Pages of the layout tier: the orders of a customer as regions, every other one a table."""
    r, lines = regions_and_lines(spark, sf_dir)
    html = F.concat(F.lit("<table><tr><th>order</th></tr><tr><td>"), F.col("region_id").cast("string"), F.lit("</td></tr></table>"))
    r = r.withColumns({"content": F.when(F.col("label") == "table", html).otherwise(F.concat(F.lit("order "), F.col("region_id").cast("string"))), "ord": F.col("region_id").cast("int")})
    sizes = r.select("document_id", "page").distinct().withColumns({"scale": F.lit(1.0), "width_pt": F.lit(612.0), "height_pt": F.lit(792.0)})
    pages = quality.score_pages(tiers.layout_pages(r, lines, sizes, "layout", "1"))
    return pages.select("document_id", "number", "confidence", F.size("blocks").alias("n_blocks"), F.size("cells").alias("n_cells"), rounded(F.col("quality.score")).alias("score"))


def order_lines(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))


def order_tables(spark, sf_dir) -> DataFrame:
    """Cells of tables: an order is a table, its line items are rows of three columns."""
    line = order_lines(spark, sf_dir)
    cells = F.array(*(F.struct(F.lit(k).alias("col"), c.cast("string").alias("text")) for k, c in enumerate((F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")))))
    return line.select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").cast("int").alias("row"), F.inline(cells))


@query("with c as (select l_orderkey as table_id, l_linenumber as row, unnest([0, 1, 2]) as col, unnest([l_partkey, l_suppkey, l_linenumber]) as v from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem group by all)) select table_id, round(avg(case when (v + row) % 4 = 0 then 0.0 when row = 3 then 0.0 else 1.0 end), 6) as cell_accuracy from c group by table_id")
def cell_accuracy(spark, sf_dir):
    """Tables against themselves with some cells misread and one row lost."""
    want = order_tables(spark, sf_dir)
    got = want.where("row <> 3").withColumn("text", F.when((F.col("text").cast("long") + F.col("row")) % 4 == 0, F.concat("text", F.lit("?"))).otherwise(F.concat(F.lit(" "), "text", F.lit(" "))))
    return metrics.cell_accuracy(want, got, ["table_id"]).withColumn("cell_accuracy", rounded(F.col("cell_accuracy")))


@query(
    """with l as (select l_orderkey, l_linenumber, min(l_partkey) as p, min(l_suppkey) as s from lineitem group by all), r as (select *, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as row, l_linenumber % 2 = 1 as wide from l)
select l_orderkey as table_id, row, unnest([0, 1, 2]::bigint[]) as col, unnest([cast(p as varchar), case when wide then null else cast(s as varchar) end, case when wide then null else 'x & y' end]) as text, unnest([null, case when wide then 0 end, case when wide then 0 end]::bigint[]) as covered_col from r"""
)
def table_grid(spark, sf_dir):
    """Recognised HTML of orders as tables: every other row is one cell over three columns."""
    line = order_lines(spark, sf_dir)
    cell = lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    row = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("<tr><td colspan='3'>"), F.col("l_partkey").cast("string"), F.lit("</td>"))).otherwise(F.concat(F.lit("<tr>"), cell(F.col("l_partkey")), cell(F.col("l_suppkey")), F.lit("<td>x &amp;<br/> y</td>")))
    per = line.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(row, F.lit("</tr>")).alias("html")))).alias("rows"))
    html = per.select("table_id", F.concat(F.lit("<table>"), F.array_join(F.transform("rows", lambda r: r["html"]), ""), F.lit("</table>")).alias("html"))
    got = tables.cells_of(html)
    return got.select("table_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text", F.col("covered_col").cast("long").alias("covered_col"))


# Metrics.


@query()
def disagreement(spark, sf_dir):
    """How far two readings of every text are apart, whatever its letters; the reference's own bound of MAX_COMPARED characters is part of the measure."""
    a, b = F.col("text"), F.regexp_replace("text", "[aeiou]", "")
    return texts(spark, sf_dir).select("doc_id", rounded(metrics.disagreement(a, b)).alias("disagreement"))


@query()
def disagreement_whole(spark, sf_dir):
    """The same with the character error rate, which has no bound: every whole text."""
    a, b = F.col("text"), F.regexp_replace("text", "[aeiou]", "")
    return texts(spark, sf_dir).select("doc_id", rounded(metrics.disagreement(a, b)).alias("disagreement"), rounded(metrics.cer(a, b)).alias("cer"))


@query("select item_id, round(cast(2 as double) / (len(regexp_split_to_array(trim(text), '\\s+')) + 1), 6) as wer from benchmark where trim(text) <> ''")
def wer(spark, sf_dir):
    """Benchmark texts read with their first word doubled and a word lost that stood behind them."""
    b = read(spark, sf_dir, "benchmark").where(F.trim("text") != "")
    first = text.tokens(F.col("text"))[0]
    want = F.concat("text", F.lit(" zzz"))
    got = F.concat(first, F.lit("# "), first, F.lit(" "), F.array_join(F.filter(text.tokens(F.col("text")), lambda _, i: i > 0), " "))
    return b.select("item_id", rounded(metrics.wer(want, got)).alias("wer"))


@query("with p as (select conv_id, turn, case when turn % 3 = 2 then 1.0 when turn % 3 = 1 then 0.0 else case when text = '' then 1.0 else least(1.0, 1.0 / length(trim(regexp_replace(text, '[\\s\\x{B}\\x{85}\\p{Z}]+', ' ', 'g')))) end end as cer from conversations) select conv_id as document, round(avg(cer), 6) as cer from p group by conv_id")
def corpus_scores(spark, sf_dir):
    """Documents against truth: every third page is missing, every third has one character too many."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("number"), "text")
    got = c.where("number % 3 <> 2").withColumn("text", F.when(F.col("number") % 3 == 0, F.concat(F.lit("x"), F.ltrim("text"))).otherwise(F.col("text")))
    return metrics.score_documents(c, got).select("document", rounded(F.col("cer")).alias("cer"))


@query("""with d as (select doc_id, case when doc_id % 11 <> 0 then (doc_id % 97) / 100.0 end as cer, case when doc_id % 3 = 0 then (doc_id % 50) / 50.0 end as cells, n_chars % 1000 as wall_ms from documents where doc_id % 13 <> 0)
select count(*) as documents, round(avg(cer), 6) as mean_cer, round(avg(cells), 6) as mean_cell_accuracy, round(sum(wall_ms) / 1000.0, 6) as wall_seconds from d""")
def corpus_summary(spark, sf_dir):
    """Means and total time over scored documents; every thirteenth has an error."""
    k = F.col("doc_id")
    d = read(spark, sf_dir, "documents").select(
        F.when(k % 11 != 0, (k % 97) / 100.0).alias("cer"), F.when(k % 3 == 0, (k % 50) / 50.0).alias("cell_accuracy"), (F.col("n_chars") % 1000).alias("wall_ms"), F.when(k % 13 == 0, "internal").alias("error")
    )
    got = metrics.corpus_summary(d)
    return got.select("documents", *(rounded(F.col(c)).alias(c) for c in ("mean_cer", "mean_cell_accuracy", "wall_seconds")))


# Geometry.


def glyphs(spark, sf_dir) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s")).select(
        F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page"), (F.col("p") % 500).cast("double").alias("x"), (F.col("s") % 3).cast("double").alias("y"),
        F.when(F.col("p") % 2 == 0, (F.col("p") % 40).cast("double")).otherwise(0.0).alias("width"), F.lit(8.0).alias("height"), F.lit(10.0).alias("font_size"), F.col("l_linenumber").cast("string").alias("text"),
    )


GLYPHS = """g as (select l_orderkey as document_id, cast(p % 500 as double) as x, cast(s % 3 as double) as y, case when p % 2 = 0 then cast(p % 40 as double) else 0.0 end as width, 8.0 as height, 10.0 as font_size, cast(l_linenumber as varchar) as text
  from (select l_orderkey, l_linenumber, min(l_partkey) as p, min(l_suppkey) as s from lineitem group by all))"""


@query(
    f"""with {GLYPHS}, n as (select *, lead(x) over w as nx, lead(y) over w as ny from g window w as (partition by document_id order by y desc, x, text))
select document_id, text, round(case when width >= 0.5 then width when abs(ny - y) < 1 and nx > x then nx - x else length(text) * font_size * 0.5 end, 6) as effective_width, width < 0.5 as estimated from n"""
)
def effective_widths(spark, sf_dir):
    return layout.effective_widths(glyphs(spark, sf_dir)).select("document_id", "text", rounded(F.col("effective_width")).alias("effective_width"), "estimated")


@query(f"with {GLYPHS} select document_id, min(x) as x, min(y) as y, max(x + width) - min(x) as width, max(y + height) - min(y) as height from g group by document_id having max(x + width) > min(x)")
def bbox_union(spark, sf_dir):
    return layout.bbox_union(glyphs(spark, sf_dir), ["document_id"]).where("bbox is not null").select("document_id", "bbox.*")


REGIONS = """regions as (select o_custkey as document_id, o_orderkey as region_id, cast(o_orderkey % 300 as double) as x0, cast(o_orderkey % 200 as double) as y0, cast(o_orderkey % 300 + 120 as double) as x1, cast(o_orderkey % 200 + 90 as double) as y1, (o_orderkey % 10) / 10.0 as det_score,
  case when o_orderkey % 2 = 0 then 'table' else 'text' end as label from orders),
lines as (select o_custkey as document_id, repeat('x', cast(o_orderkey % 9 as int)) as text, (o_orderkey % 100) / 100.0 as confidence, cast(o_orderkey % 310 as double) as x0, cast(o_orderkey % 250 as double) as y0, cast(o_orderkey % 310 + 40 as double) as x1, cast(o_orderkey % 250 + 10 as double) as y1 from orders)"""


def regions_and_lines(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    box = lambda x, w, y, h: [c.cast("double").alias(n) for n, c in (("x0", k % x), ("y0", k % y), ("x1", k % x + w), ("y1", k % y + h))]
    doc = [F.col("o_custkey").alias("document_id"), F.lit(1).alias("page")]
    r = o.select(*doc, k.alias("region_id"), *box(300, 120, 200, 90), ((k % 10) / 10.0).alias("det_score"), F.when(k % 2 == 0, "table").otherwise("text").alias("label"))
    lines = o.select(*doc, F.repeat(F.lit("x"), (k % 9).cast("int")).alias("text"), ((k % 100) / 100.0).alias("confidence"), *box(310, 40, 250, 10), k.alias("position"))
    return r, lines


@query(
    f"""with {REGIONS}, j as (select r.region_id, sum(length(l.text)) as n, sum(l.confidence * length(l.text)) as cn from regions r join lines l on r.document_id = l.document_id and (l.x0 + l.x1) / 2 between r.x0 and r.x1 and (l.y0 + l.y1) / 2 between r.y0 and r.y1 group by r.region_id)
select r.document_id, r.region_id, round(coalesce(case when n > 0 then cn / n end, det_score), 6) as confidence from regions r left join j on r.region_id = j.region_id"""
)
def region_confidence(spark, sf_dir):
    r, lines = regions_and_lines(spark, sf_dir)
    return layout.region_confidence(r, lines).select("document_id", "region_id", rounded(F.col("confidence")).alias("confidence"))


@query(
    f"""with {REGIONS}, b as (select document_id, label, region_id as position, x0 + 3 as x0, y0 - 2 as y0, x1 + region_id % 5 as x1, y1 as y1, det_score as score from regions where region_id % 3 <> 0)
select r.document_id, r.region_id, arg_min(b.score, abs(r.x0 - b.x0) + abs(r.y0 - b.y0) + abs(r.x1 - b.x1) + abs(r.y1 - b.y1) + b.position / 1e12) as det_score from regions r left join b on r.document_id = b.document_id and r.label = b.label group by r.document_id, r.region_id"""
)
def detection_score(spark, sf_dir):
    """The nearest detected box of the same label."""
    r, _ = regions_and_lines(spark, sf_dir)
    k = F.col("region_id")
    b = r.where(k % 3 != 0).select("document_id", "page", "label", k.alias("position"), (F.col("x0") + 3).alias("x0"), (F.col("y0") - 2).alias("y0"), (F.col("x1") + k % 5).alias("x1"), "y1", F.col("det_score").alias("score"))
    return layout.detection_score(r.drop("det_score"), b).select("document_id", "region_id", "det_score")


@query(
    f"""with {REGIONS}, o as (select *, case when document_id % 2 = 0 or region_id % 5 <> 0 then region_id % 7 end as ord from regions), k as (select *, count(ord) over (partition by document_id) = count(*) over (partition by document_id) as known from o)
select document_id, region_id, row_number() over (partition by document_id order by case when known then ord else region_id end, region_id) as place, case when region_id % 4 = 0 then 'heading' when region_id % 4 = 1 then 'table' when region_id % 4 = 2 then 'image' else 'paragraph' end as type, case when region_id % 4 = 0 then 1 end as level from k"""
)
def reading_order(spark, sf_dir):
    r, _ = regions_and_lines(spark, sf_dir)
    k = F.col("region_id")
    label = F.when(k % 4 == 0, "doc_title").when(k % 4 == 1, "table").when(k % 4 == 2, "seal").otherwise("anything")
    r = r.withColumns({"ord": F.when((F.col("document_id") % 2 == 0) | (k % 5 != 0), k % 7), "position": k, "label": label})
    return layout.reading_order(r).select("document_id", "region_id", F.col("place").cast("long").alias("place"), layout.layout_type(F.col("label")).alias("type"), layout.layout_level(F.col("label")).alias("level"))


@query(
    f"""with {REGIONS} select region_id, round(x0 / 1000 * 612, 3) as x, round(792 - y1 / 1000 * 792, 3) as y, round((x1 - x0) / 1000 * 612, 3) as w, round((y1 - y0) / 1000 * 792, 3) as h from regions"""
)
def vision_boxes(spark, sf_dir):
    r, _ = regions_and_lines(spark, sf_dir)
    box = layout.vision_bbox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(612.0), F.lit(792.0))
    return r.select("region_id", box.alias("b")).select("region_id", F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.width").alias("w"), F.col("b.height").alias("h"))


#: The rules of grouping as a fold, a step for each line of a page: tails are the last lines of the paragraphs so far, went says which each line joined.
GROUPED = """with recursive l as (
  select o_custkey as document_id, o_orderkey as position, case when o_orderkey % 11 = 0 then '  ' else ' w' || o_orderkey || ' ' end as text, (o_orderkey % 97) / 97e0 as confidence,
    (o_orderkey % 310) / 2.0 as x0, (o_orderkey % 250) / 4.0 as y0, (o_orderkey % 310) / 2.0 + 20 + o_orderkey % 50 as x1, (o_orderkey % 250) / 4.0 + 6 + o_orderkey % 5 as y1 from orders
), s as (
  select *, row_number() over (partition by document_id order by round_even(y0, 0), x0, position) as i, median(y1 - y0) over (partition by document_id) as h from l
), r(document_id, i, tails, went) as (
  select distinct document_id, 0::bigint, []::struct(x0 double, x1 double, y1 double)[], []::bigint[] from s
  union all
  select document_id, i, case when best is null then list_append(tails, own) else list_transform(tails, lambda t, j: case when j = best then own else t end) end, list_append(went, coalesce(best, len(tails) + 1))
  from (select r.document_id, s.i, r.tails, r.went, {'x0': s.x0, 'x1': s.x1, 'y1': s.y1} as own,
      list_sort(list_filter(list_transform(r.tails, lambda t, j: {'gap': case when s.y0 - t.y1 <= 0.6 * s.h and s.y0 - t.y1 >= -s.h and least(t.x1, s.x1) - greatest(t.x0, s.x0) > 0
        and (least(t.x1, s.x1) - greatest(t.x0, s.x0)) / least(t.x1 - t.x0, s.x1 - s.x0) >= 0.15 then s.y0 - t.y1 end, 'j': j}), lambda c: c.gap is not null))[1].j as best
    from r join s on s.document_id = r.document_id and s.i = r.i + 1)
), last as (select document_id, arg_max(went, i) as went from r group by document_id),
p as (
  select s.document_id, last.went[s.i] as p, string_agg(trim(s.text), ' ' order by s.i) filter (where trim(s.text) <> '') as text, sum(s.confidence * length(s.text)) / sum(length(s.text)) as confidence,
    min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n_lines from s join last on s.document_id = last.document_id group by all
)
select document_id, 1 as page, row_number() over (partition by document_id order by round_even(y0, 0), x0, p) as place, coalesce(text, '') as text, round(confidence, 6) as confidence, x0, y0, x1, y1, n_lines from p"""


@query(GROUPED)
def group_lines(spark, sf_dir):
    """Paragraphs of synthetic OCR lines, a page for each customer: its orders are words somewhere on it."""
    k = F.col("o_orderkey")
    x, y = (k % 310) / 2.0, (k % 250) / 4.0
    said = F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" w"), k.cast("string"), F.lit(" ")))
    lines = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document_id"), F.lit(1).alias("page"), k.alias("position"), said.alias("text"), ((k % 97) / 97.0).alias("confidence"),
        x.alias("x0"), y.alias("y0"), (x + 20 + k % 50).alias("x1"), (y + 6 + k % 5).alias("y1"),
    )
    got = layout.group_lines(lines)
    return got.withColumns({"confidence": rounded(F.col("confidence")), "place": F.col("place").cast("long"), "n_lines": F.col("n_lines").cast("long")})


@query(
    r"""with l as (select doc_id, i, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
  w as (select doc_id, i, unnest(words) as word, generate_subscripts(words, 1) as k from (select doc_id, i, list_filter(string_split_regex('§' || i || '§ ' || line, '[\s\x{B}\x{85}\p{Z}]+'), lambda x: x <> '') as words from l))
select doc_id as document_id, i as block_id, 0.0 as x, cast(-10 * i as double) as y, max(30.0 * (k - 1) + 5 * length(word)) as width, 8.0 as height from w group by all"""
)
def attach_boxes(spark, sf_dir):
    """The lines of every document as blocks, each found again among the words of its page."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("i"), F.concat(F.lit("§"), (i + 1).cast("string"), F.lit("§ "), x).alias("line")))
    lines = texts(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.inline(line))
    words = lines.select("document_id", "page", "i", F.posexplode(text.tokens(F.col("line"))).alias("k", "text"))
    place = F.col("i").cast("long") * 1_000_000_000 + F.col("k")
    glyphs = words.select("document_id", "page", place.alias("position"), "text", (30.0 * F.col("k")).alias("x"), (-10.0 * F.col("i")).alias("y"), (5.0 * F.length("text")).alias("width"), F.lit(8.0).alias("height"))
    blocks = lines.select("document_id", "page", F.col("i").cast("string").alias("block_id"), F.col("i").alias("place"), F.lit("paragraph").alias("type"), F.col("line").alias("text"))
    return layout.attach_boxes(blocks, glyphs).select("document_id", F.col("block_id").cast("long").alias("block_id"), "bbox.*")


# Store and jobs.


@query("select user_id as document_id, max(ts) as modified_at from events group by user_id having max(ts) < timestamp '2024-01-30 12:00:00' - interval 1 hour")
def ttl_sweep(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sha256")).agg(F.max("ts").alias("modified_at"))
    gone = store.expired(e, 3600, F.lit("2024-01-30 12:00:00").cast("timestamp"))
    return e.join(gone, "sha256").select(F.col("sha256").alias("document_id"), "modified_at")


@query("select event_id, row_number() over (order by ts desc, event_id) as place from events")
def jobs_newest_first(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return jobs.newest_first(e).select(F.col("id").alias("event_id"), "place")


STATES = ("queued", "inspecting", "done", "failed")


@query("with j as (select user_id, event_id, ts, list_extract(['queued', 'inspecting', 'done', 'failed'], event_id % 4 + 1) as state, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) select state, count(*) as n, state in ('done', 'failed') as terminal from j where r = 1 group by state")
def job_states(spark, sf_dir):
    """The last job of each user's document, by state."""
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % 4 + 1).cast("int"))
    j = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.col("ts").alias("created_at"), state.alias("state"))
    return jobs.by_state(jobs.latest(j)).withColumn("terminal", jobs.is_terminal(F.col("state")))


@query("select date_trunc('day', ts) as start, event_type as state, count(*) as n from events group by all")
def jobs_by_day(spark, sf_dir):
    from ..streaming.ingest import job_counts

    return job_counts(read(spark, sf_dir, "events"), "1 day", state="event_type", at="ts").select("start", F.col("event_type").alias("state"), "n")


@query("with s as (select distinct sha256(text) as sha256 from documents where doc_id % 2 = 0) select d.doc_id, case when s.sha256 is null then 'not_found' end as error_kind from documents d left join s on sha256(d.text) = s.sha256")
def extract_by_digest(spark, sf_dir):
    """Requests by digest against the blobs that are stored."""
    d = read(spark, sf_dir, "documents")
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("sha256")
    stored = d.where("doc_id % 2 = 0").select(sha, F.lit(b"").alias("content"), F.lit(0).alias("size_bytes")).dropDuplicates(["sha256"])
    return store.resolve(d.select("doc_id", sha), stored).select("doc_id", "error_kind")


@query("select doc_id from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 10 = 3)")
def delete_documents(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return store.remove(d, d.where("doc_id % 10 = 3"), "sha256").select("doc_id")


@query("select doc_id, sha256(source) as blob_ref, 'a' || doc_id % 3 as asset_id, case doc_id % 3 when 0 then '.png' when 1 then '.jpg' else '.bin' end as extension from documents where doc_id % 5 <> 0")
def assets(spark, sf_dir):
    """Assets by the digest of their bytes; those without bytes are left out."""
    d = read(spark, sf_dir, "documents")
    media = F.when(F.col("doc_id") % 3 == 0, "image/png").when(F.col("doc_id") % 3 == 1, "image/jpeg").otherwise("application/x")
    rows = d.select("doc_id", F.concat(F.lit("a"), (F.col("doc_id") % 3).cast("string")).alias("asset_id"), media.alias("media_type"), F.when(F.col("doc_id") % 5 != 0, F.col("source").cast("binary")).alias("content"), F.lit(None).cast("string").alias("blob_ref"))
    return store.commit_assets(rows).select("doc_id", "blob_ref", "asset_id", text.asset_extension(F.col("media_type")).alias("extension"))


__all__ = ["BLOCK", "ORACLES", "QUERIES"]

"""Text, naming and format functions; every one is a Column expression that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; the plain \s of Java is ASCII.
SPACE = r"(?U)\s+"


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, SPACE, " "), F.lit(" "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def escape_markdown(text: Column) -> Column:
    r"""A backslash before each of \ ` * _ [ ] < |."""
    return F.regexp_replace(text, r"([\\`*_\[\]<|])", r"\\$1")


def longest_backtick_run(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Plain text to paragraphs: parts between literal blank lines, each line without trailing white space, blank parts dropped."""
    lines = lambda part: F.split(F.regexp_replace(part, r"\r?\n\z", ""), r"\r?\n")
    tidy = lambda part: F.array_join(F.transform(lines(part), lambda x: F.regexp_replace(x, r"(?U)\s+\z", "")), "\n")
    return F.filter(F.transform(F.split(text, "\n\n"), tidy), lambda p: F.length(collapse(p)) > 0)


# Names and identities.


def valid_document_id(col: Column) -> Column:
    return F.coalesce(F.length(col) == 64, F.lit(False)) & F.coalesce(col.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def safe_segment(name: Column) -> Column:
    """The last segment of a path once `..`, `.` and separators have been resolved; `_` where none is left."""
    parts = F.filter(F.split(F.translate(name, "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    # A `..` removes the segment before it, so the last segment is the last one not removed by those behind it.
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda seen, p: F.when(p == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.concat(seen, F.array(p))),
    )
    return F.when(F.size(kept) > 0, F.element_at(kept, -1)).otherwise(F.lit("_"))


def blob_path(digest: Column) -> Column:
    """Where a blob lies under the store: two hex digits make the folder."""
    return F.concat(F.lit("blobs/"), F.when(F.length(digest) < 2, F.lit("__")).otherwise(F.substring(digest, 1, 2)), F.lit("/"), digest)


def extension(filename: Column) -> Column:
    """Lower-case extension without its dot, of the last path segment; null where there is none."""
    last = F.substring_index(filename, "/", -1)
    return F.nullif(F.lower(F.regexp_extract(last, r"\.([^.]*)\z", 1)), F.lit(""))


def detection_name(filename: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(filename), F.lit("")), path)


# Extensions and what they are.
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "txt": "text/plain",
    "csv": "text/csv",
    "html": "text/html",
    "json": "application/json",
    "xml": "text/xml",
    "rtf": "application/rtf",
    "epub": "application/epub+zip",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "bmp": "image/bmp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "webp": "image/webp",
    "svg": "image/svg+xml",
}
# Extensions of formats that are told by name, and the label of each.
FORMATS = {
    "md": "markdown",
    "markdown": "markdown",
    "txt": "text",
    "text": "text",
    "log": "text",
    "csv": "csv",
    "doc": "word",
    "docx": "word",
    "odt": "odt",
    "ppt": "powerpoint",
    "pptx": "powerpoint",
    "odp": "odp",
    "xls": "excel",
    "xlsx": "excel",
    "ods": "ods",
    "rtf": "rtf",
    "epub": "epub",
}
# File extensions of assets.
ASSET_EXTENSIONS = {
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/gif": ".gif",
    "image/bmp": ".bmp",
    "image/tiff": ".tiff",
    "image/webp": ".webp",
    "image/svg+xml": ".svg",
    "image/x-emf": ".emf",
    "image/emf": ".emf",
    "image/x-wmf": ".wmf",
    "image/wmf": ".wmf",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of key, null where the table lacks it."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def media_type(filename: Column, declared: Column) -> Column:
    """What the extension says, else what was declared unless that says nothing."""
    octets = F.lit("application/octet-stream")
    return F.coalesce(lookup(MEDIA_TYPES, extension(filename)), F.nullif(declared, F.lit("")), octets)


def asset_extension(media: Column) -> Column:
    return F.coalesce(lookup(ASSET_EXTENSIONS, media), F.lit(".bin"))


def _starts(content: Column, hex_digits: str, at: int = 1) -> Column:
    n = len(hex_digits) // 2
    return F.substring(content, at, n) == F.expr(f"X'{hex_digits}'")


def is_pdf(content: Column) -> Column:
    return _starts(content, "255044462D")


def image_format(content: Column) -> Column:
    """The image format that the first bytes tell, or null. A name or a declared type tells nothing here."""
    riff = _starts(content, "52494646") & _starts(content, "57454250", 9)
    bitmap = (F.octet_length(content) >= 26) & _starts(content, "424D") & _starts(content, "00000000", 7)
    return (
        F.when(_starts(content, "FFD8FF"), "jpeg")
        .when(_starts(content, "89504E470D0A1A0A"), "png")
        .when(_starts(content, "474946383761") | _starts(content, "474946383961"), "gif")
        .when(_starts(content, "49492A00") | _starts(content, "4D4D002A"), "tiff")
        .when(riff, "webp")
        .when(bitmap, "bmp")
    )


def detect_format(content: Column, name: Column) -> Column:
    """pdf by signature, an image format as image, rtf by signature, else what the extension says; null is unsupported."""
    return F.when(is_pdf(content), "pdf").when(_starts(content, "7B5C727466"), "rtf").when(image_format(content).isNotNull(), "image").otherwise(lookup(FORMATS, extension(name)))


def cache_key(document_hash: Column, pipeline: Column, engine: Column, version: Column, page: Column, config: Column) -> Column:
    """hash|pipeline|engine@version|page, and 16 hex digits of the sorted settings where there are any."""
    pairs = F.transform(F.array_sort(F.map_entries(config)), lambda e: F.concat(e["key"], F.lit("\0"), e["value"], F.lit("\0")))
    settings = F.substring(F.sha2(F.array_join(pairs, "").cast("binary"), 256), 1, 16)
    base = F.concat_ws("|", document_hash, pipeline, F.concat(engine, F.lit("@"), version), page.cast("string"))
    return F.when(F.coalesce(F.size(config), F.lit(0)) > 0, F.concat_ws("|", base, settings)).otherwise(base)


def http_status(error_kind: Column) -> Column:
    """The status that an error of this kind answers with."""
    return (
        F.when(error_kind == "unsupported", 415)
        .when(error_kind.isin("malformed", "encrypted"), 422)
        .when(error_kind == "too_large", 413)
        .when(error_kind == "queue_full", 503)
        .when(error_kind == "timeout", 504)
        .when(error_kind == "not_found", 404)
        .when(error_kind == "bad_request", 400)
        .otherwise(500)
    )


def exit_error_kind(code: Column) -> Column:
    """The kind of a parser process's exit code; null for success."""
    return F.when(code == 0, F.lit(None)).when(code == 2, "unsupported").when(code == 3, "malformed").when(code == 4, "encrypted").otherwise("internal")


def service_error_kind(kind: Column, status: Column) -> Column:
    """The kind of a service's answer: what it says where that is known, else what its status means."""
    return (
        F.when(kind.isin("unsupported", "encrypted", "malformed"), kind)
        .when(kind == "resource_limit", "malformed")
        .when(status == 415, "unsupported")
        .when(status.isin(413, 422), "malformed")
        .otherwise("internal")
    )


def page_numbers(csv: Column) -> Column:
    """A list of page numbers, from 1; null (all pages) for an empty list. Any part that is no such number makes it invalid: an empty array."""
    parts = F.transform(F.filter(F.split(csv, ","), lambda p: F.trim(p) != ""), lambda p: F.trim(p).try_cast("int"))
    bad = F.exists(parts, lambda n: n.isNull() | (n < 1))
    return F.when(F.trim(F.coalesce(csv, F.lit(""))) == "", F.lit(None).cast("array<int>")).when(bad, F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(parts)))


def clamp_dpi(dpi: Column) -> Column:
    return F.greatest(F.lit(72), F.least(F.lit(600), dpi))


def fit_pixels(width: Column, height: Column, budget: int = 4_000_000) -> Column:
    """struct(width, height): scaled down to the budget of pixels, at least one each."""
    scale = F.sqrt(F.lit(float(budget)) / (width.cast("double") * height))
    size = lambda x: F.when(width.cast("long") * height <= budget, x.cast("int")).otherwise(F.greatest(F.lit(1), F.floor(x * scale).cast("int")))
    return F.struct(size(width).alias("width"), size(height).alias("height"))

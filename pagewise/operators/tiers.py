"""Pages of the recognition tiers: layout regions and vision blocks to page rows, as joins and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse
from ..schemas import BLOCK, CELL, ITEM
from .layout import layout_level, layout_type, raster_bbox, reading_order, region_confidence, vision_bbox, vision_level, vision_type
from .tables import table_grid

ON = ["document_id", "page"]
#: Where a remote vision backend runs; others have none.
REMOTE_BACKENDS = {"hybrid": "hybrid-http-client", "vlm": "vlm-http-client"}


def remote_backend(backend: str) -> str:
    for start, remote in REMOTE_BACKENDS.items():
        if backend.startswith(start):
            return remote
    raise ValueError(f"{backend} has no remote form")


def vision_blocks(entries: DataFrame) -> DataFrame:
    """entries (document_id, page, position, label, text, table_body, box array, text_level string) as blocks in reading order.

    A table's text is its body. Blocks without a label, a box of four or any text go; corners are put in
    order; a level that is no number is none. place is by the rounded top, then the left.
    """
    body = F.when(F.col("label") == "table", F.col("table_body")).otherwise(F.col("text"))
    kept = entries.withColumn("text", F.coalesce(body, F.lit(""))).where((F.length(F.trim("label")) > 0) & (F.size("box") >= 4) & (F.length(collapse(F.col("text"))) > 0))
    box = F.col("box")
    sized = kept.select(*ON, "position", "label", "text", F.least(box[0], box[2]).alias("x0"), F.least(box[1], box[3]).alias("y0"), F.greatest(box[0], box[2]).alias("x1"), F.greatest(box[1], box[3]).alias("y1"), F.col("text_level").try_cast("int").alias("text_level"))
    return sized.withColumn("place", F.row_number().over(Window.partitionBy(*ON).orderBy(F.bround("y0"), "x0", "position")))


def _block(**values: Column) -> Column:
    """A block struct in which everything that is not named is null."""
    return F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in BLOCK.fields))


def _table_parts(block_id: Column, provenance: Column, path: Column) -> tuple[Column, Column]:
    """Cell blocks and cell rows of the grid column."""
    slots = F.col("grid.slots")
    told = F.filter(slots, lambda s: s["covered_row"].isNull() & (s["text"] != ""))
    inside = F.transform(
        told,
        lambda s: _block(
            block_id=F.concat(block_id, F.lit("-r"), s["row"].cast("string"), F.lit("c"), s["col"].cast("string")), path=F.concat(path, F.array(s["row"], s["col"], F.lit(0))), parent_id=block_id, slot=F.lit("cell"),
            row=s["row"], col=s["col"], type=F.lit("paragraph"), text=s["text"], provenance=provenance,
        ),
    )
    cells = F.transform(slots, lambda s: F.struct(*((block_id if f.name == "table_id" else s[f.name]).cast(f.dataType).alias(f.name) for f in CELL.fields)))
    return inside, cells


def _pages(blocks: DataFrame, sizes: DataFrame, reasons: Column, empty_reasons: Column, confidence: Column) -> DataFrame:
    """Page rows of block rows (place, blocks array, cells array); a page without blocks is there too."""
    gathered = blocks.groupBy(*ON).agg(F.array_sort(F.collect_list(F.struct("place", "blocks", "cells"))).alias("g"), confidence.alias("confidence"))
    flat = lambda name, kind: F.coalesce(F.flatten(F.transform("g", lambda x: x[name])), F.array().cast(kind))
    joined = sizes.join(gathered, ON, "left")
    return joined.select(
        "document_id", F.col("page").alias("number"), F.lit("paginated").alias("kind"), F.bround("width_pt", 3).alias("width"), F.bround("height_pt", 3).alias("height"), F.lit("scanned").alias("type"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(F.col("g").isNull(), empty_reasons).otherwise(reasons).alias("reasons"),
        flat("blocks", f"array<{BLOCK.simpleString()}>").alias("blocks"), F.array().cast(f"array<{ITEM.simpleString()}>").alias("items"), flat("cells", f"array<{CELL.simpleString()}>").alias("cells"),
    )


def _words(*words: str) -> Column:
    return F.array(*map(F.lit, words))


def layout_pages(regions: DataFrame, lines: DataFrame, sizes: DataFrame, engine: str, version: str) -> DataFrame:
    """Pages of layout analysis: regions (document_id, page, region_id, label, content, x0..y1, ord, det_score), OCR lines, sizes (document_id, page, scale, width_pt, height_pt).

    Tables whose HTML has no rows go, and text regions without text. A region's confidence is that of
    the lines inside it; the page's is the mean of its blocks'.
    """
    ordered = reading_order(regions.withColumn("position", F.col("region_id")))
    known = region_confidence(ordered, lines).join(sizes, ON).withColumn("type", layout_type(F.col("label")))
    # The grid function runs on tables alone: a condition around it would not keep it from other rows.
    tables = known.where("type = 'table'").withColumn("grid", table_grid("content")).where(F.size("grid.slots") > 0)
    others = known.where("type <> 'table'").withColumn("grid", F.lit(None).cast(tables.schema["grid"].dataType))
    others = others.where((F.col("type") == "image") | (F.length(collapse(F.coalesce("content", F.lit("")))) > 0))
    both = tables.unionByName(others)
    name = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-ly"), (F.col("place") - 1).cast("string"))
    provenance = F.struct(F.lit(engine).alias("engine"), F.lit(version).alias("engine_version"), F.concat(F.lit("layout:"), "label").alias("method"))
    path = F.array((F.col("place") - 1).cast("int"))
    is_table, is_image = F.col("type") == "table", F.col("type") == "image"
    own = _block(
        block_id=name, path=path, slot=F.lit("page"), type=F.col("type"), text=F.when(~is_table & ~is_image, collapse(F.col("content"))), level=layout_level(F.col("label")), alt=F.when(is_image, F.col("label")),
        header_rows=F.col("grid.header_rows"), table_kind=F.when(is_table, "data"), bbox=raster_bbox(*map(F.col, ("x0", "y0", "x1", "y1")), F.col("scale"), F.col("height_pt")), confidence=F.bround("confidence", 6), provenance=provenance,
    )
    inside, cells = _table_parts(name, provenance, path)
    rows = both.select(*ON, "place", F.when(is_table, F.concat(F.array(own), inside)).otherwise(F.array(own)).alias("blocks"), F.when(is_table, cells).otherwise(F.array().cast(f"array<{CELL.simpleString()}>")).alias("cells"), F.bround("confidence", 6).alias("c"))
    return _pages(rows, sizes, _words("ocr", "layout_analysis"), _words("ocr", "no_text_found"), F.bround(F.avg("c"), 6))


def vision_pages(blocks: DataFrame, sizes: DataFrame, engine: str, version: str, backend: str) -> DataFrame:
    """Pages of vision blocks (vision_blocks()): no block has a confidence, a page's is 1 if it has blocks.

    A table of one column is text in a narrow column: a paragraph for each row, without a box.
    """
    known = blocks.join(sizes, ON).withColumn("type", vision_type(F.col("label"), F.col("text_level")))
    tables = known.where("type = 'table'").withColumn("grid", table_grid("text")).where(F.size("grid.slots") > 0)
    others = known.where("type <> 'table'").withColumn("grid", F.lit(None).cast(tables.schema["grid"].dataType))
    both = tables.unionByName(others)
    name = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-vis"), (F.col("place") - 1).cast("string"))
    provenance = F.struct(F.lit(engine).alias("engine"), F.lit(version).alias("engine_version"), F.concat(F.lit(f"{backend}:"), "label").alias("method"))
    at = (F.col("place") - 1).cast("int")
    path = F.array(at)
    is_table, is_image = F.col("type") == "table", F.col("type") == "image"
    narrow = F.coalesce(is_table & (F.array_max(F.transform("grid.slots", lambda s: s["col"])) == 0), F.lit(False))
    own = _block(
        block_id=name, path=path, slot=F.lit("page"), type=F.col("type"), text=F.when(~is_table & ~is_image, collapse(F.col("text"))), level=vision_level(F.col("label"), F.col("text_level")), alt=F.when(is_image, F.col("label")),
        header_rows=F.col("grid.header_rows"), table_kind=F.when(is_table, "data"), bbox=vision_bbox(*map(F.col, ("x0", "y0", "x1", "y1")), F.col("width_pt"), F.col("height_pt")), provenance=provenance,
    )
    inside, cells = _table_parts(name, provenance, path)
    told = F.filter("grid.slots", lambda s: s["covered_row"].isNull() & (s["text"] != ""))
    flat = F.transform(told, lambda s: _block(block_id=F.concat(name, F.lit("-r"), s["row"].cast("string")), path=F.array(at, s["row"]), slot=F.lit("page"), type=F.lit("paragraph"), text=s["text"], provenance=provenance))
    none = F.array().cast(f"array<{CELL.simpleString()}>")
    rows = both.select(*ON, "place", F.when(narrow, flat).when(is_table, F.concat(F.array(own), inside)).otherwise(F.array(own)).alias("blocks"), F.when(is_table & ~narrow, cells).otherwise(none).alias("cells"))
    return _pages(rows.where(F.size("blocks") > 0), sizes, _words("ocr", "vision"), _words("ocr", "vision", "no_text_found"), F.lit(1.0))

"""Parsed-page files: pages and their blocks, and units of text, tables and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import document_key, unit_key
from ..operators.chunking import joined_text, segment_offsets

#: A page's number and block texts come from models, so they are read as texts; content may be an object.
BLOCK = "struct<block_id:string,type:string,content:string,references:array<string>,caption:string,csv_data:string,data:string,summary:string,image_type:string>"
PAGES = f"array<struct<page_number:string,content_blocks:array<{BLOCK}>>>"
PAPER = f"struct<paper_metadata:struct<title:string,journal:string,year:string,doi:string>,pages:{PAGES}>"
PAGE = f"struct<page_number:string,content_blocks:array<{BLOCK}>>"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """filename and body of all JSON files under a path, each read whole."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("body"))


def pages_of(files: DataFrame) -> DataFrame:
    """filename, title, position, page_number, blocks of every page.

    A file is an array of pages, an object with ``pages``, or one page; what is
    not JSON or has no page is left out.
    """
    body = F.col("body")
    pages = (
        F.when(F.try_parse_json(body).isNull(), F.lit(None))
        .when(F.trim(body).startswith("["), F.from_json(body, PAGES))
        .when(F.get_json_object(body, "$.pages").isNotNull(), F.from_json(body, PAPER)["pages"])
        .otherwise(F.array(F.from_json(body, PAGE)))
    )
    rows = files.select("filename", F.get_json_object(body, "$.paper_metadata.title").alias("title"), F.posexplode(pages).alias("position", "page"))
    return rows.select("filename", "title", "position", F.col("page.page_number").alias("page_number"), F.col("page.content_blocks").alias("blocks")).where("blocks is not null")


def blocks_of(pages: DataFrame) -> DataFrame:
    """One row per block, in reading order (place)."""
    rows = pages.select("filename", "title", "position", "page_number", F.posexplode("blocks").alias("at", "b"))
    return rows.select("filename", "title", "page_number", (F.col("position") * 100_000 + F.col("at")).alias("place"), "b.*")


def documents(blocks: DataFrame) -> DataFrame:
    """Documents of text blocks: document_id, filename, text, segments (position, content, start, end)."""
    text = blocks.where("type = 'text_block' and content is not null")
    segments = segment_offsets(text, "filename", "place", "content")
    return joined_text(segments, "filename", "place").withColumn("document_id", document_key(F.col("filename")))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _labelled(label: str, value: Column) -> Column:
    """``label: value``, null where the value is blank (concat_ws leaves nulls out)."""
    return F.when(F.trim(value) != "", F.concat(F.lit(f"{label}: "), value))


def table_units(blocks: DataFrame) -> DataFrame:
    """Text units of table blocks with data: CSV text first, else two rows or more."""
    rows = blocks.where("type = 'table'")
    grid = F.from_json("data", "array<array<string>>")
    data = F.when(F.trim("csv_data") != "", F.col("csv_data")).when(F.size(grid) >= 2, F.array_join(F.transform(grid, lambda r: F.array_join(r, ",")), "\n")).when(grid.isNull() & (F.trim("data") != ""), F.col("data"))
    rows = rows.withColumn("body", data).where("body is not null")
    text = _lines(_labelled("Caption", F.col("caption")), _labelled("Summary", F.col("summary")), F.concat(F.lit("Data:\n"), "body"))
    return _units(rows, "table", text)


def image_units(blocks: DataFrame) -> DataFrame:
    """Text units of image blocks with content; what is told depends on the image's type."""
    field = lambda name: F.get_json_object("content", f"$.{name}")
    rows = blocks.where("type = 'image' and content is not null and trim(content) not in ('', '{}')")
    chart = F.col("image_type") == "chart"
    told = F.when(chart, _lines(_labelled("Title", field("title")), _labelled("Trend", field("trend")))).otherwise(_labelled("Description", field("description")))
    text = _lines(_labelled("Caption", F.col("caption")), _labelled("Image Type", F.col("image_type")), F.nullif(told, F.lit("")), F.concat(F.lit("Full Content: "), "content"))
    return _units(rows, "image", text)


def image_prompt(image_type: Column, content: Column) -> Column:
    """Context of an image for a prompt, by its type."""
    field = lambda name: F.get_json_object(content, f"$.{name}")
    chart = _lines(_labelled("Title", field("title")), _labelled("X axis", field("x_axis_label")), _labelled("Y axis", field("y_axis_label")), _labelled("Legend", field("legend")), _labelled("Trend", field("trend")), _labelled("Data points", field("data_points")))
    other = _lines(_labelled("Description", field("description")), _labelled("Text", field("ocr_text")))
    return F.when(image_type == "chart", chart).otherwise(other)


def table_prompt(blocks: DataFrame) -> DataFrame:
    """Context of a table for a prompt: the raw block as JSON."""
    return blocks.where("type = 'table'").select("filename", "block_id", F.to_json(F.struct("block_id", "type", "caption", "csv_data", "data", "summary")).alias("prompt"))


def _units(rows: DataFrame, kind: str, text: Column) -> DataFrame:
    document = document_key(F.col("filename"))
    block = F.to_json(F.struct("block_id", "type", "caption", "csv_data", "data", "summary", "content", "image_type"))
    return rows.select(
        unit_key(document, kind, F.coalesce("block_id", F.lit("")), block).alias("id"), document.alias("document_id"), text.alias("text"), F.lit(kind).alias("unit_type"),
        F.col("filename").alias("source_filename"), F.array("page_number").alias("pages"), F.array("block_id").alias("blocks"), "image_type",
    )

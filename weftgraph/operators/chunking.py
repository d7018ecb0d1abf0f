"""Text chunking with overlap, and where each chunk comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import chunk_key
from .ordered import running_total

SEPARATOR = "\n\n"


def chunk_windows(length: Column, size: int, overlap: int) -> Column:
    """Array of (chunk, start, end) over a text of that many characters.

    Chunks start every size - overlap characters; the first that reaches the
    end is the last.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((length - overlap) / F.lit(float(step)))).cast("int")
    one = lambda k: F.struct(k.alias("chunk"), (k * step).alias("start"), F.least(k * step + size, length).alias("end"))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<struct<chunk:int,start:int,end:int>>"))


def chunk_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """One row per chunk: key, chunk, start, end, text, chunk_id. Null and empty texts have none."""
    rows = docs.select(F.col(key), F.col(text).alias("__text"), F.explode(chunk_windows(F.length(text), size, overlap)).alias("w"))
    part = F.substring(F.col("__text"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))
    rows = rows.select(key, "w.chunk", "w.start", "w.end", part.alias("text"))
    return rows.withColumn("chunk_id", chunk_key(F.col(key).cast("string"), F.col("chunk"), F.col("text")))


def segment_offsets(blocks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Start and end of each non-blank stripped block in its document's joined text."""
    rows = blocks.withColumn("content", F.regexp_replace(F.col(text), r"^\s+|\s+$", "")).where(F.length("content") > 0)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content") + len(SEPARATOR)).over(before), F.lit(0)).cast("int")
    return rows.select(key, order, "content", start.alias("start"), (start + F.length("content")).alias("end"))


def joined_text(segments: DataFrame, key: str, order: str) -> DataFrame:
    """The document text of the segments, in order, and the segments themselves."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("position"), "content", "start", "end")))
    rows = segments.groupBy(key).agg(parts.alias("segments"))
    return rows.select(key, F.array_join(F.transform("segments", lambda s: s["content"]), SEPARATOR).alias("text"), "segments")


def chunk_sources(documents: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """Chunks of joined documents with the positions of the segments they touch."""
    rows = documents.select(key, "text", "segments", F.explode(chunk_windows(F.length("text"), size, overlap)).alias("w"))
    touched = F.filter("segments", lambda s: (s["start"] < F.col("w.end")) & (s["end"] > F.col("w.start")))
    positions = F.array_sort(F.array_distinct(F.transform(touched, lambda s: s["position"])))
    part = F.substring(F.col("text"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))
    return rows.select(key, "w.chunk", "w.start", "w.end", positions.alias("sources"), part.alias("text"))


def overlapping_segments(chunks: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Chunks and segments of one document whose ranges meet, as a join."""
    c, s = chunks.alias("c"), segments.alias("s")
    meet = (F.col(f"c.{key}") == F.col(f"s.{key}")) & (F.col("s.start") < F.col("c.end")) & (F.col("s.end") > F.col("c.start"))
    return c.join(s, meet).select(F.col(f"c.{key}"), "c.chunk", F.col("s.start").alias("segment_start"), F.col("s.end").alias("segment_end"))


def batch_numbers(rows: DataFrame, order: list[Column], size: int, name: str = "batch") -> DataFrame:
    """Number rows in a total order and cut them into batches of a fixed size."""
    numbered = running_total(rows, order, F.lit(1), "position").withColumn("position", F.col("position") - 1)
    return numbered.withColumn(name, F.floor(F.col("position") / size))

"""Citations: page and block ranges, and rewriting of marks in answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = r"\[Data:\s*[^(\]]+\(([^)]+)\)\]|\[cite:\s*([^\]]+)\]"
LOCAL = r"[（(][ER]\d+[）)]"


def page_range(pages: Column) -> Column:
    """Page n, Page a-b for consecutive ones, else Pages a, b, c."""
    p = F.array_sort(F.array_distinct(F.filter(pages, lambda x: x.isNotNull())))
    first, last = F.array_min(p).cast("string"), F.array_max(p).cast("string")
    return (
        F.when(F.coalesce(F.size(p), F.lit(0)) < 1, "Page unknown")
        .when(F.size(p) == 1, F.concat(F.lit("Page "), first))
        .when(F.array_max(p) - F.array_min(p) + 1 == F.size(p), F.concat(F.lit("Page "), first, F.lit("-"), last))
        .otherwise(F.concat(F.lit("Pages "), F.array_join(F.transform(p, lambda x: x.cast("string")), ", ")))
    )


def block_range(blocks: Column) -> Column:
    """Block b; first~last for consecutive blocks of a page or for more than three; else a list."""
    b = F.array_distinct(F.filter(blocks, lambda x: x.isNotNull()))
    prefixes = F.array_distinct(F.transform(b, lambda x: F.regexp_extract(x, r"^(page_\d+_block_)\d+", 1)))
    numbers = F.transform(b, lambda x: F.regexp_extract(x, r"^page_\d+_block_(\d+)", 1).try_cast("int"))
    follow = F.forall(F.sequence(F.lit(1), F.size(b) - 1), lambda i: F.get(numbers, i) - F.get(numbers, i - 1) == 1)
    run = F.when((F.size(prefixes) == 1) & (F.get(prefixes, F.lit(0)) != "") & (F.size(b) > 1), follow).otherwise(F.lit(False))
    span = F.concat(F.get(b, F.lit(0)), F.lit("~"), F.element_at(b, -1))
    return (
        F.when(F.coalesce(F.size(b), F.lit(0)) < 1, "Block unknown")
        .when(F.size(b) == 1, F.concat(F.lit("Block "), F.get(b, F.lit(0))))
        .when(F.coalesce(run, F.lit(False)), F.concat(F.lit("Block "), span))
        .when(F.size(b) <= 3, F.concat(F.lit("Blocks "), F.array_join(b, ", ")))
        .otherwise(F.concat(F.lit("Blocks "), span))
    )


def cited_ids(text: Column) -> Column:
    """Distinct ids of all citation marks of a text."""
    both = F.concat(F.regexp_extract_all(text, F.lit(MARK), F.lit(1)), F.regexp_extract_all(text, F.lit(MARK), F.lit(2)))
    parts = F.flatten(F.transform(both, lambda x: F.split(x, ",")))
    return F.array_distinct(F.filter(F.transform(parts, F.trim), lambda x: x != ""))


def rewrite_citations(answers: DataFrame, sources: DataFrame, key: str = "id", text: str = "answer") -> DataFrame:
    """Replace citation marks by their sources, drop local ids, collapse spaces.

    sources: chunk_id, chunk_type, source_filename, pages, blocks, journal,
    year. Marks are numbered, their ids joined to the sources, and the text put
    together again from the parts between them.
    """
    rows = answers.select(key, F.col(text).alias("t"))
    rows = rows.withColumn("gaps", F.split("t", MARK, -1)).withColumn("marks", F.transform(F.regexp_extract_all("t", F.lit(MARK), F.lit(0)), lambda m: F.regexp_extract(m, r"^\[Data:[^(]+\(([^)]+)\)\]$|^\[cite:\s*([^\]]+)\]$", 1)))
    second = F.transform(F.regexp_extract_all("t", F.lit(MARK), F.lit(0)), lambda m: F.regexp_extract(m, r"^\[cite:\s*([^\]]+)\]$", 1))
    rows = rows.withColumn("marks", F.zip_with("marks", second, lambda a, b: F.when(a != "", a).otherwise(b)))
    ids = rows.select(key, F.posexplode("marks").alias("mark", "list")).select(key, "mark", F.posexplode(F.split("list", ",")).alias("at", "raw")).withColumn("raw", F.trim("raw")).where("raw <> ''")
    ids = ids.withColumn("chunk_id", F.coalesce(F.nullif(F.regexp_extract("raw", r"^(chunk-[a-f0-9]+)", 1), F.lit("")), "raw"))
    found = ids.join(sources, "chunk_id", "left").withColumn("is_community", F.col("chunk_id").rlike(r"^\d+(_\d+)+$"))
    name = F.replace(F.coalesce("source_filename", F.lit("unknown")), F.lit(".json"), F.lit(""))
    kind = F.when(F.col("is_community"), 0).when(F.col("chunk_type") == "abstract", 1).when(F.col("source_filename").isNotNull(), 2)
    found = found.withColumn("kind", kind).where("kind is not null").withColumn("file", F.when(F.col("kind") == 2, name).otherwise(F.col("at").cast("string")))
    grouped = found.groupBy(key, "mark", "kind", "file").agg(
        F.min("at").alias("at"), F.min_by("chunk_id", "at").alias("chunk"), F.min_by(name, "at").alias("name"), F.min_by(F.coalesce("journal", F.lit("unknown")), "at").alias("journal"), F.min_by(F.coalesce("year", F.lit("unknown")), "at").alias("year"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "pages"))), lambda x: F.coalesce(x["pages"], F.array().cast("array<int>")))).alias("pages"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "blocks"))), lambda x: F.coalesce(x["blocks"], F.array().cast("array<string>")))).alias("blocks"),
    )
    part = F.when(F.col("kind") == 0, F.concat(F.lit("community "), "chunk")).when(F.col("kind") == 1, F.concat_ws(", ", "name", "journal", "year")).otherwise(F.concat_ws(" ", "name", page_range(F.col("pages")), block_range(F.col("blocks"))))
    built = grouped.groupBy(key, "mark").agg(F.concat(F.lit("[source: "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "at", part.alias("p")))), lambda x: x["p"]), "; "), F.lit("]")).alias("s"))
    texts = built.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("mark", "s"))).alias("m"))
    out = rows.join(texts, key, "left")
    body = F.concat(F.get("gaps", F.lit(0)), F.array_join(F.transform("marks", lambda _, i: F.concat(F.coalesce(F.col("m")[i], F.lit("")), F.get("gaps", i + 1))), ""))
    return out.select(key, tidy(F.when(F.size("marks") > 0, body).otherwise(F.col("t"))).alias(text))


def tidy(text: Column) -> Column:
    """Drop local ids like (E1) and collapse runs of white space."""
    return F.regexp_replace(F.regexp_replace(text, LOCAL, ""), r"\s{2,}", " ")


def global_ids(text: Column, names: Column) -> Column:
    """Local ids inside [Data: …] marks replaced by what names maps them to, the longest first."""
    keys = F.array_sort(F.map_keys(names), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    mark = r"\[Data:[^\]]*\]"
    one = lambda m: F.aggregate(keys, m, lambda t, k: F.regexp_replace(t, F.concat(F.lit(r"\b"), k, F.lit(r"\b")), F.regexp_replace(names[k], r"([\\$])", r"\\$1")))
    marks, gaps = F.regexp_extract_all(text, F.lit(mark), F.lit(0)), F.split(text, mark, -1)
    return F.concat(F.get(gaps, F.lit(0)), F.array_join(F.transform(marks, lambda m, i: F.concat(one(m), F.get(gaps, i + 1))), ""))

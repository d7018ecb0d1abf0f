"""Unit files, abstracts, graphs, reports, questions, answers and scores."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import document_key, unit_key

UNIT = "id string, document_id string, text string, metadata struct<chunk_index:int,source_filename:string,pages:array<string>,blocks:array<string>,type:string,image_type:string,journal:string,year:string,author:string,DOI:string>"


def units(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """Unit files by type (text, abstract, image, table) as one table; missing files count as empty."""
    out = spark.createDataFrame([], UNIT).withColumn("unit_type", F.lit(""))
    for kind, path in files.items():
        try:
            part = spark.read.schema(UNIT).json(path)
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            continue
        out = out.unionByName(part.withColumn("unit_type", F.lit(kind)))
    return out


def unit_sources(rows: DataFrame) -> DataFrame:
    """Where each chunk comes from, for citations."""
    m = F.col("metadata")
    return rows.select(F.col("id").alias("chunk_id"), F.col("unit_type").alias("chunk_type"), m["source_filename"].alias("source_filename"), F.transform(m["pages"], lambda p: p.try_cast("int")).alias("pages"), m["blocks"].alias("blocks"), m["journal"].alias("journal"), m["year"].alias("year"))


#: Fields of an abstract table by the parts of a header that name them, by precedence.
HEADERS = {"title": ("title",), "abstract": ("abstract",), "journal": ("journal", "source"), "year": ("year", "date"), "author": ("author",), "doi": ("doi",)}


def header_fields(columns: Sequence[str]) -> dict[str, str]:
    """Field -> column by parts of the header; a later column of a field wins."""
    out: dict[str, str] = {}
    for column in columns:
        name = column.lower()
        field = next((f for f, parts in HEADERS.items() if any(p in name for p in parts)), None)
        if field:
            out[field] = column
    return out


def abstracts(table: DataFrame) -> DataFrame:
    """Abstract units of a table whose headers are found by name; blank abstracts drop out.

    table comes from CSV or Parquet; an abstract column is required.
    """
    found = header_fields(table.columns)
    if "abstract" not in found:
        raise ValueError(f"no abstract column among {table.columns}")
    get = lambda f: F.trim(F.col(f"`{found[f]}`").cast("string")) if f in found else F.lit(None).cast("string")
    rows = table.select(F.monotonically_increasing_id().alias("row"), *[get(f).alias(f) for f in HEADERS]).where("abstract is not null and abstract <> ''")
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("abstract_"), F.col("row").cast("string")))
    document = document_key(title)
    metadata = F.struct(title.alias("source_filename"), F.lit("abstract").alias("type"), "journal", "year", "author", F.col("doi").alias("DOI"))
    return rows.select(unit_key(document, "abstract", F.col("abstract")).alias("id"), document.alias("document_id"), F.col("abstract").alias("text"), metadata.alias("metadata"), F.lit("abstract").alias("unit_type"))


def graph_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a graph file: id, position, entities, relationships as arrays of maps.

    Bad lines, blank ones and those without an id drop out; of a list in
    ``graph`` the first object counts. position orders the lines.
    """
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.monotonically_increasing_id().alias("position"))
    good = rows.where(F.try_parse_json("value").isNotNull() & F.get_json_object("value", "$.id").isNotNull())
    graph = F.coalesce(F.get_json_object("value", "$.graph[0]"), F.get_json_object("value", "$.graph"))
    maps = lambda name: F.coalesce(F.from_json(F.get_json_object("graph", f"$.{name}"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    return good.select(F.get_json_object("value", "$.id").alias("id"), "position", graph.alias("graph")).select("id", "position", maps("entities").alias("entities"), maps("relationships").alias("relationships"))


def node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a node-link file; edges are under links, relationships or edges."""
    rows = spark.read.text(path, wholetext=True).select("value")
    maps = "array<map<string,string>>"
    nodes = rows.select(F.explode(F.from_json(F.get_json_object("value", "$.nodes"), maps)).alias("f")).select(F.col("f")["id"].alias("id"), F.col("f").alias("fields"))
    links = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in ("links", "relationships", "edges")])
    f = F.col("f")
    edges = rows.select(F.explode(F.from_json(links, maps)).alias("f")).select(f["source"].alias("src"), f["target"].alias("dst"), F.coalesce(f["relationship"], f["label"], f["relation"]).alias("relationship"), f["weight"].try_cast("double").alias("weight"), f.alias("fields"))
    return nodes, edges


REPORT = "community_id string, level int, title string, parent_id string, children_ids array<string>, node_count int, local_id_map map<string,string>, report struct<title:string,summary:string,rating:double,rating_explanation:string,findings:array<struct<summary:string,explanation:string>>>, report_raw string"


def report_text(report: Column) -> Column:
    """A report as text: title, summary, key findings."""
    findings = F.array_join(F.transform(report["findings"], lambda f: F.concat(F.lit("- "), F.coalesce(f["summary"], F.lit("")))), "\n")
    return F.concat(F.lit("**"), F.coalesce(report["title"], F.lit("")), F.lit("**\n\n"), F.coalesce(report["summary"], F.lit("")), F.lit("\n\n**Key Findings:**\n"), F.coalesce(findings, F.lit("")))


def reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path).withColumn("text", report_text(F.col("report")))


def merged_id_maps(levels: DataFrame) -> DataFrame:
    """community_id, local_id, id over all levels; maps written backwards are turned round, later levels win."""
    pairs = levels.select("level", "community_id", F.explode(F.map_entries("local_id_map")).alias("e"))
    back = F.col("e.value").rlike(r"^[ER]\d+$")
    rows = pairs.select("level", "community_id", F.when(back, F.col("e.value")).otherwise(F.col("e.key")).alias("local_id"), F.when(back, F.col("e.key")).otherwise(F.col("e.value")).alias("id"))
    return rows.groupBy("community_id", "local_id").agg(F.max_by("id", F.struct("level", "id")).alias("id"))


#: Question files in the order of their global ids.
QUESTION_FILES = ("L12", "L3", "L4", "hard")
QUESTION = "id string, question string, ground_truth string, difficulty string, type string, domain string, theme string"


def questions(spark: SparkSession, folder: str, files: Sequence[str] = QUESTION_FILES, difficulty: str | None = None, ids: Sequence[str] | None = None) -> DataFrame:
    """All questions with a running global_id over the files, in file order.

    A missing difficulty comes from the file's name. ids pick by own or global
    id. Question files are short lists, each read whole.
    """
    out = None
    for rank, name in enumerate(files):
        rows = spark.read.text(f"{folder}/{name}.json", wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{QUESTION.replace(' string', ':string').replace(', ', ',')}>>")).alias("at", "q"))
        rows = rows.select(F.lit(rank).alias("file_rank"), "at", "q.*", F.lit(f"{name}.json").alias("source_file"))
        default = "L1" if name == "L12" else name
        rows = rows.withColumn("difficulty", F.coalesce(F.nullif("difficulty", F.lit("")), F.lit(default)))
        out = rows if out is None else out.union(rows)
    from pyspark.sql.window import Window

    out = out.withColumn("global_id", F.row_number().over(Window.orderBy("file_rank", "at"))).drop("file_rank", "at")
    if difficulty:
        out = out.where(F.col("difficulty") == difficulty)
    if ids is not None:
        out = out.where(F.col("id").isin(*ids) | F.col("global_id").cast("string").isin(*map(str, ids)))
    return out


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Answer lines with their number as global_id (one file, read in order)."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("at", "line"))
    return rows.select((F.col("at") + 1).alias("global_id"), F.get_json_object("line", "$.answer").alias("answer"), F.get_json_object("line", "$.id").alias("id"))


def latest_files(files: DataFrame) -> DataFrame:
    """The last score file of each method by name: method, file."""
    name = F.element_at(F.split("path", "/"), -1)
    method = F.regexp_extract(name, r"^(.+?)_scores_\d{8}", 1)
    rows = files.select("path", name.alias("file"), method.alias("method")).where("method <> ''")
    return rows.groupBy("method").agg(F.max_by("path", "file").alias("path"), F.max("file").alias("file"))


def method_of(file: Column, rules: Mapping[str, str]) -> Column:
    """A result file's method by the first pattern that matches its name."""
    out = F.lit(None).cast("string")
    for pattern, method in reversed(list(rules.items())):
        out = F.when(file.rlike(pattern), method).otherwise(out)
    return out


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word, count, keep of a word file; words may hold commas, so the last two split."""
    rows = spark.read.text(path)
    part = lambda k: F.regexp_extract("value", r"^(.*),([^,]*),([^,]*)$", k)
    return rows.select(part(1).alias("word"), part(2).try_cast("long").alias("count"), F.upper(F.trim(part(3))).alias("keep")).where("count is not null and keep = 'Y'")


def safe_name(text: str) -> str:
    return re.sub(r"[^\w.-]+", "_", text)

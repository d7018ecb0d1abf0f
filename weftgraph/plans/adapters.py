"""The driver's tables in the shapes of the engine's data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks
from ..scratch import Scratch


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multigraph of supplier -> part: one edge per order line."""
    rows = load(spark, sf_dir, "lineitem")
    return rows.select(
        _id("S", "l_suppkey").alias("src"), _id("P", "l_partkey").alias("dst"), F.col("l_returnflag").alias("relationship"),
        F.col("l_linestatus").alias("description"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
    )


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts: id, name, type, description."""
    s = load(spark, sf_dir, "supplier").select(_id("S", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"), F.concat(F.lit("nation "), "s_nationkey").alias("description"))
    p = load(spark, sf_dir, "part").select(_id("P", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("description"))
    return s.union(p)


def simple_edges(spark: SparkSession, sf_dir: str, ranged: bool = False) -> DataFrame:
    """One edge per supplier and part, its weight the sum of quantities.

    The keys are grouped as numbers, which shuffle at half the size of ids;
    ranged: by ranges of keys, so that neighbours in the graph come together
    where their keys are near each other.
    """
    rows = load(spark, sf_dir, "lineitem")
    return _summed_lines(rows.repartitionByRange("l_suppkey", "l_partkey") if ranged else rows)


def _summed_lines(rows: DataFrame) -> DataFrame:
    rows = rows.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"), F.count("*").alias("n"))
    return rows.select(_id("S", "l_suppkey").alias("src"), _id("P", "l_partkey").alias("dst"), "weight", "n")


def lacking_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of simple_edges() that lack an end."""
    return _summed_lines(load(spark, sf_dir, "lineitem").where("l_suppkey is null or l_partkey is null"))


def supply_blocks(spark: SparkSession, sf_dir: str, scratch: Scratch, weight: bool = False) -> DataFrame | None:
    """simple_edges() as packed blocks (once), straight from the order lines: a line's ends are even numbers for suppliers and odd ones for parts."""
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), F.col("l_quantity").alias("weight"))
    named = lambda code: F.concat(F.when(code % 2 == 0, "S").otherwise("P"), F.shiftright(code, 1).cast("string"))
    return blocks.packed(rows if weight else rows.drop("weight"), None, scratch, "weight" if weight else None, named=named, once=True)


def linked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id of every end of simple_edges()."""
    rows = load(spark, sf_dir, "lineitem")
    return rows.select("l_suppkey").distinct().select(_id("S", "l_suppkey").alias("id")).union(rows.select("l_partkey").distinct().select(_id("P", "l_partkey").alias("id")))


def nodes_beside(spark: SparkSession, sf_dir: str, packed: DataFrame) -> DataFrame | None:
    """All of linked_nodes(), where some are in no packed block because their edges lack an end; None where there are none."""
    lone = lacking_edges(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("id"))
    return None if lone.isEmpty() else packed.select(F.explode("ids").alias("id")).union(lone).distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("level"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all kinds with their unit_type."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("text").alias("unit_type"))
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit("abstract").alias("unit_type"))
    c = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "text", F.lit("table").alias("unit_type"))
    p = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.lit("image").alias("unit_type"))
    return d.union(b).union(c).union(p)


#: SQL of simple_edges, for oracles.
SIMPLE_EDGES_SQL = "SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, sum(l_quantity) AS weight, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey"

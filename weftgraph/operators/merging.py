"""Entity merging: alias rewriting and aggregation of nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rewrite_ends(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace src and dst by the canonical id where aliases (alias, canonical) has one."""
    out = edges
    for end in ("src", "dst"):
        lookup = aliases.select(F.col("alias").alias(end), F.col("canonical").alias("__c"))
        out = out.join(lookup, end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
    return out


def merge_edges(edges: DataFrame, weight_rule: str = "max", order: str = "position") -> DataFrame:
    """One edge per (src, dst, relationship): weight max or sum, longest description, no loops.

    A missing or unusable weight is 1; of equally long descriptions the first stays.
    """
    if weight_rule not in ("max", "sum"):
        raise ValueError("weight_rule is max or sum")
    weight = F.coalesce(F.col("weight").try_cast("double"), F.lit(1.0))
    total = (F.max if weight_rule == "max" else F.sum)("__w")
    rows = edges.where("src <> dst").withColumn("__w", weight)
    best = F.max_by("description", F.struct(F.coalesce(F.length("description"), F.lit(-1)), -F.col(order)))
    return rows.groupBy("src", "dst", "relationship").agg(total.alias("weight"), best.alias("description"), F.min(order).alias(order), F.count("*").alias("n_merged"))


def merge_entities(members: DataFrame) -> DataFrame:
    """One node per canonical group.

    members: group_id, canonical_name (may be null), name, description, type,
    position. Name: the given one, else the most frequent (ties: longest, then
    greatest). Description: the longest (ties: first). Type: the most frequent
    (ties: first seen). Aliases: all other names, sorted.
    """
    rows = members.withColumn("description", F.coalesce("description", F.lit("")))
    names = rows.where("name is not null").groupBy("group_id", "name").agg(F.count("*").alias("n"))
    types = rows.where("type is not null").groupBy("group_id", "type").agg(F.count("*").alias("n"), F.min("position").alias("p"))
    by_name = names.groupBy("group_id").agg(F.max_by("name", F.struct("n", F.length("name"), "name")).alias("common"), F.array_sort(F.collect_set("name")).alias("names"))
    by_type = types.groupBy("group_id").agg(F.max_by("type", F.struct("n", -F.col("p"))).alias("type"))
    base = rows.groupBy("group_id").agg(
        F.max("canonical_name").alias("canonical_name"),
        F.max_by("description", F.struct(F.length("description"), -F.col("position"))).alias("description"),
        F.count("*").alias("n_members"),
    )
    out = base.join(by_name, "group_id", "left").join(by_type, "group_id", "left")
    name = F.coalesce("canonical_name", "common")
    return out.select("group_id", name.alias("name"), "description", "type", F.array_except(F.coalesce("names", F.array().cast("array<string>")), F.array(name)).alias("aliases"), "n_members")


def representatives(members: DataFrame, degrees: DataFrame) -> DataFrame:
    """group_id, id: the member whose name is canonical, else that of greatest degree (ties: smallest id)."""
    rows = members.join(degrees, "id", "left")
    match = (F.lower(F.trim("name")) == F.lower(F.trim("canonical_name"))).cast("int")
    return rows.groupBy("group_id").agg(F.min_by("id", F.struct(-F.coalesce(match, F.lit(0)), -F.coalesce("degree", F.lit(0)), "id")).alias("id"))


def strongest_parallel(edges: DataFrame) -> DataFrame:
    """Simple graph: of parallel edges the heaviest (ties: smallest relationship)."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    best = F.min_by(F.struct(*rest), F.struct(-F.coalesce("weight", F.lit(0.0)), "relationship"))
    return edges.groupBy("src", "dst").agg(best.alias("r")).select("src", "dst", *[F.col(f"r.{c}").alias(c) for c in rest])


def triplet_texts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Text of each edge from its ends' names: ``a -> [description] -> b``."""
    ends = nodes.select("id", "name")
    a = ends.select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    b = ends.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    rows = edges.join(a, "src", "left").join(b, "dst", "left")
    text = F.format_string("%s -> [%s] -> %s", F.coalesce("src_name", F.lit("Unknown")), F.coalesce("description", F.lit("")), F.coalesce("dst_name", F.lit("Unknown")))
    return rows.withColumn("text", text)

"""Distributions and summaries of graphs and communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_total


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree, in_degree, out_degree; parallel edges count each."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy(F.col("x.id").alias("id")).agg(F.count("*").alias("degree"), F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def degree_distribution(degree: DataFrame) -> DataFrame:
    return degree.groupBy("degree").agg(F.count("*").alias("n_nodes"))


def with_share(counts: DataFrame, n: str = "n") -> DataFrame:
    """Add each row's share of the total (one broadcast row)."""
    total = counts.agg(F.sum(n).alias("__t"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col(n) / F.col("__t")).drop("__t")


def top_counts(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values with count and share of all rows (ties: smallest value)."""
    counts = with_share(rows.groupBy(column).agg(F.count("*").alias("n")))
    return counts.orderBy(F.desc("n"), column).limit(k)


def size_statistics(members: DataFrame, community: str = "community") -> DataFrame:
    """Number, range, mean, median, spread and singletons of community sizes, rounded half-even."""
    sizes = members.groupBy(community).agg(F.count("*").alias("size"))
    r = lambda c: F.bround(c, 2)
    return sizes.agg(
        F.count("*").alias("n_communities"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), r(F.avg("size")).alias("avg_size"),
        r(F.percentile("size", F.lit(0.5))).alias("median_size"), r(F.stddev_pop("size")).alias("std_size"), F.count_if(F.col("size") == 1).alias("singletons"),
    )


def level_distribution(reports: DataFrame, *means: str) -> DataFrame:
    """Count, share in per cent and means of columns by level."""
    rows = with_share(reports.groupBy("level").agg(F.count("*").alias("n"), *[F.avg(m).alias(f"avg_{m}") for m in means]))
    return rows.withColumn("percent", F.col("share") * 100).drop("share")


def histogram(rows: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins from the least to the greatest value."""
    low_high = rows.agg(F.min(value).alias("__l"), F.max(value).alias("__h"))
    span = F.col("__h") - F.col("__l")
    number = F.when(span > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("__l")) / span * bins))).otherwise(F.lit(0)).cast("int")
    return rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(low_high)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))


def empirical_cdf(rows: DataFrame, value: str) -> DataFrame:
    """Share of rows at or below each distinct value.

    Values are counted first, so only distinct ones are put in order.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__t"))
    return running_total(counts, [F.col(value).asc()], F.col("n"), "__r").crossJoin(F.broadcast(total)).select(value, "n", (F.col("__r") / F.col("__t")).alias("cdf"))


def pair_matrix(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """By (category of src, category of dst): edges, weights and relationship kinds."""
    a = kinds.select(F.col("id").alias("src"), F.col("category").alias("src_category"))
    b = kinds.select(F.col("id").alias("dst"), F.col("category").alias("dst_category"))
    return edges.join(a, "src").join(b, "dst").groupBy("src_category", "dst_category").agg(
        F.count("*").alias("n"), F.count_distinct("relationship").alias("n_kinds"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.avg("weight").alias("avg_weight"),
    )


def top_label(edges: DataFrame, kinds: DataFrame, default: str = "RELATED_TO") -> DataFrame:
    """Commonest relationship by pair of categories, else that of the reverse pair, else default."""
    a = kinds.select(F.col("id").alias("src"), F.col("category").alias("src_category"))
    b = kinds.select(F.col("id").alias("dst"), F.col("category").alias("dst_category"))
    counts = edges.join(a, "src").join(b, "dst").groupBy("src_category", "dst_category", "relationship").agg(F.count("*").alias("n"))
    best = counts.groupBy("src_category", "dst_category").agg(F.min_by("relationship", F.struct(-F.col("n"), "relationship")).alias("label"))
    names = kinds.select("category").distinct()
    pairs = names.select(F.col("category").alias("src_category")).crossJoin(names.select(F.col("category").alias("dst_category")))  # categories are few
    back = best.select(F.col("src_category").alias("dst_category"), F.col("dst_category").alias("src_category"), F.col("label").alias("reverse"))
    rows = pairs.join(best, ["src_category", "dst_category"], "left").join(back, ["src_category", "dst_category"], "left")
    return rows.select("src_category", "dst_category", F.coalesce("label", "reverse", F.lit(default)).alias("label"))


def relation_distribution(rows: DataFrame, raw: str, group: Column, examples: int = 5) -> DataFrame:
    """Count, share, kinds and commonest raw names of each group of relation names."""
    raws = rows.groupBy(F.col(raw).alias("raw")).agg(F.count("*").alias("c")).withColumn("normalised", group)
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "raw"))), 1, examples), lambda x: x["raw"])
    out = raws.groupBy("normalised").agg(F.sum("c").alias("n"), F.count("*").alias("n_raw"), F.array_join(top, ", ").alias("examples"))
    return with_share(out)


def folded_counts(rows: DataFrame, name: str) -> DataFrame:
    """Names counted without regard to case; shown in their commonest spelling (ties: greatest)."""
    spelt = rows.where(F.trim(name) != "").groupBy(F.trim(name).alias("name")).agg(F.count("*").alias("c"))
    return spelt.groupBy(F.lower("name").alias("folded")).agg(F.max_by("name", F.struct("c", "name")).alias("name"), F.sum("c").alias("n"))


def modularity(edges: DataFrame, members: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: modularity of a partition of an undirected graph."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    a = members.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = members.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    return partition_quality(edges.withColumn("__w", w).join(a, "src").join(b, "dst").select("ca", "cb", "__w"))


def partition_quality(rows: DataFrame) -> DataFrame:
    """One row: modularity of edges given as communities ca and cb of their ends and weight __w."""
    ends = rows.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), F.col("__w")).otherwise(0.0).alias("i"), F.col("__w").alias("k")), F.struct(F.col("cb").alias("c"), F.lit(0.0).alias("i"), F.col("__w").alias("k")))).alias("x"))
    by = ends.groupBy("x.c").agg(F.sum("x.i").alias("inside"), F.sum("x.k").alias("k"))
    m = rows.agg(F.sum("__w").alias("m"))
    return by.crossJoin(F.broadcast(m)).agg(F.coalesce(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), F.lit(2))), F.lit(0.0)).alias("modularity"))

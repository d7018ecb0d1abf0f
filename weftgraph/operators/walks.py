"""Personalised PageRank, neighbourhoods, and paths over edge tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from ..scratch import Scratch
from .ordered import running_total


def transitions(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """src, dst, p: weights by the source's total. Sources of total 0 have no rows."""
    rows = edges.groupBy("src", "dst").agg(F.sum(F.coalesce(F.col(weight).cast("double"), F.lit(1.0))).alias("w"))
    total = rows.groupBy("src").agg(F.sum("w").alias("t"))
    return rows.join(total.where("t > 0"), "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p"))


def start_mass(scores: DataFrame) -> DataFrame:
    """id, mass: positive scores scaled to sum to 1; equal masses if none is positive."""
    rows = scores.select("id", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("s"))
    total = rows.agg(F.sum("s").alias("t"), F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(total)).select("id", F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(1.0 / F.col("n")).alias("mass"))


def personalised_pagerank(edges: DataFrame, scores: DataFrame, alpha: float = 0.15, most_rounds: int = 100, tolerance: float = 1e-6, weight: str = "weight") -> DataFrame:
    """id, mass after repeating mass = alpha start + (1 - alpha) mass P.

    scores lists every node. Nodes without outgoing weight lose their mass.
    Rounds stop when no mass moves by the tolerance; each is stored, so a lost
    executor repeats one round.
    """
    scratch = Scratch(edges.sparkSession, "pagerank")
    p = scratch.keep(transitions(edges, weight), "transitions")
    start = scratch.keep(start_mass(scores), "start")
    mass = start
    for turn in range(most_rounds):
        flow = mass.withColumnRenamed("id", "src").join(p, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("mass") * F.col("p")).alias("in"))
        new = start.withColumnRenamed("mass", "s").join(flow, "id", "left").join(mass.withColumnRenamed("mass", "old"), "id")
        new = new.select("id", (alpha * F.col("s") + (1 - alpha) * F.coalesce("in", F.lit(0.0))).alias("mass"), "old")
        seen = Observation()  # how far mass moved comes with the round's write
        kept = scratch.keep(new.observe(seen, F.max(F.abs(F.col("mass") - F.col("old"))).alias("moved")), f"round-{turn}")
        moved = seen.get["moved"]
        scratch.drop(f"round-{turn - 1}")
        mass = kept.select("id", "mass")
        if moved is None or moved < tolerance:
            break
    return mass


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """id, hop (0 for seeds) of all nodes within that many undirected steps."""
    scratch = Scratch(edges.sparkSession, "hops")
    both = edges.select("src", "dst").union(edges.select("dst", "src"))  # only edges of the frontier are made distinct
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        step = both.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = scratch.keep(step.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)), f"hop-{hop}")
        seen = seen.union(front)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def bounded_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, most_nodes: int = 4, most_paths: int | None = None) -> DataFrame:
    """Simple directed paths from starts (id, position) to any end, breadth first.

    A path holds at most most_nodes nodes and stops at its first end; a start
    that is an end is a path of one node. Rows: position, path, in the order of
    starts, then length, then nodes. most_paths keeps the first so many.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    steps = scratch.keep(edges.where("src <> dst").select("src", "dst").distinct(), "steps")
    goal = ends.select(F.col("id").alias("last")).distinct().withColumn("__end", F.lit(True))
    front = starts.select("position", F.array("id").alias("path"), F.col("id").alias("last"))
    done = None
    for depth in range(1, most_nodes + 1):
        marked = scratch.keep(front.join(goal, "last", "left"), f"front-{depth}")
        ended = marked.where("__end").select("position", "path")
        done = ended if done is None else done.union(ended)
        if depth < most_nodes:
            rest = marked.where("__end is null").select("position", "path", F.col("last").alias("src"))
            grown = rest.join(steps, "src").where(~F.array_contains("path", F.col("dst")))
            front = grown.select("position", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"))
    if most_paths is None:
        return done
    return done.orderBy("position", F.size("path"), "path").limit(most_paths)


def path_scores(paths: DataFrame, edges: DataFrame, score: Column) -> DataFrame:
    """Add score: geometric mean of the edges' scores.

    A missing or non-positive edge makes 0; a path of one node has 1. edges
    has one row per (src, dst).
    """
    rows = paths.withColumn("__id", F.sha2(F.to_json("path"), 256)).dropDuplicates(["__id", "position"])
    hops = rows.where(F.size("path") > 1).select("__id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))).alias("h")).distinct()
    known = edges.select("src", "dst", score.alias("__s"))
    hops = hops.select("__id", "h.src", "h.dst").join(known, ["src", "dst"], "left").withColumn("__s", F.coalesce("__s", F.lit(0.0)))
    mean = hops.groupBy("__id").agg(F.when(F.min("__s") <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.when(F.col("__s") > 0, F.col("__s")))))).alias("score"))
    return rows.join(mean, "__id", "left").withColumn("score", F.coalesce("score", F.lit(1.0))).drop("__id")


def edge_score(composite: str = "composite", attention: str | None = None, alpha: float = 0.5) -> Column:
    """(1 - alpha) composite + alpha attention; attention falls back to composite."""
    c = F.coalesce(F.col(composite), F.lit(0.0))
    return (1 - alpha) * c + alpha * (F.coalesce(F.col(attention), c) if attention else c)


def ranked_paths(scored: DataFrame, k: int = 10, least: float = 0.0) -> DataFrame:
    """The k best paths, and of those the ones that reach the least score."""
    best = scored.orderBy(F.desc("score"), F.size("path"), "path").limit(k)
    return best.where(F.col("score") >= least)


def explained(paths: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add explanation: names joined by the edges' labels, in path order."""
    rows = paths.withColumn("__id", F.monotonically_increasing_id())
    rows = rows.select("*")
    steps = rows.select("__id", F.posexplode("path").alias("at", "id"), "path")
    steps = steps.withColumn("next", F.get("path", F.col("at") + 1)).join(nodes.select("id", "name"), "id", "left")
    label = F.coalesce(F.nullif("description", F.lit("")), "relationship", F.lit("unknown"))
    joined = steps.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("next"), label.alias("label")), ["id", "next"], "left")
    part = F.concat(F.coalesce("name", "id"), F.when(F.col("next").isNotNull(), F.concat(F.lit(" --["), F.coalesce("label", F.lit("unknown")), F.lit("]--> "))).otherwise(F.lit("")))
    text = joined.groupBy("__id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", part.alias("p")))), lambda x: x["p"]), "").alias("explanation"))
    return rows.join(text, "__id", "left").drop("__id")


def typed_edges(edges: DataFrame) -> DataFrame:
    """Add edge_type, edge_weight and type_id (position among the sorted types)."""
    kind = F.coalesce(F.nullif("description", F.lit("")), F.nullif("relationship", F.lit("")), F.lit("unknown"))
    weight = F.coalesce(F.col("composite").cast("double") if "composite" in edges.columns else F.lit(None), F.col("weight").cast("double"), F.lit(1.0))
    rows = edges.withColumn("edge_type", kind).withColumn("edge_weight", weight)
    numbered = running_total(rows.select("edge_type").distinct(), [F.col("edge_type").asc()], F.lit(1), "type_id")
    return rows.join(numbered.withColumn("type_id", (F.col("type_id") - 1).cast("int")), "edge_type")


def non_edges(edges: DataFrame, nodes: DataFrame, per_node: int, seed: int = 0) -> DataFrame:
    """Negative samples: per node up to per_node targets that it has no edge to."""
    count = nodes.count()
    numbered = nodes.select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, count))).alias("slot"))
    draws = nodes.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("draw"))
    draws = draws.withColumn("slot", F.pmod(F.xxhash64("src", "draw", F.lit(seed)), F.lit(max(1, count))))
    pairs = draws.join(numbered, "slot").select("src", F.col("id").alias("dst")).where("src <> dst").distinct()
    return pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def attention(edges: DataFrame, logit: Column, head: str = "head") -> DataFrame:
    """Add attention: softmax of a logit over the edges that enter each node, per head.

    The greatest logit of a node is taken off first, so nothing overflows. Only
    real edges have rows, which is what masks the rest.
    """
    rows = edges.withColumn("__l", logit.cast("double"))
    top = rows.groupBy("dst", head).agg(F.max("__l").alias("__m"))
    rows = rows.join(top, ["dst", head]).withColumn("__e", F.exp(F.col("__l") - F.col("__m")))
    total = rows.groupBy("dst", head).agg(F.sum("__e").alias("__t"))
    return rows.join(total, ["dst", head]).withColumn("attention", F.col("__e") / F.col("__t")).drop("__l", "__m", "__e", "__t")


def mean_attention(edges: DataFrame, heads: DataFrame | None, weight: str = "weight") -> DataFrame:
    """Add attention to edges: the mean over heads, or the edge's weight without a model."""
    if heads is None:
        return edges.withColumn("attention", F.col(weight).cast("double"))
    mean = heads.groupBy("src", "dst").agg(F.avg("attention").alias("attention"))
    return edges.join(mean, ["src", "dst"], "left").withColumn("attention", F.coalesce("attention", F.col(weight).cast("double")))


def attended(edges: DataFrame, features: DataFrame) -> DataFrame:
    """id, vector: attention-weighted sums of the source nodes' feature vectors, per destination."""
    rows = edges.join(features.select(F.col("id").alias("src"), F.posexplode("vector").alias("at", "x")), "src")
    sums = rows.groupBy(F.col("dst").alias("id"), "at").agg(F.sum(F.col("attention") * F.col("x")).alias("x"))
    return sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))


def type_vectors(types: DataFrame, vectors: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """edge_type, type_id, vector: the type's own vector, else small seeded normal numbers."""
    noise = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: _normal(F.xxhash64("edge_type", i, F.lit(seed)), F.xxhash64("edge_type", -i, F.lit(seed))) * 0.01)
    rows = types.select("edge_type", "type_id").distinct().join(vectors.select("edge_type", F.col("vector").cast("array<double>").alias("own")), "edge_type", "left")
    return rows.select("edge_type", "type_id", F.coalesce("own", noise).alias("vector"))


def _normal(a: Column, b: Column) -> Column:
    """A normal number of two hashes."""
    part = lambda h: (F.pmod(h, F.lit(1 << 52)) + 1) / float(1 << 52)
    return F.sqrt(-2 * F.ln(part(a))) * F.cos(2 * math.pi * part(b))

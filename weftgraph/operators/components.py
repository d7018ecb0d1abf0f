"""Connected components of an edge table by alternating star contractions.

Large-star and small-star steps move every node's edges to smaller neighbours
until each component is a star; rounds grow with the logarithm of the size.
Each round's edges are written to the shared folder, so nothing is recomputed
when an executor is lost. No component is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """id and component (smallest id) of every node with an edge (a, b).

    Nulls and loops are ignored; an edge may repeat and point either way.
    """
    live = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    return _contracted(live, scratch, name, most_rounds)


def dense_components(edges: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """connected_components() of a graph with many more edges than nodes.

    The rounds run on a sample first, the smallest and the greatest neighbour
    of every node, which leaves few nodes apart. All edges are then held
    against the sample's components once, and those that link two of them go
    through the rounds too.
    """
    every = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    every = scratch.keep(every, f"{name}-all")
    sides = [every.groupBy(F.col(x).alias("id")).agg(F.min(y).alias("low"), F.max(y).alias("high")) for x, y in (("u", "v"), ("v", "u"))]
    sample = sides[0].union(sides[1]).select("id", F.explode(F.array("low", "high")).alias("o")).select(F.greatest("id", "o").alias("u"), F.least("id", "o").alias("v"))
    first = _contracted(sample.distinct(), scratch, f"{name}-sample", most_rounds)
    side = lambda end, label: first.select(F.col("id").alias(end), F.col("component").alias(label)).hint("shuffle_hash")
    left = every.join(side("u", "cu"), "u").join(side("v", "cv"), "v").where("cu <> cv")
    left = scratch.keep(left.select(F.greatest("cu", "cv").alias("u"), F.least("cu", "cv").alias("v")).distinct(), f"{name}-left")
    scratch.drop(f"{name}-all")
    if left.isEmpty():
        return first
    merged = _contracted(left, scratch, f"{name}-left-rounds", most_rounds).select(F.col("id").alias("component"), F.col("component").alias("c"))
    return first.join(merged, "component", "left").select("id", F.coalesce("c", "component").alias("component"))


def _contracted(live: DataFrame, scratch: Scratch, name: str, most_rounds: int) -> DataFrame:
    """id, component of distinct edges (u, v), u > v, by stars."""
    live = scratch.keep(live, f"{name}-0")
    before = None
    for turn in range(1, most_rounds + 1):
        # large star: bigger neighbours go to the smallest one
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node go to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        seen = Observation()  # the round's digest comes with its write
        nxt = small.union(least.select("u", F.col("m").alias("v"))).distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest"))
        live = scratch.keep(nxt, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        now = tuple(seen.get.values())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = live.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return live.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)

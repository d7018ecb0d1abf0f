"""Edge importance, weight normalisation, and betweenness by community."""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import blocks
from .shortest import SOURCES, dealt, shares


def _with_totals(rows: DataFrame, **totals: Column) -> DataFrame:
    """rows beside one row of totals over all of them (a broadcast of one row)."""
    return rows.crossJoin(F.broadcast(rows.agg(*[c.alias(n) for n, c in totals.items()])))


def composite_importance(edges: DataFrame, alpha: float = 0.8, centrality: str = "centrality") -> DataFrame:
    """Add composite = alpha * centrality + (1 - alpha) * weight, both scaled to 0..1.

    A missing weight counts as 0 here and not for the range; a range of zero
    divides by 1; the result is held in 0..1.
    """
    rows = _with_totals(edges, __wl=F.min("weight"), __wh=F.max("weight"), __cl=F.min(centrality), __ch=F.max(centrality))

    def scaled(x: Column, low: str, high: str) -> Column:
        span = F.col(high) - F.col(low)
        return (x - F.col(low)) / F.when(span > 0, span).otherwise(F.lit(1.0))

    mixed = alpha * scaled(F.coalesce(F.col(centrality), F.lit(0.0)), "__cl", "__ch") + (1 - alpha) * scaled(F.coalesce("weight", F.lit(0.0)), "__wl", "__wh")
    return rows.withColumn("composite", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(mixed, F.lit(0.0))))).drop("__wl", "__wh", "__cl", "__ch")


def normalised_weights(edges: DataFrame, strategy: str, weight: str = "weight") -> DataFrame:
    """Add normalised: minmax, softmax (times the number of edges), log (over its greatest) or none."""
    w = F.col(weight).cast("double")
    if strategy == "none":
        return edges.withColumn("normalised", w)
    if strategy == "minmax":
        rows = _with_totals(edges, __l=F.min(weight), __h=F.max(weight))
        span = F.col("__h") - F.col("__l")
        return rows.withColumn("normalised", F.when(span > 0, (w - F.col("__l")) / span).otherwise(F.lit(1.0))).drop("__l", "__h")
    if strategy == "softmax":
        rows = _with_totals(edges, __h=F.max(weight))
        rows = rows.withColumn("__e", F.exp(w - F.col("__h")))
        return _with_totals(rows, __s=F.sum("__e"), __n=F.count("*")).withColumn("normalised", F.col("__e") / F.col("__s") * F.col("__n")).drop("__h", "__e", "__s", "__n")
    if strategy == "log":
        rows = _with_totals(edges.withColumn("__e", F.log1p(w)), __h=F.max(F.log1p(w)))
        return rows.withColumn("normalised", F.when(F.col("__h") > 0, F.col("__e") / F.col("__h")).otherwise(F.col("__e"))).drop("__e", "__h")
    raise ValueError("strategy is minmax, softmax, log or none")


def edge_betweenness(pairs: list[tuple[str, str]], directed: bool = True) -> dict[tuple[str, str], float]:
    """Shortest-path betweenness of the edges of one small graph, scaled by n (n - 1)."""
    after: dict[str, list[str]] = defaultdict(list)
    nodes: dict[str, None] = {}
    for a, b in dict.fromkeys(pairs):
        nodes |= {a: None, b: None}
        after[a].append(b)
        if not directed:
            after[b].append(a)
    score = dict.fromkeys(pairs, 0.0)
    for source in nodes:
        paths, depth, order, before = {source: 1.0}, {source: 0}, [], defaultdict(list)
        queue = deque([source])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in after[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] = paths.get(w, 0.0) + paths[v]
                    before[w].append(v)
        due = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                flow = paths[v] / paths[w] * (1 + due[w])
                due[v] += flow
                score[(v, w) if (v, w) in score else (w, v)] += flow
    scale = len(nodes) * (len(nodes) - 1)
    return {e: s / scale if scale else 0.0 for e, s in score.items()}


def _coded(part: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of src and of dst, and the ids that they stand for."""
    names = pa.chunked_array(part["src"].chunks + part["dst"].chunks).combine_chunks().dictionary_encode()
    codes = names.indices.to_numpy().astype(np.int64)
    return codes[: len(part)], codes[len(part) :], names.dictionary


def community_betweenness(edges: DataFrame, members: DataFrame, sources: int = SOURCES) -> DataFrame:
    """src, dst, community, centrality of the edges inside each community.

    A community is a graph of its own. Its sources are dealt over tasks that
    each hold the community's edges; their partial sums are added. Only nodes
    from which two steps lead on are walked from: of any other node, each edge
    is the one shortest path to its end, which the first task counts at once.
    """
    a = members.select(F.col("id").alias("src"), F.col("community").alias("ca")).hint("shuffle_hash")
    b = members.select(F.col("id").alias("dst"), F.col("community").alias("cb")).hint("shuffle_hash")
    inside = edges.select("src", "dst").join(a, "src").join(b, "dst").where("ca = cb").select(F.col("ca").alias("community"), "src", "dst")
    return _betweenness(Scratch(edges.sparkSession, "betweenness").keep(inside, "inside"), sources, each=False)


def edge_centrality(edges: DataFrame, members: DataFrame, sources: int = SOURCES) -> DataFrame:
    """edges with the centrality of community_betweenness(), null between communities."""
    a = members.select(F.col("id").alias("src"), F.col("community").alias("__a")).hint("shuffle_hash")
    b = members.select(F.col("id").alias("dst"), F.col("community").alias("__b")).hint("shuffle_hash")
    rows = edges.join(a, "src", "left").join(b, "dst", "left").select(*edges.columns, "__a", "__b")
    rows = Scratch(edges.sparkSession, "betweenness").keep(rows, "placed")
    inside = rows.where("__a = __b").select(F.col("__a").alias("community"), *edges.columns)
    outside = rows.where("not coalesce(__a = __b, false)").select(*edges.columns, F.lit(None).cast("double").alias("centrality"))
    return _betweenness(inside, sources, each=True).select(*edges.columns, "centrality").union(outside)


def block_betweenness(packed: DataFrame, labels: DataFrame | None = None, sources: int = SOURCES) -> DataFrame:
    """src, dst, w, community, centrality of the different edges of packed blocks (once).

    labels: id, community, none of which lies in two blocks; without them a
    block is one community, named by its smallest id. Each block is dealt by its sources over tasks as in
    community_betweenness(), and edges between communities have neither
    community nor centrality.
    """
    kind = packed.schema["ids"].dataType.elementType.simpleString()
    named = kind if labels is None else labels.schema["community"].dataType.simpleString()

    def work(ids: pa.Array, x: dict[str, np.ndarray], own: pa.Table) -> pa.Table:
        s, d, part, parts = x["s"], x["d"], x["part"], x["parts"]
        if own is None:
            names, of = ids[:1], np.zeros(len(ids), np.int64)
        else:
            codes = own["community"].combine_chunks().dictionary_encode()
            names, of = codes.dictionary, codes.indices.to_numpy().astype(np.int64)
        on = of[s] == of[d]
        ends = np.zeros(len(ids), bool)
        ends[s[on]] = ends[d[on]] = True
        size = np.bincount(of[ends], minlength=len(names))  # nodes with an edge inside
        walked = blocks.leading(len(ids), s[on], d[on])
        flow = np.zeros(len(s))
        mine = np.flatnonzero(walked)[part::parts]
        if len(mine):  # walks stay in a community
            order = np.flatnonzero(on)
            order, mine = order[np.argsort(of[s[order]], kind="stable")], mine[np.argsort(of[mine], kind="stable")]
            edge_of, node_of = of[s[order]], of[mine]
            for c in np.unique(node_of):
                at = order[slice(*np.searchsorted(edge_of, [c, c + 1]))]
                walks = mine[slice(*np.searchsorted(node_of, [c, c + 1]))]
                local, near = np.unique(np.concatenate([s[at], d[at]]), return_inverse=True)
                flow[at] += shares(len(local), *near.reshape(2, -1), np.searchsorted(local, walks)).edge
        if part == 0:  # the first part has every edge
            flow[on & ~walked[s] & (s != d)] += 1
        keep = slice(None) if part == 0 else flow > 0
        s, d, on, flow = s[keep], d[keep], on[keep], flow[keep]
        place = np.where(on, of[s], 0)
        scale = size[place] * (size[place] - 1)
        w = pa.nulls(len(s), pa.float64()) if x["w"] is None else pa.array(x["w"][keep], from_pandas=True)
        return pa.table({"src": ids.take(pa.array(s)), "dst": ids.take(pa.array(d)), "w": w, "community": names.take(pa.array(place, mask=~on)), "centrality": pa.array(flow / np.maximum(scale, 1), mask=~on)})

    schema = f"src {kind}, dst {kind}, w double, community {named}, centrality double"
    size = F.greatest(F.lit(1), F.ceil(F.col("walked") / sources)).cast("int")
    rows = packed.withColumn("parts", size).where(F.size("ids") > 0)
    dealt_ = lambda rows: blocks.beside(rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), labels, work, schema)
    summed = dealt_(rows.where("parts > 1")).groupBy("src", "dst").agg(F.first("w").alias("w"), F.first("community").alias("community"), F.sum("centrality").alias("centrality"))
    return dealt_(rows.where("parts = 1")).union(summed)


def _betweenness(inside: DataFrame, sources: int, each: bool) -> DataFrame:
    """Stored edges (community, src, dst, others) with centrality: every row of an edge (each), or one."""
    starts = inside.groupBy("community", F.col("src").alias("id")).agg(F.lit(1).alias("one"))
    ends = inside.groupBy("community", F.col("dst").alias("id")).agg(F.lit(True).alias("end"))
    size = starts.join(ends, ["community", "id"], "left").groupBy("community").agg(F.sum("one").alias("starts"), F.max("end").alias("on"))
    size = size.select("community", F.when(F.col("on"), F.ceil(F.col("starts") / sources)).otherwise(1).cast("int").alias("parts"))
    size = Scratch(inside.sparkSession, "betweenness").keep(size, "size")

    names_out = inside.columns

    def run(part: pa.Table) -> pa.Table:
        start, end, names = _coded(part)
        n, at, parts = len(names), part["part"][0].as_py(), part["parts"][0].as_py()
        _, keep, back = np.unique(start * n + end, return_index=True, return_inverse=True)  # an edge may repeat
        start, end = start[keep], end[keep]
        leads = np.bincount(start, minlength=n) > 0
        walked = np.zeros(n, bool)
        walked[start[leads[end]]] = True
        flow = shares(n, start, end, np.flatnonzero(walked)[at::parts]).edge
        if at == 0:  # the first part has every edge
            flow[~walked[start]] += 1
        flow, chosen = (flow[back], slice(None)) if each and parts == 1 else (flow, keep)
        out = part.select(names_out).take(pa.array(np.arange(len(part))[chosen]))
        if at:
            out, flow = out.filter(pa.array(flow > 0)), flow[flow > 0]
        return out.append_column("centrality", pa.array(flow / max(n * (n - 1), 1)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inside.schema)
    found = lambda sizes: dealt(inside, sizes).groupBy("community", "part").applyInArrow(run, f"{kinds}, centrality double")
    whole = found(size.where("parts = 1"))
    summed = found(size.where("parts > 1")).groupBy("community", "src", "dst").agg(F.sum("centrality").alias("centrality"))
    if each:
        key = ["community", "src", "dst"]
        summed = inside.join(size.where("parts > 1").select("community"), "community", "left_semi").join(summed, key).select(*inside.columns, "centrality")
    return whole.union(summed)

"""Graph queries and measures over whole graphs, against brute force on small ones."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import detection, importance
from weftgraph.plans.catalogue import QUERIES


def _depths_and_paths(near, source):
    depth, paths, front = {source: 0}, {source: 1}, [source]
    while front:
        later = []
        for v in front:
            for w in near[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0
                    later.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        front = later
    return depth, paths


def test_betweenness_of_a_dealt_community(spark):
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(250), rng.randrange(250)) for _ in range(700)})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    labels = spark.createDataFrame([(i, 1) for i in range(250)], "id long, community long")
    expected = importance.edge_betweenness(pairs)
    for sources in (37, 512):
        got = {(r.src, r.dst): r.centrality for r in importance.community_betweenness(edges, labels, sources).collect()}
        assert got == pytest.approx(expected)


def test_node_measures_of_a_dealt_community(spark):
    rng = random.Random(6)
    pairs = [(f"n{a}", f"n{b}") for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if a != b] + [("x", "y")]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found, n = {v: _depths_and_paths(near, v) for v in near}, len(near)
    expected = {}
    for v in near:
        depth, paths = found[v]
        through = sum(
            paths[s] * paths[t] / found[s][1][t]
            for s, t in itertools.permutations(depth, 2)
            if v not in (s, t) and depth[s] + depth[t] == found[s][0][t]
        )
        reach = len(depth) - 1
        expected[v] = (through / ((n - 1) * (n - 2)), reach / sum(depth.values()) * reach / (n - 1))
    labels = spark.createDataFrame([(v, "c") for v in near], "id string, community string")
    rows = detection.node_measures(spark.createDataFrame(pairs, "src string, dst string"), labels, sources=7).collect()
    assert {r.id: pytest.approx((r.betweenness, r.closeness)) for r in rows} == expected


def test_light_edges_reach_the_graph_queries(spark, tmp_path):
    """No pair weighs 120, and one component has over 200 nodes."""
    pairs = [(i // 2 + 1, (i + 1) // 2 + 1) for i in range(230)] + [(900, 900)]
    rows = [(s, p, "R", "O", 5.0, i, 1) for i, (s, p) in enumerate(pairs)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_returnflag string, l_linestatus string, l_quantity double, l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(s, f"s{s}", 1) for s in {x[0] for x in pairs}], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(p, f"p{p}", "t", "b") for p in {x[1] for x in pairs}], "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path))
    nodes = {f"S{s}" for s, _ in pairs} | {f"P{p}" for _, p in pairs}
    edges = {(f"S{s}", f"P{p}") for s, p in pairs}
    parts = {r.id: r.component for r in run("g1_all_components").collect()}
    assert parts == {v: "P900" if v in ("S900", "P900") else "P1" for v in nodes}
    assert {(r.src, r.dst): r.explanation for r in run("g6_all_explanations").collect()} == {(s, p): f"s{s[1:]} --[SUPPLIES]--> p{p[1:]}" for s, p in edges}
    assert {(r.src, r.dst) for r in run("g20_betweenness").collect()} == edges
    assert {(r.src, r.dst) for r in run("g28_importance_job").collect()} == edges
    assert {r.id for r in run("g21_node_measures").collect()} == nodes
    assert {r.id for r in run("g11_label_propagation").collect()} == nodes
    assert run("g19_hierarchy").where(F.col("level") == 2).count() == len(nodes)

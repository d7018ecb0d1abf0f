"""Graph queries from blocks packed out of the order lines, and measures in the blocks, against brute force and joins."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import blocks, communities, components, detection, importance
from weftgraph.plans import graph_queries, model_queries
from weftgraph.plans.catalogue import QUERIES
from weftgraph.scratch import Scratch


def _directed(spark):
    """Edges that repeat, point both ways, are loops or lack an end; four parts and their nodes' communities."""
    rng = random.Random(21)
    pairs = [(f"{c}{rng.randrange(n):03}", f"{c}{rng.randrange(n):03}") for c, n, m in (("a", 60, 150), ("b", 40, 90), ("c", 9, 30), ("d", 30, 40)) for _ in range(m)]
    rows = [(s, d, float(1 + i % 3)) for i, (s, d) in enumerate([*pairs, *pairs[:40], ("e", "e")])]
    edges = spark.createDataFrame([*rows, (None, "a001", 1.0)], "src string, dst string, weight double")
    return rows, edges, {v: int(v[1:] or 0) % 2 for row in rows for v in row[:2]}


@pytest.mark.parametrize("sources", [4, 512])
def test_betweenness_in_blocks_equals_brute_force(spark, sources):
    rows, edges, side = _directed(spark)
    packed = blocks.packed(edges, None, Scratch(spark, "t"), "weight", once=True)
    sums, part = {}, {r.id: r.component for r in components.connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), Scratch(spark, "t"), "t").collect()}
    for s, d, w in rows:
        sums[s, d] = sums.get((s, d), 0) + w
    halves = {v: f"{part[v]}-{x}" for v, x in side.items() if v in part}
    part |= {v: v for v in side.keys() - part.keys()}
    halves |= {v: v for v in side.keys() - halves.keys()}
    labels = spark.createDataFrame(list(halves.items()), "id string, community string")
    for of, given in ((part, None), (halves, labels)):
        expected = {e: (w, None, None) for e, w in sums.items()}
        for c in set(of.values()):
            inside = [e for e in sums if of[e[0]] == of[e[1]] == c]
            expected |= {e: (sums[e], c, pytest.approx(x)) for e, x in importance.edge_betweenness(inside).items()}
        got = importance.block_betweenness(packed, given, sources).collect()
        assert len(got) == len(sums)
        assert {(r.src, r.dst): (r.w, r.community, r.centrality) for r in got} == expected


@pytest.fixture
def lines(spark, tmp_path):
    """Order lines of two far and one lone supplier, some of them repeated."""
    rng = random.Random(8)
    pairs = [(g * 50 + rng.randrange(12), g * 900 + rng.randrange(40)) for g in (0, 1) for _ in range(160)] + [(70000, 80000)] * 3
    rows = [(s, p, float(1 + i % 4)) for i, (s, p) in enumerate(pairs)] + [(None, 5, 1.0), (5, None, 1.0), (1, 2, None), (3, 2000, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=str)


def _both_ways(spark, lines, name, monkeypatch, refused):
    """A query's rows while `refused` (module, name) raises, and its rows where no component fits a block."""
    with monkeypatch.context() as m:
        for where, what in refused:
            m.setattr(where, what, None)
        packed = _sorted(QUERIES[name](spark, lines))
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 0)
    return packed, _sorted(QUERIES[name](spark, lines))


def test_g20_needs_no_joins_of_edges(spark, lines, monkeypatch):
    packed, joined = _both_ways(spark, lines, "g20_betweenness", monkeypatch, [(graph_queries, "simple_edges"), (components, "dense_components"), (importance, "community_betweenness")])
    assert [r[:3] for r in packed] == [r[:3] for r in joined]
    assert [r[3] for r in packed] == pytest.approx([r[3] for r in joined])
    assert ("P80000", "S70000", "P80000", 0.5) in packed


def test_g28_scores_edges_in_their_blocks(spark, lines, monkeypatch):
    packed, joined = _both_ways(spark, lines, "g28_importance_job", monkeypatch, [(graph_queries, "simple_edges"), (detection, "edge_centrality")])
    complete = [r for r in joined if None not in r[:2]]
    assert packed == joined and len(complete) > 100


def test_g23_reads_the_order_lines_once(spark, lines, monkeypatch):
    """Edges are not summed by joins first, and a line that repeats is one edge."""
    packed, joined = _both_ways(spark, lines, "g23_method_comparison", monkeypatch, [(graph_queries, "simple_edges"), (graph_queries, "linked_nodes")])
    assert packed == joined and len(packed) == 2


@pytest.mark.parametrize("weight", [None, "weight"])
def test_labels_and_moves_of_edges_taken_once(spark, monkeypatch, weight):
    """Links that point both ways and loops are as in blocks of all edges."""
    _, edges, side = _directed(spark)
    nodes = spark.createDataFrame([(v,) for v in side], "id string")
    packed = blocks.packed(edges, None, Scratch(spark, "t"), weight, once=True)
    for run in (communities.label_propagation, communities.refined_moves):
        assert _sorted(run(None, None, weight=weight, packed=packed)) == _sorted(run(edges, nodes, weight=weight))


def test_g9_reads_the_order_lines_once(spark, lines, monkeypatch):
    packed, joined = _both_ways(spark, lines, "g9_connected", monkeypatch, [(model_queries, "simple_edges"), (model_queries, "linked_nodes")])
    assert packed == joined and packed[0][1]


def test_node_measures_of_packed_blocks(spark):
    """Loops, repeated edges and such as point both ways count as one link or none; a part is a task of its own."""
    _, edges, _ = _directed(spark)
    packed = blocks.packed(edges, None, Scratch(spark, "t"), None, once=True)
    labels = packed.select(F.explode("ids").alias("id"), F.col("ids")[0].alias("community"))
    expected = {r.id: pytest.approx((r.betweenness, r.closeness)) for r in detection.node_measures(edges, labels, sources=7).collect()}
    rows = detection.node_measures(None, None, sources=7, packed=packed).collect()
    assert {r.id: (r.betweenness, r.closeness) for r in rows} == expected and "e" not in expected

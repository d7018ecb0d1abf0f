"""Queries over the supplier-part graph: walks, communities, importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities, components, context, detection, importance, repair, stats, vector, walks
from ..scratch import Scratch
from . import providers
from .adapters import SIMPLE_EDGES_SQL, lacking_edges, linked_nodes, load, nodes_beside, simple_edges, supply_blocks, supply_edges, supply_nodes, units, vectors
from .catalogue import query
from .vector_queries import QUESTION

_S = f"s AS ({SIMPLE_EDGES_SQL})"
_B = f"{_S}, b AS (SELECT src AS a, dst AS b FROM s UNION ALL SELECT dst, src FROM s)"


@query("flagship_context")
def flagship_context(spark, sf_dir):
    """From a question's vector to a context: nearest parts, one hop, budgeted sections."""
    found = vector.top_k(vectors(spark, sf_dir), QUESTION, 5)
    seeds = found.select(F.concat(F.lit("P"), F.pmod("id", F.lit(200))).alias("id"))
    edges = simple_edges(spark, sf_dir).withColumn("relationship", F.lit("SUPPLIES")).withColumn("description", F.lit("supplies"))
    hops = walks.neighbourhood(edges, seeds, 1)
    nodes = supply_nodes(spark, sf_dir).withColumn("chunk_id", F.concat(F.lit("chunk-"), F.substring("id", 2, 10))).withColumn("community", F.col("type"))
    texts = load(spark, sf_dir, "documents").select(F.concat(F.lit("chunk-"), "doc_id").alias("chunk_id"), "text")
    reports = nodes.select("community").distinct().select("community", F.concat(F.lit("Parts of type "), "community").alias("text"))
    return context.local_context(nodes, edges, texts, reports, hops, limit=20_000)


@query(
    "g1_all_components",
    f"""WITH RECURSIVE {_B}, w(id, c) USING KEY (id) AS (SELECT DISTINCT a, a FROM b
        UNION SELECT b.b, min(w.c) FROM w JOIN b ON b.a = w.id JOIN recurring.w r ON r.id = b.b WHERE w.c < r.c GROUP BY b.b) SELECT id, c AS component FROM w""",
)
def g1_all_components(spark, sf_dir):
    """Components of all edges."""
    edges = simple_edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return components.connected_components(edges, Scratch(spark, "g1all"), "g1all")


_P = "t AS (SELECT src, sum(weight) AS t FROM s GROUP BY src), p AS (SELECT s.src, s.dst, s.weight / t.t AS p FROM s JOIN t USING (src))"


@query("g2_transitions", f"WITH {_S}, {_P} SELECT src, dst, round(p, 9) AS p FROM p")
def g2_transitions(spark, sf_dir):
    return walks.transitions(simple_edges(spark, sf_dir)).withColumn("p", F.round("p", 9))


_BOTH = "e2 AS (SELECT src, dst, weight FROM s UNION ALL SELECT dst, src, weight FROM s), t AS (SELECT src, sum(weight) AS t FROM e2 GROUP BY src), p AS (SELECT e2.src, e2.dst, weight / t AS p FROM e2 JOIN t USING (src))"
_START = "n AS (SELECT src AS id FROM e2 UNION SELECT dst FROM e2), m0 AS (SELECT id, CASE WHEN id IN ('S1', 'S2', 'S3') THEN 1.0 / 3 ELSE 0.0 END AS m FROM n)"
_ROUND = "m{k} AS (SELECT n.id, 0.15 * z.m + 0.85 * coalesce(f.m, 0) AS m FROM n JOIN m0 z USING (id) LEFT JOIN (SELECT p.dst AS id, sum(x.m * p.p) AS m FROM m{j} x JOIN p ON p.src = x.id GROUP BY p.dst) f USING (id))"


@query("g3_pagerank_rounds", f"WITH {_S}, {_BOTH}, {_START}, {', '.join(_ROUND.format(k=k, j=k - 1) for k in range(1, 5))} SELECT id, round(m, 8) AS mass FROM m4")
def g3_pagerank_rounds(spark, sf_dir):
    return _pagerank(spark, sf_dir, 4)


@query("g3_pagerank")
def g3_pagerank(spark, sf_dir):
    return _pagerank(spark, sf_dir, 100)


def _pagerank(spark, sf_dir, rounds):
    edges = simple_edges(spark, sf_dir)
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    scores = both.select(F.col("src").alias("id")).distinct().withColumn("score", F.when(F.col("id").isin("S1", "S2", "S3"), 1.0).otherwise(0.0))
    return walks.personalised_pagerank(both, scores, most_rounds=rounds).withColumn("mass", F.round("mass", 8))


_NATION = """x AS (SELECT DISTINCT 'N' || s_nationkey AS src, 'M' || (s_suppkey % 12) AS dst FROM supplier UNION SELECT DISTINCT 'M' || (s_suppkey % 12), 'K' || (s_suppkey % 7) FROM supplier UNION SELECT DISTINCT 'K' || (s_suppkey % 7), 'N' || (s_nationkey + 1) FROM supplier)"""


def _small_graph(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    n, m, k = F.concat(F.lit("N"), "s_nationkey"), F.concat(F.lit("M"), F.col("s_suppkey") % 12), F.concat(F.lit("K"), F.col("s_suppkey") % 7)
    pair = lambda a, b: s.select(a.alias("src"), b.alias("dst"))
    return pair(n, m).union(pair(m, k)).union(pair(k, F.concat(F.lit("N"), F.col("s_nationkey") + 1))).distinct()


_WALK = f"""WITH RECURSIVE {_NATION}, w(pos, path, last, n) AS (SELECT CAST(substr(id, 2) AS INTEGER), [id], id, 1 FROM (SELECT unnest(['N1', 'N2', 'N3']) AS id)
    UNION ALL SELECT pos, list_append(path, x.dst), x.dst, n + 1 FROM w JOIN x ON x.src = w.last WHERE n < 4 AND last NOT IN ('N4', 'N5') AND NOT list_contains(path, x.dst) AND x.src <> x.dst)"""


def _paths(spark, sf_dir):
    starts = spark.createDataFrame([(1, "N1"), (2, "N2"), (3, "N3")], "position int, id string")
    ends = spark.createDataFrame([("N4",), ("N5",)], "id string")
    return walks.bounded_paths(_small_graph(spark, sf_dir), starts, ends, 4)


@query("g4_paths", f"{_WALK} SELECT pos AS position, array_to_string(path, '>') AS path FROM w WHERE last IN ('N4', 'N5')")
def g4_paths(spark, sf_dir):
    return _paths(spark, sf_dir).select("position", F.array_join("path", ">").alias("path"))


@query(
    "g5_path_scores",
    f"""{_WALK}, d AS (SELECT pos, path FROM w WHERE last IN ('N4', 'N5')), h AS (SELECT pos, path, unnest(range(1, len(path))) AS i FROM d),
        v AS (SELECT pos, path, (length(path[i]) * 7 + length(path[i + 1]) * 3 + ascii(path[i + 1])) % 10 / 10.0 AS s FROM h)
        SELECT pos AS position, array_to_string(path, '>') AS path, round(CASE WHEN min(s) <= 0 THEN 0 ELSE exp(avg(ln(CASE WHEN s > 0 THEN s END))) END, 8) AS score FROM v GROUP BY pos, path""",
)
def g5_path_scores(spark, sf_dir):
    score = (F.length("src") * 7 + F.length("dst") * 3 + F.ascii("dst")) % 10 / 10.0
    rows = walks.path_scores(_paths(spark, sf_dir), _small_graph(spark, sf_dir), score)
    return rows.select("position", F.array_join("path", ">").alias("path"), F.round("score", 8).alias("score"))


@query(
    "g8_khop",
    f"""WITH {_B}, h0 AS (SELECT 'S1' AS id), h1 AS (SELECT DISTINCT b.b AS id FROM b JOIN h0 ON b.a = h0.id WHERE b.b NOT IN (SELECT id FROM h0)),
        h2 AS (SELECT DISTINCT b.b AS id FROM b JOIN h1 ON b.a = h1.id WHERE b.b NOT IN (SELECT id FROM h0 UNION SELECT id FROM h1))
        SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""",
)
def g8_khop(spark, sf_dir):
    return walks.neighbourhood(simple_edges(spark, sf_dir), spark.createDataFrame([("S1",)], "id string"), 2)


@query("g11_label_propagation")
def g11_label_propagation(spark, sf_dir):
    edges = simple_edges(spark, sf_dir)
    return communities.label_propagation(edges, stats.degrees(edges).select("id"), 6)


@query("g9_local_moves")
def g9_local_moves(spark, sf_dir):
    edges = simple_edges(spark, sf_dir)
    return communities.local_moves(edges, stats.degrees(edges).select("id"), levels=2, rounds=4)


@query("g13_kmeans")
def g13_kmeans(spark, sf_dir):
    return communities.kmeans_communities(vectors(spark, sf_dir))


@query("g19_hierarchy")
def g19_hierarchy(spark, sf_dir):
    edges = simple_edges(spark, sf_dir)
    return communities.hierarchy(edges, stats.degrees(edges).select("id"), 2, 5, detect=lambda e, n: communities.label_propagation(e, n, 4))


@query("g20_betweenness")
def g20_betweenness(spark, sf_dir):
    packed = supply_blocks(spark, sf_dir, Scratch(spark, "g20blocks"))
    if packed is not None:
        return importance.block_betweenness(packed).select("community", "src", "dst", "centrality")
    edges = Scratch(spark, "g20edges").keep(simple_edges(spark, sf_dir).select("src", "dst"), "edges")
    labels = components.dense_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), Scratch(spark, "g20"), "g20").select("id", F.col("component").alias("community"))
    return importance.community_betweenness(edges, labels)  # not rounded: shares of a large graph are below 1e-8


_LABELS = "k AS (SELECT 'S' || s_suppkey AS id, s_nationkey % 5 AS c FROM supplier UNION ALL SELECT 'P' || p_partkey, p_partkey % 5 FROM part)"


def _labels(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), (F.col("s_nationkey") % 5).cast("long").alias("community"))
    return s.union(load(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("community")))


@query(
    "g22_modularity",
    f"""WITH {_S}, {_LABELS}, x AS (SELECT a.c AS ca, b.c AS cb FROM s JOIN k a ON a.id = src JOIN k b ON b.id = dst), m AS (SELECT count(*) AS m FROM x),
        z AS (SELECT c, sum(i) AS i, count(*) AS k FROM (SELECT ca AS c, CASE WHEN ca = cb THEN 1 ELSE 0 END AS i FROM x UNION ALL SELECT cb, 0 FROM x) GROUP BY c)
        SELECT round(sum(CAST(i AS DOUBLE) / m - pow(k / (2.0 * m), 2)), 8) AS modularity FROM z, m""",
)
def g22_modularity(spark, sf_dir):
    return stats.modularity(simple_edges(spark, sf_dir), _labels(spark, sf_dir)).select(F.round("modularity", 8).alias("modularity"))


@query(
    "a28_supernodes",
    f"WITH {_S}, {_LABELS} SELECT least(a.c, b.c) AS src, greatest(a.c, b.c) AS dst, sum(weight) AS weight FROM s JOIN k a ON a.id = src JOIN k b ON b.id = dst WHERE a.c <> b.c GROUP BY ALL",
)
def a28_supernodes(spark, sf_dir):
    return communities.supernode_edges(simple_edges(spark, sf_dir), _labels(spark, sf_dir))


_CONTEXT = f"""{_S}, {_LABELS}, i AS (SELECT a.c, src, dst, weight AS importance, 'SUPPLIES' AS relationship FROM s JOIN k a ON a.id = src JOIN k b ON b.id = dst WHERE a.c = b.c),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY importance DESC NULLS LAST, relationship, src, dst) AS place FROM i) WHERE place <= 50),
    f AS (SELECT c, id, count(*) AS frequency FROM (SELECT c, src AS id FROM best UNION ALL SELECT c, dst FROM best) GROUP BY c, id), d AS (SELECT c, id, count(*) AS degree FROM (SELECT c, src AS id FROM i UNION ALL SELECT c, dst FROM i) GROUP BY c, id),
    e AS (SELECT * FROM (SELECT f.c, f.id, frequency, degree, row_number() OVER (PARTITION BY f.c ORDER BY frequency DESC, degree DESC, f.id DESC) AS n FROM f JOIN d ON d.c = f.c AND d.id = f.id) WHERE n <= 25)"""


def _report_context(spark, sf_dir):
    edges = simple_edges(spark, sf_dir).select("src", "dst", F.col("weight").alias("importance"), F.lit("SUPPLIES").alias("relationship"))
    return communities.report_context(edges, _labels(spark, sf_dir))


@query("w5_report_entities", f"WITH {_CONTEXT} SELECT c AS community, id, frequency, degree, 'E' || n AS local_id FROM e")
def w5_report_entities(spark, sf_dir):
    return _report_context(spark, sf_dir)[0]


@query(
    "w6_report_edges",
    f"""WITH {_CONTEXT}, r AS (SELECT best.*, (SELECT count(*) FROM e WHERE e.c = best.c AND e.id = best.src) + (SELECT count(*) FROM e WHERE e.c = best.c AND e.id = best.dst) AS hits FROM best),
        t AS (SELECT *, max(hits) OVER (PARTITION BY c) AS top FROM r) SELECT c AS community, src, dst, importance, CAST(place AS INTEGER) AS place, 'R' || row_number() OVER (PARTITION BY c ORDER BY place) AS local_id FROM t WHERE hits = 2 OR (top < 2 AND hits = 1)""",
)
def w6_report_edges(spark, sf_dir):
    return _report_context(spark, sf_dir)[1].select("community", "src", "dst", "importance", "place", "local_id")


@query(
    "a19_graph_summary",
    f"""WITH {_S}, d AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM s UNION ALL SELECT dst FROM s) GROUP BY id)
        SELECT count(*) AS n_nodes, (SELECT count(*) FROM s) AS n_edges, round(avg(d), 6) AS avg_degree, max(d) AS max_degree, min(d) AS min_degree, median(d) AS median_degree FROM d""",
)
def a19_graph_summary(spark, sf_dir):
    edges = simple_edges(spark, sf_dir)
    d = stats.degrees(edges)
    shape = d.agg(F.count("*").alias("n_nodes"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), F.percentile("degree", F.lit(0.5)).alias("median_degree"))
    return shape.crossJoin(edges.agg(F.count("*").alias("n_edges")))  # one row each


@query(
    "g26_typed_edges",
    f"""SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, l_orderkey * 10 + l_linenumber AS position, l_linestatus AS edge_type, l_quantity AS edge_weight,
        CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS INTEGER) AS type_id FROM lineitem""",
)
def g26_typed_edges(spark, sf_dir):
    return walks.typed_edges(supply_edges(spark, sf_dir)).select("src", "dst", "position", "edge_type", "edge_weight", "type_id")


@query("n5_negative_edges")
def n5_negative_edges(spark, sf_dir):
    nodes = supply_nodes(spark, sf_dir).select("id")
    return walks.non_edges(simple_edges(spark, sf_dir), nodes, 2, 7)


@query("j12_unlinked", f"WITH {_S} SELECT 'P' || p_partkey AS id FROM part WHERE 'P' || p_partkey NOT IN (SELECT dst FROM s WHERE weight >= 100)")
def j12_unlinked(spark, sf_dir):
    heavy = simple_edges(spark, sf_dir).where("weight >= 100").select(F.col("dst").alias("id"))
    return supply_nodes(spark, sf_dir).where("type <> 'supplier'").select("id").join(heavy, "id", "left_anti")


@query("g23_method_comparison")
def g23_method_comparison(spark, sf_dir):
    packed = supply_blocks(spark, sf_dir, Scratch(spark, "g23blocks"))
    if packed is not None:
        edges, nodes = None, nodes_beside(spark, sf_dir, packed)
    else:  # a component is too large for a task
        edges, nodes = simple_edges(spark, sf_dir, ranged=True).select("src", "dst"), Scratch(spark, "g23nodes").keep(linked_nodes(spark, sf_dir), "nodes")
    rows = detection.comparison(edges, nodes, ["label_propagation", "leiden"], packed=packed)
    return rows.withColumn("modularity", F.round("modularity", 8))


@query("g28_importance_job")
def g28_importance_job(spark, sf_dir):
    packed = supply_blocks(spark, sf_dir, Scratch(spark, "g28blocks"), weight=True)
    if packed is not None:
        scored = detection.importance_in_blocks(packed, "label_propagation", 0.6, lacking_edges(spark, sf_dir))
        return scored.select("src", "dst", F.round("composite", 8).alias("composite"))
    edges = Scratch(spark, "g28edges").keep(simple_edges(spark, sf_dir, ranged=True).select("src", "dst", "weight"), "edges")
    nodes = Scratch(spark, "g28nodes").keep(linked_nodes(spark, sf_dir), "nodes")
    scored = detection.partitioned(edges, nodes, "label_propagation", 0.6)[1]
    return scored.select("src", "dst", F.round("composite", 8).alias("composite"))


@query("g14_density_communities")
def g14_density_communities(spark, sf_dir):
    return detection.density_communities(vectors(spark, sf_dir), 5, 0.3)


@query("g21_node_measures")
def g21_node_measures(spark, sf_dir):
    packed = supply_blocks(spark, sf_dir, Scratch(spark, "g21blocks"))
    if packed is not None:
        rows = detection.node_measures(None, None, packed=packed)
    else:
        edges = Scratch(spark, "g21edges").keep(simple_edges(spark, sf_dir).select("src", "dst"), "edges")
        labels = components.dense_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), Scratch(spark, "g21"), "g21").select("id", F.col("component").alias("community"))
        rows = detection.node_measures(edges, labels)
    return rows.select("id", F.round("betweenness", 8).alias("betweenness"), F.round("closeness", 8).alias("closeness"))


def _units(spark, sf_dir):
    """Texts of all kinds, by kind and id."""
    return units(spark, sf_dir).select(F.concat_ws("-", "unit_type", F.col("id").cast("string"), F.xxhash64("text").cast("string")).alias("id"), "unit_type", "text")


@query("m1_extraction")
def m1_extraction(spark, sf_dir):
    """Triples of all text units by the offline provider, repaired and loaded."""
    nodes, edges = repair.load_graph(providers.extracted(_units(spark, sf_dir), providers.Stub))
    return nodes.select("id", "name").join(stats.degrees(edges).select("id", "degree"), "id", "left").select("id", "name", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("x4_unit_vectors")
def x4_unit_vectors(spark, sf_dir):
    """Sizes of the vectors of all text units (null: a blank text)."""
    rows = providers.embed_column(_units(spark, sf_dir), "text", "vector", providers.Stub)
    return rows.select("id", "unit_type", F.round(vector.dot(F.col("vector"), F.col("vector")), 6).alias("size"))

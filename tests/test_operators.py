"""Hand-computed cases of the operators' rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import chunking, communities, components, context, evaluation, importance, merging, repair, stats, vector, walks
from weftgraph.scratch import Scratch


def _chunks(text, size, overlap):
    out, start = [], 0
    while text:
        out.append(text[start : start + size])
        if start + size >= len(text):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("text", ["abcdefghij", "abcdefg", "abc", "a", "abcd", "é" * 17, "x" * 40])
def test_chunks_follow_the_rule(spark, text):
    rows = chunking.chunk_texts(spark.createDataFrame([(1, text)], "doc_id int, text string"), size=4, overlap=1).orderBy("chunk").collect()
    assert [r.text for r in rows] == _chunks(text, 4, 1)
    assert rows[0].text + "".join(r.text[1:] for r in rows[1:]) == text


def test_empty_and_null_texts_have_no_chunks(spark):
    rows = spark.createDataFrame([(1, ""), (2, None)], "doc_id int, text string")
    assert chunking.chunk_texts(rows, size=4, overlap=1).count() == 0
    with pytest.raises(ValueError):
        chunking.chunk_texts(rows, size=4, overlap=4)


def test_offsets_skip_blank_blocks(spark):
    rows = spark.createDataFrame([(1, 0, "ab"), (1, 1, "  "), (1, 2, "cde")], "d int, p int, t string")
    segments = chunking.segment_offsets(rows, "d", "p", "t")
    assert [(r.start, r.end) for r in segments.orderBy("p").collect()] == [(0, 2), (4, 7)]
    assert chunking.joined_text(segments, "d", "p").first().text == "ab\n\ncde"


def test_batches_are_numbered_in_order(spark):
    rows = spark.range(0, 100, 1, 7)
    got = chunking.batch_numbers(rows, [F.desc("id")], 30).orderBy("position").collect()
    assert [r.id for r in got] == list(range(99, -1, -1)) and [r.batch for r in got] == [k // 30 for k in range(100)]


def test_an_entity_named_under_its_id_is_repaired(spark):
    rows = spark.createDataFrame([({"e-6": "Alloy X", "type": "Material"},)], "fields map<string,string>")
    r = repair.repair_entities(rows).first()
    assert (r.id, r.name, r.description, r.attributes) == ("e-6", "Alloy X", "Material entity: Alloy X", {})
    assert r.error_types == ["missing_id_field", "name_in_id_field", "description_generated", "attributes_missing"]


def test_names_in_keys_and_unknown_fields(spark):
    rows = spark.createDataFrame([(1, {"id": "e-1", "nameAlloy 706: ": "a nickel alloy", "attributes": '{"k": "v"}'}), (2, {"id": "e-2", "name": "NaN", "nameSteel": "NaN", "odd": "1"})], "n int, fields map<string,string>")
    a, b = repair.repair_entities(rows).orderBy("n").collect()
    assert (a.name, a.description, a.type) == ("Alloy 706", "a nickel alloy", "Material") and a.attributes["k"] == "v"
    assert a.error_types[0] == "name_merged_with_description" and "non_standard_field_nameAlloy 706: " in a.error_types
    assert (b.name, b.type, b.attributes) == ("Steel", "Material", {"_raw_odd": "1"}) and b.error_types[0] == "name_without_separator"


def test_relationships_get_defaults(spark):
    rows = spark.createDataFrame([({"source": "e-1", "target": "e-2", "weight": "x"},)], "fields map<string,string>")
    r = repair.repair_relationships(rows).first()
    assert (r.id, r.relationship, r.description, r.weight) == ("r-unknown", "unknown", "Relationship", 1.0)


def test_edges_need_both_ends_in_their_own_record(spark):
    e = lambda *ids: [{"id": i, "name": i} for i in ids]
    rel = lambda a, b: {"id": f"r-{a}{b}", "source": a, "target": b, "relationship": "R", "weight": "2"}
    rows = [("c1", 0, e("a", "b"), [rel("a", "b"), rel("a", "z")]), ("c2", 1, e("z"), [rel("a", "z")]), ("c1", 2, [{"id": "a", "name": "later"}], [])]
    nodes, edges = repair.load_graph(spark.createDataFrame(rows, "id string, position int, entities array<map<string,string>>, relationships array<map<string,string>>"))
    assert {(r.id, r.name) for r in nodes.collect()} == {("c1-a", "a"), ("c1-b", "b"), ("c2-z", "z")}
    assert [(r.src, r.dst, r.weight) for r in edges.collect()] == [("c1-a", "c1-b", 2.0)]


def test_fields_are_cleaned(spark):
    rows = spark.createDataFrame([("e-1", {"a": "1", "b": "NaN", "name x: ": "y", "e-1": "z", "k" * 101: "long"})], "id string, f map<string,string>")
    assert rows.select(repair.clean_fields(F.col("f"), F.col("id"), 100).alias("f")).first().f == {"a": "1"}


def test_entities_merge_by_the_rules(spark):
    rows = [("g", "Nickel", "x", "A", "T1", 0), ("g", "Nickel", "y", "nickel alloy", "T2", 1), ("g", "Nickel", "y", "", "T2", 2)]
    r = merging.merge_entities(spark.createDataFrame(rows, "group_id string, canonical_name string, name string, description string, type string, position int")).first()
    assert (r.name, r.description, r.type, r.aliases) == ("Nickel", "nickel alloy", "T2", ["x", "y"])


def test_edges_merge_after_aliases(spark):
    edges = spark.createDataFrame([("a", "b", "USES", "s", 2.0, 0), ("a2", "b", "USES", "longer", 5.0, 1), ("a", "a2", "IS", "", 1.0, 2)], "src string, dst string, relationship string, description string, weight double, position int")
    moved = merging.rewrite_ends(edges, spark.createDataFrame([("a2", "a")], "alias string, canonical string"))
    one = merging.merge_edges(moved).collect()
    assert [(r.src, r.dst, r.weight, r.description) for r in one] == [("a", "b", 5.0, "longer")]
    assert merging.merge_edges(moved, "sum").first().weight == 7.0


def test_representatives_prefer_the_name_then_degree(spark):
    members = spark.createDataFrame([("g", "Ni", "1", "x"), ("g", "Ni", "2", "ni "), ("h", "Q", "3", "a"), ("h", "Q", "4", "b")], "group_id string, canonical_name string, id string, name string")
    degree = spark.createDataFrame([("1", 9), ("3", 1), ("4", 5)], "id string, degree int")
    assert {r.group_id: r.id for r in merging.representatives(members, degree).collect()} == {"g": "2", "h": "4"}


def test_importance_is_scaled_and_mixed(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, 0.0), ("b", "c", 3.0, 0.5), ("c", "d", 5.0, 1.0), ("d", "e", None, 0.0)], "src string, dst string, weight double, centrality double")
    got = {r.src: round(r.composite, 9) for r in importance.composite_importance(edges).collect()}
    assert (got["a"], got["b"], got["c"], got["d"]) == (0.0, 0.5, 1.0, 0.0)


def test_edge_betweenness_of_a_path_and_a_cycle():
    path = importance.edge_betweenness([("a", "b"), ("b", "c")])
    assert path == {("a", "b"): 2 / 6, ("b", "c"): 2 / 6}
    ring = importance.edge_betweenness([("a", "b"), ("b", "c"), ("c", "a")])
    assert all(v == pytest.approx(3 / 6) for v in ring.values())


def test_size_statistics(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([0, 1, 2, 2, 2, 2])], "id int, community int")
    r = stats.size_statistics(rows).first()
    assert (r.n_communities, r.min_size, r.max_size, r.avg_size, r.median_size, r.std_size, r.singletons) == (3, 1, 4, 2.0, 1.0, 1.41, 2)


def test_tie_ranks(spark):
    schema = "question_id int, dim string, method string, position int, tie_group int, n_methods int"
    rows = [(1, "d", "a", 0, None, 4), (1, "d", "b", 1, 1, 4), (1, "d", "c", 2, 1, 4), (1, "d", "d", 3, None, 4), (2, "d", "a", 0, None, 4), (2, "d", "b", 1, None, 4), (2, "d", "c", None, None, 4), (3, "d", "a", 0, None, 1)]
    got = {(r.question_id, r.method): round(r.rank_score, 4) for r in evaluation.tie_ranks(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 0.5, (1, "c"): 0.5, (1, "d"): 0, (2, "a"): 1, (2, "b"): 0.6667, (2, "c"): 0, (3, "a"): 1}


def test_keyword_match(spark):
    score = evaluation.matched_share(F.array(F.lit("720")), F.array(F.lit("720"), F.lit("8")))
    r = spark.range(1).select(*[c.alias(n) for n, c in score.items()]).first()
    assert (r.precision, r.recall, round(r.f1, 4)) == (0.5, 1.0, 0.6667)
    none = evaluation.matched_share(F.array().cast("array<string>"), F.array(F.lit("x")))
    empty = evaluation.matched_share(F.array(F.lit("x")), F.array().cast("array<string>"))
    assert spark.range(1).select(none["f1"].alias("a"), empty["f1"].alias("b")).first() == (1.0, 0.0)


def test_blends_fall_back_to_the_semantic_score(spark):
    rows = spark.createDataFrame([("L1", 0.5, 1.0, None), ("L3", 0.0, 0.4, 0.9), ("L3", 0.0, 0.4, None), ("hard", 0.0, 0.2, 1.0)], "level string, k double, s double, j double")
    parts = [F.lit(None).cast("double")] * 3
    got = [round(r[0], 6) for r in rows.select(evaluation.blended_score(F.col("level"), F.col("k"), F.col("s"), F.col("j"), parts)).collect()]
    assert got == [0.7, 0.8, 0.4, 0.88]


def test_the_budget_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(0, "a" * 100), (1, "b" * 1000), (2, "c" * 50)], "position int, text string")
    assert [r.position for r in context.budgeted_sections(rows, 200).collect()] == [0]
    assert context.progressive_context(["x" * 400, "y" * 8000, "z"], 100) == ["x" * 400, "y" * 400]


def test_pagerank_steps_and_leak(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    scores = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", -1.0)], "id string, score double")
    got = {r.id: round(r.mass, 6) for r in walks.personalised_pagerank(edges, scores, most_rounds=1).collect()}
    assert got == {"a": 0.15, "b": 0.2125, "c": 0.6375}
    many = walks.personalised_pagerank(edges.union(spark.createDataFrame([("c", "a", 1.0)], edges.schema)), scores)
    assert many.agg(F.sum("mass")).first()[0] == pytest.approx(1.0, abs=1e-4)


def test_bounded_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a", 0)], "id string, position int")
    end = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert walks.bounded_paths(edges, start, end("d"), 3).count() == 0
    assert [r.path for r in walks.bounded_paths(edges, start, end("d"), 4).collect()] == [["a", "b", "c", "d"]]
    assert [r.path for r in walks.bounded_paths(edges, start, end("a", "c"), 4).collect()] == [["a"]]


def test_path_scores_are_geometric_means(spark):
    edges = spark.createDataFrame([("a", "b", 0.25), ("b", "c", 1.0)], "src string, dst string, s double")
    paths = spark.createDataFrame([(0, ["a", "b", "c"]), (0, ["a"]), (0, ["a", "c"])], "position int, path array<string>")
    got = {tuple(r.path): round(r.score, 6) for r in walks.path_scores(paths, edges, F.col("s")).collect()}
    assert got == {("a", "b", "c"): 0.5, ("a",): 1.0, ("a", "c"): 0.0}
    best = walks.ranked_paths(spark.createDataFrame([(["a"], 0.9), (["b"], 0.1), (["c"], 0.5)], "path array<string>, score double"), 2, 0.6)
    assert [r.path for r in best.collect()] == [["a"]]


def test_explanations_follow_the_path(spark):
    edges = spark.createDataFrame([("a", "b", "USES", None)], "src string, dst string, relationship string, description string")
    nodes = spark.createDataFrame([("a", "Ann"), ("b", "Bob")], "id string, name string")
    paths = spark.createDataFrame([(["a", "b"], 1.0)], "path array<string>, score double")
    assert walks.explained(paths, edges, nodes).first().explanation == "Ann --[USES]--> Bob"


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"), "t").collect()}
    assert got == {x: root(x) for x in {y for e in edges if e[0] != e[1] for y in e}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test"), "e").count() == 0


def test_mutual_neighbours_make_clusters(spark):
    vectors = [(1, [1.0, 0.0]), (2, [0.99, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 0.99]), (5, [-1.0, -1.0])]
    table = spark.createDataFrame(vectors, "id long, vector array<double>")
    got = {r.id: r.cluster for r in vector.candidate_clusters(table, 1, 0.9).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    one_way = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (2, 3, 0.95)], "id long, other long, similarity double")
    assert [(r.a, r.b) for r in vector.mutual(one_way).collect()] == [(1, 2)]


def test_exact_neighbours_do_not_depend_on_blocks(spark):
    rng = random.Random(2)
    table = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(500, None), (501, [0.0] * 8)], "id long, vector array<double>")
    key = lambda d: sorted((r.id, r.other, r.rank) for r in d.collect())
    whole = key(vector.neighbours(table, 4, 0.3))
    assert whole == key(vector.neighbours(table, 4, 0.3, block_rows=17)) and whole
    near = {(a, b) for a, b, _ in whole}
    got = {(r.id, r.other) for r in vector.approximate_neighbours(table, 4, 0.3).collect()}
    assert len(near & got) >= 0.9 * len(near)


def test_fused_queries():
    assert vector.fused_query([1, 0], [[0, 1], [0, 0.5]], "ppr") == pytest.approx([0.5547, 0.8321], abs=1e-4)
    assert vector.fused_query([1, 0], [[0, 1], [0, 0.5]], "gnn") == pytest.approx([0.9520, 0.3060], abs=1e-4)
    with pytest.raises(ValueError):
        vector.unit([0.0, 0.0])


def _two_cliques(spark):
    pairs = [(a, b) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)] + [(5, 10)]
    return spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(i,) for i in [*range(6), *range(10, 16)]], "id long")


def test_detection_separates_cliques(spark):
    edges, nodes = _two_cliques(spark)
    for detect in (communities.label_propagation, communities.local_moves):
        labels = detect(edges, nodes)
        sets = {}
        for r in labels.collect():
            sets.setdefault(r.community, set()).add(r.id)
        assert sorted(map(sorted, sets.values())) == [list(range(6)), list(range(10, 16))]
        assert stats.modularity(edges, labels).first()[0] > 0.4


def test_every_level_of_a_hierarchy_covers_every_node(spark):
    edges, nodes = _two_cliques(spark)
    levels = communities.hierarchy(edges, nodes, 2, 3)
    for n in range(3):
        assert sorted(r.id for r in levels.where(F.col("level") == n).collect()) == sorted(r.id for r in nodes.collect())
    table = {(r.level, r.community): r for r in communities.community_table(levels).collect()}
    assert table[0, "0"].node_count == 12 and sorted(table[0, "0"].children_ids) == ["0_0", "0_1"] and table[1, "0_0"].parent_id == "0"


def test_missing_labels_come_from_neighbours(spark):
    edges, nodes = _two_cliques(spark)
    more = nodes.union(spark.createDataFrame([(99,)], "id long"))
    labels = spark.createDataFrame([(i, 7) for i in range(5)], "id long, community long")
    got = {r.id: r.community for r in communities.complete_labels(more, edges, labels).collect()}
    assert got[5] == "7" and got[99] == "new-99" and len(got) == 13


def test_agreement_ignores_the_order_of_members(spark):
    human = spark.createDataFrame([([1, 2], "merge"), ([3, 4], "keep")], "members array<int>, decision string")
    machine = spark.createDataFrame([([2, 1], "merge")], "members array<int>, decision string")
    r = evaluation.agreement(human, machine).first()
    assert (r.n, r.n_matched, r.n_agree, r.rate) == (2, 1, 1, 1.0)


def test_weights_normalise(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 3.0)], "src string, dst string, weight double")
    get = lambda s: [round(r.normalised, 6) for r in importance.normalised_weights(edges, s).orderBy("weight").collect()]
    assert get("minmax") == [0.0, 1.0] and get("none") == [1.0, 3.0]
    assert get("softmax") == [round(2 / (1 + math.exp(2)), 6), round(2 / (1 + math.exp(-2)), 6)]
    with pytest.raises(ValueError):
        importance.normalised_weights(edges, "other")


def test_keywords_of_a_text(spark):
    from weftgraph.functions import keywords

    r = spark.range(1).select(keywords.keywords(F.lit("大约720MPa, Inconel 718 and 5-7 nm of GAMMA phase")).alias("k")).first().k
    assert r.numbers[0] == "大约720MPa" and "718" in r.numbers and any(n.startswith("5-7") for n in r.numbers)
    assert "Inconel 718" in r.alloys and r.terms == ["gamma"]


def test_attention_sums_to_one_over_entering_edges(spark):
    edges = spark.createDataFrame([("a", "c", 0, 1000.0), ("b", "c", 0, 1000.0), ("a", "b", 0, -5.0)], "src string, dst string, head int, l double")
    rows = walks.attention(edges, F.col("l"))
    assert {(r.src, r.dst): r.attention for r in rows.collect()} == {("a", "c"): 0.5, ("b", "c"): 0.5, ("a", "b"): 1.0}
    features = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 4.0])], "id string, vector array<double>")
    assert {r.id: r.vector for r in walks.attended(rows, features).collect()} == {"b": [1.0, 0.0], "c": [0.5, 2.0]}
    assert walks.mean_attention(edges.withColumn("weight", F.lit(2.0)), None).first().attention == 2.0

"""Sources, sinks, text functions, and whole flows with the offline provider."""

import json

import pytest
from pyspark.sql import functions as F

from weftgraph.config import deep_merge, with_profile
from weftgraph.functions import citations, ids, relations, text
from weftgraph.operators import communities
from weftgraph.plans import flows, providers
from weftgraph.plans.manifest import Manifest
from weftgraph.sources import pages, sinks, tables
from weftgraph.streaming import incremental

BLOCKS = [
    {"block_id": "page_1_block_1", "type": "text_block", "content": " ab "}, {"block_id": "page_1_block_2", "type": "text_block", "content": "  "},
    {"block_id": "page_1_block_3", "type": "table", "caption": "T", "data": "[[\"a\", \"b\"], [\"1\", \"2\"]]"}, {"block_id": "page_1_block_4", "type": "table", "caption": "none", "data": "[[\"a\"]]"},
    {"block_id": "page_1_block_5", "type": "image", "image_type": "chart", "caption": "C", "content": {"title": "Creep", "trend": "up"}},
]


@pytest.fixture
def folder(tmp_path):
    page = {"page_number": 1, "content_blocks": BLOCKS}
    (tmp_path / "a.json").write_text(json.dumps([page, {"page_number": 2, "content_blocks": [{"block_id": "x", "type": "text_block", "content": "cde"}]}]))
    (tmp_path / "b.json").write_text(json.dumps({"paper_metadata": {"title": "P"}, "pages": [page]}))
    (tmp_path / "c.json").write_text(json.dumps(page, indent=1))
    (tmp_path / "bad.json").write_text("{not json")
    return str(tmp_path)


def test_three_shapes_of_page_files(spark, folder):
    blocks = pages.blocks_of(pages.pages_of(pages.read_files(spark, folder)))
    docs = {r.filename: r for r in pages.documents(blocks).collect()}
    assert set(docs) == {"a.json", "b.json", "c.json"} and docs["a.json"].text == "ab\n\ncde"
    assert [(s.start, s.end) for s in docs["a.json"].segments] == [(0, 2), (4, 7)] and docs["b.json"].text == "ab"
    assert docs["a.json"].document_id.startswith("doc-")
    made = pages.table_units(blocks).collect()
    assert {r.source_filename for r in made} == {"a.json", "b.json", "c.json"} and len(made) == 3
    assert made[0].text == "Caption: T\nData:\na,b\n1,2"
    image = pages.image_units(blocks).first()
    assert image.text.startswith("Caption: C\nImage Type: chart\nTitle: Creep\nTrend: up\nFull Content: {")
    assert pages.table_prompt(blocks).count() == 6


def test_unit_files_and_missing_ones(spark, tmp_path):
    units = spark.createDataFrame([("chunk-1", "t")], "id string, text string")
    sinks.write_units(units, str(tmp_path / "text"))
    got = tables.units(spark, {"text": str(tmp_path / "text"), "image": str(tmp_path / "none")})
    assert [(r.id, r.unit_type) for r in got.collect()] == [("chunk-1", "text")]
    assert tables.unit_sources(got).columns == ["chunk_id", "chunk_type", "source_filename", "pages", "blocks", "journal", "year"]


def test_abstract_tables_by_header(spark):
    rows = spark.createDataFrame([("T", " text ", "2020"), (None, "more", None), ("x", " ", "1")], "`Article Title` string, `ABSTRACT text` string, `Pub Year` string")
    got = tables.abstracts(rows).collect()
    assert [r.text for r in got] == ["text", "more"] and got[0].metadata.year == "2020" and got[1].metadata.source_filename.startswith("abstract_")
    assert tables.header_fields(["Abstract Title", "Abstract"]) == {"title": "Abstract Title", "abstract": "Abstract"}
    with pytest.raises(ValueError):
        tables.abstracts(rows.select("`Pub Year`"))


def test_graph_files(spark, tmp_path):
    lines = ['{"id": "c1", "graph": {"entities": [{"id": "e-1", "name": "A"}], "relationships": []}}', "", "{bad", '{"graph": {}}', '{"id": "c2", "graph": [{"entities": [{"id": "e-1"}]}]}']
    (tmp_path / "g.jsonl").write_text("\n".join(lines))
    got = {r.id: r for r in tables.graph_records(spark, str(tmp_path / "g.jsonl")).collect()}
    assert set(got) == {"c1", "c2"} and got["c1"].entities == [{"id": "e-1", "name": "A"}] and len(got["c2"].entities) == 1
    nodes = spark.createDataFrame([("a", "A"), ("b", None)], "id string, name string")
    edges = spark.createDataFrame([("a", "b", "R", 2.0)], "src string, dst string, relationship string, weight double")
    (tmp_path / "n.json").write_text(sinks.node_link(nodes, edges))
    n, e = tables.node_link(spark, str(tmp_path / "n.json"))
    assert sorted(r.id for r in n.collect()) == ["a", "b"] and [(r.src, r.dst, r.relationship, r.weight) for r in e.collect()] == [("a", "b", "R", 2.0)]
    (tmp_path / "m.json").write_text(json.dumps({"nodes": [], "relationships": [{"source": "x", "target": "y", "label": "L"}]}))
    assert tables.node_link(spark, str(tmp_path / "m.json"))[1].first().relationship == "L"


def test_question_and_answer_files(spark, tmp_path):
    (tmp_path / "L12.json").write_text(json.dumps([{"id": "1", "question": "q"}, {"id": "2", "question": "r", "difficulty": "L2"}]))
    (tmp_path / "L3.json").write_text(json.dumps([{"id": "1", "question": "s"}]))
    got = tables.questions(spark, str(tmp_path), ["L12", "L3"]).orderBy("global_id").collect()
    assert [(r.global_id, r.difficulty, r.source_file) for r in got] == [(1, "L1", "L12.json"), (2, "L2", "L12.json"), (3, "L3", "L3.json")]
    assert [r.global_id for r in tables.questions(spark, str(tmp_path), ["L12", "L3"], ids=["3"]).collect()] == [3]
    (tmp_path / "a.jsonl").write_text('{"id": "1", "answer": "x"}\n{"id": "2", "answer": "y"}\n')
    assert [(r.global_id, r.answer) for r in tables.answers(spark, str(tmp_path / "a.jsonl")).collect()] == [(1, "x"), (2, "y")]
    files = spark.createDataFrame([("/x/local_scores_20250101_000000.jsonl",), ("/y/local_scores_20260101_000000.jsonl",), ("/y/notes.txt",)], "path string")
    assert [(r.method, r.path) for r in tables.latest_files(files).collect()] == [("local", "/y/local_scores_20260101_000000.jsonl")]


def test_word_lists_split_at_the_last_commas(spark, tmp_path):
    (tmp_path / "w.csv").write_text("word,count,keep\nNi, Co alloys,12,Y\ngrain,3,N\n")
    assert [tuple(r) for r in tables.word_list(spark, str(tmp_path / "w.csv")).collect()] == [("Ni, Co alloys", 12, "Y")]


def test_id_maps_are_turned_round_and_merged(spark):
    rows = spark.createDataFrame([(1, "0", {"E1": "g1"}), (2, "0", {"g9": "E1", "g2": "R1"})], "level int, community_id string, local_id_map map<string,string>")
    assert {(r.local_id, r.id) for r in tables.merged_id_maps(rows).collect()} == {("E1", "g9"), ("R1", "g2")}


@pytest.mark.parametrize(("values", "expected"), [([3, 1, 2], "Page 1-3"), ([5], "Page 5"), ([1, 3, 3], "Pages 1, 3"), ([], "Page unknown")])
def test_page_ranges(spark, values, expected):
    row = spark.createDataFrame([(values,)], "p array<int>")
    assert row.select(citations.page_range(F.col("p"))).first()[0] == expected


@pytest.mark.parametrize(("values", "expected"), [
    (["page_1_block_2", "page_1_block_3"], "Block page_1_block_2~page_1_block_3"), (["page_1_block_2"], "Block page_1_block_2"), ([], "Block unknown"),
    (["page_1_block_2", "page_2_block_3"], "Blocks page_1_block_2, page_2_block_3"), (["a", "b", "c", "d"], "Blocks a~d"),
])
def test_block_ranges(spark, values, expected):
    row = spark.createDataFrame([(values,)], "b array<string>")
    assert row.select(citations.block_range(F.col("b"))).first()[0] == expected


def test_citations_are_rewritten(spark):
    sources = [("chunk-ab1", "text", "paper.json", [1, 2], ["page_1_block_1"], None, None), ("chunk-cd2", "abstract", "Title", [], [], "J", "2020")]
    sources = spark.createDataFrame(sources, "chunk_id string, chunk_type string, source_filename string, pages array<int>, blocks array<string>, journal string, year string")
    answers = spark.createDataFrame([(1, "A [Data: Entities (chunk-ab1-e-3, 0_3_1)] b (E1)  c [cite: chunk-cd2, chunk-ff] d"), (2, "plain"), (3, None)], "id int, answer string")
    got = {r.id: r.answer for r in citations.rewrite_citations(answers, sources).collect()}
    assert got == {1: "A [source: community 0_3_1; paper Page 1-2 Block page_1_block_1] b c [source: Title, J, 2020] d", 2: "plain", 3: None}


def test_relation_groups(spark):
    rows = spark.createDataFrame([("varies_with",), ("HAS_VALUE_AT",), ("OPTIMIZES",), (None,), (" lacks ",)], "r string")
    got = [r[0] for r in rows.select(relations.relation_group(F.col("r"))).collect()]
    assert got == ["CORRELATES_WITH", "HAS_OR_EXHIBITS", "OTHER", "OTHER", "NO_EFFECT_OR_EXCLUDES"]


def test_embedding_text_and_templates(spark):
    row = spark.createDataFrame([("E1 and E12 [Data: x (1)] meet  (E1) $5", {"E1": "Ann", "E12": "B$b"})], "t string, m map<string,string>")
    assert row.select(text.embedding_text(F.col("t"), F.col("m"))).first()[0] == "Ann and B$b meet $5"
    assert row.select(text.filled("Hi $name, {other} $names", name=F.lit("A"), other=F.lit("B"), names=F.lit("C"))).first()[0] == "Hi A, B C"
    assert row.select(text.plain_digits(F.lit("M₂₃C⁶"))).first()[0] == "M23C6"


def test_tolerant_json(spark):
    cases = ['```json\n{"a": 1,}\n```', "note {\"a\": 1} end", "{a: 1}", "{'a': 1}", "nothing", None]
    assert [text.tolerant_json(c) for c in cases] == [{"a": 1}] * 4 + [None] * 2
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(F.try_variant_get(text.tolerant_variant(F.col("t")), "$.a", "int"))
    assert [r[0] for r in rows.collect()][:2] == [1, 1]
    ok = '{"response": {"status_code": 200, "body": {"choices": [{"message": {"content": "hi"}}]}}}'
    got = spark.createDataFrame([(ok,), (ok.replace("200", "500"),), ("x",)], "t string").select(text.batch_content(F.col("t"))).collect()
    assert [r[0] for r in got] == ["hi", None, None]


def test_ids(spark):
    keys = ids.repaired_keys(F.lit("chunk_a_b-e-3"))
    assert list(spark.range(1).select(*keys).first()) == ["chunk_a_b-e-3", "chunk-a-b-e-3", "chunk-a-b_e-3"]
    assert spark.range(1).select(ids.base_chunk(F.lit("chunk-ab12-e-3")), ids.is_community(F.lit("0_3_1"))).first() == ("chunk-ab12", True)


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "A", "Phase", {"name": "other", "k": "v"}, float("nan")), ("b", None, "", None, 1.0)], "id string, name string, type string, attributes map<string,string>, x double")
    got = {r.properties["id"]: r for r in sinks.property_nodes(nodes.drop("x")).collect()}
    assert got["a"].label == "Phase" and got["a"].properties == {"id": "a", "name": "A", "k": "v"} and got["b"].label == "Thing"
    edges = spark.createDataFrame([("a", "b", "")], "src string, dst string, relationship string")
    assert sinks.property_edges(edges).first().type == "RELATED_TO"
    xml = sinks.gexf(nodes, edges)
    assert 'source="a"' in xml and 'for="x" value="0.0"' in xml and 'for="attributes_k"' in xml
    rows = sinks.vector_rows(spark.createDataFrame([("1", "x", ["p"])], "level string, rating string, tags array<string>"), ["tags"]).first()
    assert (rows.level, rows.rating, rows.payload_tags_json) == (1, 0.0, '["p"]')
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).count() == 1


def test_config_profiles():
    base = {"a": {"b": 1, "c": 2}, "ablation": {"x": {"a": {"b": 5}}}}
    assert with_profile(base, "x")["a"] == {"b": 5, "c": 2} and deep_merge({"a": 1}, {"a": {"b": 2}}) == {"a": {"b": 2}}
    with pytest.raises(KeyError):
        with_profile(base, "y")


def test_manifest_goes_on_after_a_failure(tmp_path):
    ran, fail = [], [True]

    def second():
        if fail[0]:
            raise RuntimeError
        ran.append("b")

    steps = [("a", lambda: ran.append("a")), ("b", second), ("c", lambda: ran.append("c"))]
    with pytest.raises(RuntimeError):
        Manifest(str(tmp_path / "m.json")).run(steps)
    fail[0] = False
    assert Manifest(str(tmp_path / "m.json")).run(steps) == ["b", "c"] and ran == ["a", "b", "c"]


@pytest.mark.parametrize(("question", "expected"), [("Why does X crack?", ("REASONING", 1)), ("Give an overview of all alloys", ("GLOBAL", 0)), ("What is X?", ("LOCAL", 1)), ("X versus Y in detail", ("DRIFT", 2))])
def test_routes(question, expected):
    assert flows.route(question) == expected
    assert flows.route("why?", has_graph_model=False)[0] == "DRIFT"


def test_a_graph_is_built_and_asked(spark):
    units = spark.createDataFrame([("c1", "Nickel strengthens Alloy near Gamma phases. Creep follows."), ("c2", "Nickel and Cobalt form Gamma. Rhenium slows Creep.")], "id string, text string")
    built = flows.build_graph(units, providers.Stub, least=0.99)
    nodes, edges = built["nodes"].cache(), built["edges"].cache()
    names = [r.name for r in nodes.collect()]
    assert len(names) == len(set(names)) and {"Nickel", "Gamma", "Creep"} <= set(names)  # equal names were merged
    known = {r.id for r in nodes.collect()}
    assert all(r.src in known and r.dst in known and r.src != r.dst for r in edges.collect())

    vectors = providers.embed_column(nodes.select("id", "name"), "name", "vector", providers.Stub).select("id", "vector")
    reports = nodes.select("community").distinct().withColumn("text", F.concat(F.lit("about "), "community")).withColumn("level", F.lit(1)).withColumn("rating", F.lit(5.0))
    reports = providers.embed_column(reports, "text", "vector", providers.Stub)
    graph = flows.Graph(nodes, edges, vectors, units.select(F.col("id").alias("chunk_id"), "text"), reports)
    stub = providers.Stub()
    answer, sections = flows.ask_local(graph, "What is Nickel?", stub, k=2)
    assert "Nickel" in answer and [r.section for r in sections.orderBy("position").collect()][:2] == ["Entities", "Relationships"]
    answer, points = flows.ask_global(graph, "overview", providers.Stub, level=1, least_rating=1.0)
    assert answer and points.count() >= 1
    assert flows.ask_drift(graph, "Nickel versus Cobalt", stub, steps=1, k=2)[0]
    answer, paths = flows.ask_reasoning(graph, "Why Creep?", ["Nickel"], stub, k=3)
    assert paths.count() >= 1 and answer
    units_v = providers.embed_column(units, "text", "vector", providers.Stub)
    assert flows.ask_basic(units_v, "Rhenium", stub, 1)[1].first().id == "c2"
    assert flows.report_row("0", "no json") == {"community_id": "0", "level": 1, "report_raw": "no json"}
    chosen, kept = communities.report_context(edges.withColumn("importance", F.col("weight")), built["labels"])
    assert chosen.count() >= 1 and {"local_id"} <= set(kept.columns)


def test_new_files_are_chunked_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc_id int, text string"
    for k, body in enumerate(["abcdefghij", "xyz"]):
        spark.createDataFrame([(k, body)], schema).write.mode("append").parquet(source)
        incremental.chunk_new_files(spark, source, schema, out, str(tmp_path / "state"), 4, 1).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["abcd", "defg", "ghij", "xyz"]


def test_event_windows(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 3.0D UNION ALL SELECT timestamp'2024-01-01 01:10:00', 'a', 5.0D")
    assert [(r.n, r.mean) for r in incremental.event_windows(rows).orderBy("start").collect()] == [(2, 2.0), (1, 5.0)]

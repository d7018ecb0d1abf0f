"""What models write and judge: prompts, retries, resume; batches, steps, readers and refinement."""

import io
import json

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import ids
from weftgraph.operators import communities, stats, walks
from weftgraph.plans import batches, judging, providers, reports
from weftgraph.plans.manifest import Manifest
from weftgraph.sources.arrays import array_items


def _never():
    class Provider:
        def complete(self, prompts):
            raise AssertionError("asked again")

        def embed(self, texts):
            raise AssertionError("asked again")

    return Provider()


def test_descriptions_are_written_for_blank_ones_only(spark):
    nodes = spark.createDataFrame([("a", "A", ""), ("b", "B", "known"), ("c", None, None)], "id string, name string, description string")
    edges = spark.createDataFrame([("a", "b", "MAKES", 2.0), ("c", "a", None, 5.0)], "src string, dst string, relationship string, weight double")
    got = {r.id: r.description for r in reports.described(nodes, edges, providers.Stub).collect()}
    assert got == {"a": "A\n<- RELATED_TO c\n-> MAKES B", "b": "known", "c": "c\n-> RELATED_TO A"}
    cut = {r.id: r.prompt for r in reports.description_prompts(nodes, edges, 1).collect()}
    assert cut["a"] == "TASK describe\nA\n<- RELATED_TO c"


def test_reports_go_up_and_go_on_where_they_stopped(spark, tmp_path):
    levels = [(0, i, "0") for i in "abcd"] + [(1, "a", "0_0"), (1, "b", "0_0"), (1, "c", "0_1"), (1, "d", "0_1")]
    levels = spark.createDataFrame(levels, "level int, id string, community string")
    edges = spark.createDataFrame([("a", "b", 1.0, "R"), ("c", "d", 2.0, "R"), ("a", "c", 3.0, "R")], "src string, dst string, importance double, relationship string")
    nodes = spark.createDataFrame([(i, f"N{i}") for i in "abcd"], "id string, name string")
    path = str(tmp_path / "reports")
    first = {(r.level, r.community): r for r in reports.community_reports(levels, edges, nodes, providers.Stub, path).collect()}
    assert set(first) == {(0, "0"), (1, "0_0"), (1, "0_1")}
    assert first[1, "0_0"].title == "E1 Nb" and [f.summary for f in first[1, "0_0"].findings] == ["E1 Nb", "E2 Na", "R1 Na R Nb"]
    assert "### E1 Nb" in first[0, "0"].summary and "### E1 Nd" in first[0, "0"].summary  # from its children, not from the nodes
    again = reports.community_reports(levels, edges, nodes, _never, path)
    assert {(r.level, r.community): r for r in again.collect()} == first
    import shutil

    shutil.rmtree(f"{path}/level-0")
    asked = []

    class Watched(providers.Stub):
        def complete(self, prompts):
            asked.extend(prompts)
            return ["no json" for _ in prompts]

    top = [r for r in reports.community_reports(levels, edges, nodes, Watched, path).collect() if r.level == 0]
    assert [(r.raw, r.title, r.findings) for r in top] == [("no json", None, [])]


def test_retries_wait_longer_and_end():
    waits, answers = [], ["bad", OSError("down"), '{"score": 2}']

    def complete(prompts):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return [x]

    take = lambda told: judging.read_scores(told, ["score"])
    assert judging.answered_with_retry(complete, "p", take, 3, 0.5, waits.append) == ({"score": 1.0}, 3) and waits == [0.5, 1.0]
    assert judging.answered_with_retry(lambda p: ["bad"], "p", take, 2, 0.5, waits.append) == (None, 2)
    assert judging.read_scores('```json\n{"score": "0.5", "x": -3,}\n```', ["score", "x"]) == {"score": 0.5, "x": 0.0}
    assert judging.read_scores('{"score": "high"}', ["score"]) is None and judging.read_scores("", ["score"]) is None


def test_judges_score_rows_and_leave_failures_null(spark):
    rows = spark.createDataFrame([(1, "q", "red fox", "The red one"), (2, "q", "", None), (3, None, "a b", "b a")], "id int, question string, truth string, answer string")
    assert {r.id: r.score for r in judging.judged(rows, providers.Stub, wait=0.0).collect()} == {1: 0.5, 2: 1.0, 3: 1.0}

    class Broken(providers.Stub):
        def complete(self, prompts):
            return ["nothing"]

    assert {r.score for r in judging.judged(rows, Broken, wait=0.0).collect()} == {None}
    assert judging.judged(rows.limit(0), providers.Stub).count() == 0


def test_evaluations_ask_only_what_lacks(spark, tmp_path):
    questions = spark.createDataFrame([(i, f"word{i} here", f"word{i}") for i in range(6)], "id int, question string, truth string")
    path = str(tmp_path / "runs")
    judging.evaluate(questions.where("id < 4"), {"m": providers.Stub}, providers.Stub, path, wait=0.0)

    class Shy(providers.Stub):
        def complete(self, prompts):
            if any("word1 " in p or "word2 " in p for p in prompts):
                raise AssertionError("asked again")
            return super().complete(prompts)

    out = judging.evaluate(questions, {"m": Shy}, Shy, path, wait=0.0)
    assert sorted((r.id, r.method, r.score) for r in out.collect()) == [(i, "m", 1.0) for i in range(6)]
    assert json.loads(judging.summary_json(out).first().summary) == [{"method": "m", "n": 6, "mean": 1.0, "low": 1.0, "high": 1.0}]
    assert judging.evaluate(questions, {"m": _never}, _never, path).count() == 6


def test_prompts_are_remembered(spark, tmp_path):
    rows = spark.createDataFrame([(1, "TASK keywords\nturbine turbine bearing"), (2, "TASK keywords\nturbine turbine bearing"), (3, None)], "id int, p string")
    first = providers.remembered_column(rows, "p", "told", providers.Stub, str(tmp_path / "k")).collect()
    again = providers.remembered_column(rows, "p", "told", _never, str(tmp_path / "k")).collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str) and len(first) == 3
    assert spark.read.parquet(str(tmp_path / "k/part-0")).count() == 2


def test_batch_jobs_are_submitted_once_and_polled(spark, tmp_path):
    ok = lambda k, text: json.dumps({"custom_id": k, "response": {"status_code": 200, "body": {"choices": [{"message": {"content": text}}]}}})
    (tmp_path / "a.out").write_text(ok("x", "one") + "\n" + json.dumps({"custom_id": "y", "response": {"status_code": 500}}) + "\n")

    class Service:
        asked, sent = 0, []

        def submit(self, path):
            self.sent.append(path)
            return f"job-{path}"

        def status(self, job):
            self.asked += 1
            return "failed" if job == "job-b" else "completed" if self.asked > 3 else "in_progress"

        def result(self, job):
            return str(tmp_path / "a.out")

    service, waits = Service(), []
    jobs = batches.submitted(service, ["a", "b"], {"b": "job-b"})
    assert jobs == {"a": "job-a", "b": "job-b"} and service.sent == ["a"]
    found = batches.polled(service, jobs, 5.0, 10, waits.append)
    assert found == {"a": "completed", "b": "failed"} and waits and set(waits) == {5.0}
    assert {r.custom_id: r.content for r in batches.batch_answers(spark, service, jobs, found).collect()} == {"x": "one", "y": None}
    assert batches.batch_answers(spark, service, jobs, {"a": "failed"}).count() == 0
    assert batches.polled(service, {"c": "job-c"}, 0.0, 0) == {"c": "validating"}


def test_steps_need_files_and_start_by_name(tmp_path):
    ran, need = [], tmp_path / "in"
    steps = [(n, lambda n=n: ran.append(n)) for n in ("extract", "merge", "report")]
    manifest = Manifest(str(tmp_path / "m.json"))
    with pytest.raises(FileNotFoundError, match="merge needs"):
        manifest.run(steps, needs={"merge": [str(need)]})
    need.mkdir()
    (need / "x").write_text("1")
    assert manifest.run(steps, needs={"merge": [str(need)]}) == ["merge", "report"]
    assert Manifest(str(tmp_path / "m.json")).run(steps, "merge") == ["merge", "report"] and ran == ["extract", "merge", "report", "merge", "report"]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64, 1 << 20])
def test_array_items_come_a_piece_at_a_time(piece):
    items = [{"source": "é\"]{", "weight": 1.25}, 12, "日本", None, [1, [2]], -3e5, True]
    text = json.dumps({"nodes": [{"links": [9]}], "n": 123, "graph": {"links": [1]}, "relationships": items, "z": []}, ensure_ascii=False, indent=1)
    read = lambda *keys: list(array_items(io.BytesIO(text.encode()), keys, piece))
    assert read("links", "relationships") == items and read("z") == [] and read("none") == [] and read("nodes") == [{"links": [9]}]
    assert list(array_items(io.BytesIO(b""), piece=piece)) == []
    with pytest.raises(ValueError):
        list(array_items(io.BytesIO(b'{"links": [1, 2'), piece=piece))


def test_refined_communities_are_connected_and_good(spark):
    cliques = [(g, i, j) for g in range(6) for i in range(6) for j in range(i + 1, 6)]
    pairs = [(f"n{g}{i}", f"n{g}{j}") for g, i, j in cliques] + [(f"n{g}0", f"n{(g + 1) % 6}1") for g in range(6)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    nodes = stats.degrees(edges).select("id").union(spark.createDataFrame([("alone",)], "id string"))
    got = {r.id: r.community for r in communities.refined_moves(edges, nodes).collect()}
    assert len(got) == 37 and got["alone"] == "alone"
    assert all(len({got[f"n{g}{i}"] for i in range(6)}) == 1 for g in range(6)) and len(set(got.values())) == 7
    plain = communities.local_moves(edges, nodes)
    refined = communities.refined_moves(edges, nodes)
    value = lambda labels: stats.modularity(edges, labels).first()[0]
    assert value(refined) >= value(plain) - 1e-9


def test_chunks_and_type_vectors(spark):
    rows = spark.createDataFrame([(1, "c-1", None), (2, None, '["u-1", "u-2"]'), (3, " ", ""), (4, '["a"]', "u")], "n int, c string, u string")
    assert {r.n: r.x for r in rows.select("n", ids.chunk_ids(F.col("c"), F.col("u")).alias("x")).collect()} == {1: ["c-1"], 2: ["u-1", "u-2"], 3: [], 4: ["a"]}
    types = spark.createDataFrame([(f"t{i}", i) for i in range(40)], "edge_type string, type_id int")
    got = {r.edge_type: r.vector for r in walks.type_vectors(types, spark.createDataFrame([("t3", [1.0, 2.0])], "edge_type string, vector array<double>"), 2, 5).collect()}
    noise = [x for k, v in got.items() if k != "t3" for x in v]
    assert got["t3"] == [1.0, 2.0] and len(set(noise)) == 78 and max(map(abs, noise)) < 0.05 and abs(sum(noise)) / 78 < 0.004

"""The forest against MLlib's own trees and on findings of kinds it has not seen."""

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_texts
from weftgraph.llm import secret_scan


@pytest.fixture(scope="module")
def findings(spark):
    return secret_scan.Scratch(spark, "test-findings").keep(secret_scan.labelled_findings(spark, 3000), "rows")


@pytest.fixture(scope="module")
def model(findings):
    return secret_scan.fit(findings)


def test_votes_equal_a_walk_of_the_models_trees(findings, model):
    from pyspark.ml.linalg import Vectors

    forest = secret_scan.flatten(model)
    x = secret_scan.features(F.col("run"), F.col("before"), F.col("after"))
    rows = findings.select(x.alias("x")).distinct().limit(120).select("x", secret_scan.vote(forest, F.col("x")).alias("s")).collect()
    for r in rows:
        votes = [tree.predict(Vectors.dense(r.x)) for tree in model.trees]
        assert r.s == pytest.approx(sum(votes) / len(votes))
    assert len({r.s for r in rows}) >= 8


def test_findings_of_kinds_held_out_are_told_apart(findings):
    """Each quarter of the templates is left out of a training and judged; all four count together."""
    x = secret_scan.features(F.col("run"), F.col("before"), F.col("after"))
    n = {}
    for part in range(4):
        forest = secret_scan.train(findings.where(F.col("kind") % 4 != part))
        judged = findings.where(F.col("kind") % 4 == part).select("label", (secret_scan.vote(forest, x) >= secret_scan.THRESHOLD).alias("found"))
        for r in judged.groupBy("label", "found").count().collect():
            n[r.label, r.found] = n.get((r.label, r.found), 0) + r["count"]
    hit, missed, false = n[1, True], n[1, False], n[0, True]
    assert hit + missed > 800 and hit / (hit + missed) >= 0.85 and hit / (hit + false) >= 0.7


def test_names_and_values_are_candidates_of_their_own(spark, model):
    key = "1eb9c654e721b4f812088970e66a6345cee33dd6"
    texts = [f"token={key}", f"api_key={key} x", f"password={key}", "password: Tr0ub4dor&3", "api_key = QWERTYUIOPASDFGH", f"my_service_account_token = '{key}'", "ends QUJDREVGR0hJSktMTU5PUA==", "my_service_account_label = 'house'"]
    rows = {r.doc_id: r for r in secret_scan.scan(documents(spark, texts), secret_scan.flatten(model)).collect()}
    found = {k: [texts[k][s.start : s.stop] for s in rows[k].secrets] for k in range(6)}
    assert found == {0: [key], 1: [key], 2: [key], 3: ["Tr0ub4dor"], 4: ["QWERTYUIOPASDFGH"], 5: [key]}
    assert [rows[k].n_candidates for k in range(8)] == [1, 1, 1, 1, 1, 2, 1, 2]
    assert rows[7].n_secrets == 0


def test_neighbouring_words_of_any_length_count(spark):
    x = lambda before, after: secret_scan.features(F.lit("Zq8" * 9), F.lit(before), F.lit(after))[secret_scan.FEATURES.index("secret_word")]
    long = "ü" * 5000
    got = spark.range(1).select(x(f"password {long} {long} ", "").alias("a"), x(f"password {long} {long} b ", "").alias("b"), x("", f" {long}password").alias("c"), x("", f" {long} password").alias("d")).first()
    assert tuple(got) == (1.0, 0.0, 1.0, 0.0)


def test_columns_that_clash_stay_as_they_are(spark, model):
    forest = secret_scan.flatten(model)
    docs = documents(spark, ['so token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', *odd_texts()]).selectExpr("*", "'r' AS runs", "1 AS gaps", "2 AS found", "3 AS Tails", "4 AS heads", "5 AS `a.b`")
    rows = secret_scan.redact(docs, forest)
    assert rows.columns == docs.columns
    got = {r.doc_id: r for r in rows.collect()}
    assert got[0].text == 'so token = "[SECRET]"' and all((r.runs, r.gaps, r.found, r.Tails, r.heads, r["a.b"]) == ("r", 1, 2, 3, 4, 5) for r in got.values())
    assert secret_scan.redact(docs.limit(0), forest).count() == 0 and secret_scan.scan(docs.limit(0), forest).count() == 0

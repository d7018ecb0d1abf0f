"""The classifier's flat trees against a walk node by node, and empty tables."""

import numpy as np
import pytest

from tests.llm.helpers import documents, odd_texts
from weftgraph.llm import byte_bpe, doc_stats, quality_classifier, warc_archive
from weftgraph.llm.queries import BYTE_VOCABULARY
from weftgraph.llm.runtime import Scratch


def _walk(forest, row):
    margin = forest.base
    for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        margin += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-margin))


def test_scores_equal_a_walk_of_every_tree(spark):
    rng = np.random.default_rng(6)
    width = len(doc_stats.FEATURES)
    x = np.round(rng.normal(size=(600, width)), 1)  # many values equal a cut
    forest = quality_classifier.fit(x, (x[:, 1] + x[:, 4] * x[:, 7] > 0.2).astype(float), trees=25)
    assert len(forest.feature) == 25
    assert forest.score(x) == pytest.approx([_walk(forest, r) for r in x])
    texts = odd_texts()
    stats = doc_stats.features(doc_stats.statistics(spark.createDataFrame([(t,) for t in texts], "text string").toArrow()["text"]))
    got = {r.doc_id: r.score for r in quality_classifier.score(documents(spark, texts, extra=True), forest).collect()}
    assert got == pytest.approx({k: _walk(forest, stats[k]) for k in range(len(texts))})


def test_columns_of_any_name_stay(spark):
    docs = documents(spark, ["a b c", None]).selectExpr("*", "1 AS `a.b`", "2 AS c0", "3 AS score", "4 AS m0")
    kept = quality_classifier.keep_good(docs, quality_classifier.fit(np.zeros((0, len(doc_stats.FEATURES))), np.zeros(0)), 0.5)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.orderBy("doc_id").collect()] == [tuple(r) for r in docs.orderBy("doc_id").collect()]


def test_empty_tables_give_no_rows(spark):
    import public_tokenizers

    assert byte_bpe.encode_and_decode(documents(spark, []), BYTE_VOCABULARY, public_tokenizers.PATTERN, digests=True).count() == 0
    path = Scratch(spark, "warc-empty").root
    warc_archive.write_archive(spark.createDataFrame([], "record_id long, url string, payload binary, sha256 string"), path)
    assert warc_archive.read_archive(spark, path).count() == 0 and warc_archive.original_records(spark, path).count() == 0

"""A corpus pipeline over ``documents``: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) and works on all documents that the
stage before kept. All but the last return the columns of ``documents``.

Defined results: doc_id is meant to be the key of ``documents``. Rows without one,
and rows that share one, are documents of their own in all stages, but equal rows
count as copies and one of them stays. A null text is an empty one: the classifier
judges it by counts of zero, it has no near copies, and it is packed as an end
mark. Texts of any length go through whole. Ties between copies go to the smallest
doc_id. Further columns are carried along, whatever their names, and n_chars is
brought in line where there is one. Empty tables give no rows; without labels the
classifier's score is 0.5 for all, below the cutoff, so nothing is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import best_fit_packing, ngram_join, quality_classifier, secret_scan, substring_dedup
from weftgraph.llm.queries import WORD_VOCABULARY
from weftgraph.llm.runtime import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.7) go."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id."""
    return ngram_join.keep_one_of_each(docs)


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars, if there is one, brought in line with a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that start in an earlier document too are cut out."""
    return _measured(substring_dedup.remove_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked."""
    return _measured(secret_scan.redact(docs, secret_scan.train(secret_scan.labelled_findings(spark))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2048 tokens."""
    return best_fit_packing.pack_documents(spark, docs, WORD_VOCABULARY)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]

#: The classifier's and the forest's scores and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread as the next one's input."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)

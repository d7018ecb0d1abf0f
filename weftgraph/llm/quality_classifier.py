"""Quality scores by histogram gradient-boosted trees.

Inputs are statistics of the whole text and nothing else. Training bins every
statistic by quantiles, grows trees of a fixed depth level by level from
gradient histograms, and stores the forest as flat arrays, one row per tree;
scoring walks all rows of a batch through a tree at once.

Scale: the forest is fitted on the driver from at most ``max_train`` labelled
documents (those with the smallest hash of their id), whose ids are broadcast:
16 bytes each, so 320 kB with the default. Scoring is narrow: one pass over the
texts, no shuffle.

Defined results: a null text is an empty one and gets the score of a text whose
counts are all zero. A document with several labels counts with the smallest;
labels that are null or belong to no document are left out. Without any usable
label, or with one class only, every score is the smoothed share of label 1 (0.5
without labels). Rows that repeat are scored each. Texts of any length are counted
whole. Splits of equal gain go to the first statistic and the lowest cut, and a
value that equals a cut goes left. Other columns are ignored by score() and kept
by keep_good(). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .doc_stats import FEATURES, features, statistics
from .runtime import bounded_batches, map_texts, only

MAX_TRAIN = 20_000
THRESHOLD = 0.7


class Forest(NamedTuple):
    """Complete binary trees: node k has children 2k+1 and 2k+2."""

    feature: np.ndarray  # int32 [trees, inner nodes]
    cut: np.ndarray  # float64 [trees, inner nodes]; left if value <= cut
    leaf: np.ndarray  # float64 [trees, leaves]
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12, smooth: float = 2.0, least: float = 1.0) -> Forest:
    """Boost trees on the logistic loss; y is 0 or 1."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    n, width = x.shape
    feature, cut, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            size, start = 1 << level, (1 << level) - 1
            local = node - start
            best_gain, best_feature, best_bin = np.zeros(size), np.zeros(size, np.int64), np.full(size, -1)
            for j in range(width):
                key = local * bins + binned[:, j]
                g = np.bincount(key, grad, size * bins).reshape(size, bins)
                h = np.bincount(key, hess, size * bins).reshape(size, bins)
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + smooth) + (gt - gl) ** 2 / (ht - hl + smooth) - gt**2 / (ht + smooth)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(size), at]
                better = top > best_gain + 1e-9
                best_gain[better], best_feature[better], best_bin[better] = top[better], j, at[better]
            for k in np.flatnonzero(best_bin >= 0):
                feature[t, start + k], cut[t, start + k] = best_feature[k], cuts[best_feature[k]][best_bin[k]]
            right = (best_bin[local] >= 0) & (binned[np.arange(n), best_feature[local]] > best_bin[local])
            node = 2 * node + 1 + right
        local = node - inner
        g, h = np.bincount(local, grad, leaves), np.bincount(local, hess, leaves)
        leaf[t] = rate * g / (h + smooth)
        margin += leaf[t][local]
    return Forest(feature, cut, leaf, base)


def held_out(doc_id: Column) -> Column:
    """The quarter of documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _rows(docs: DataFrame) -> DataFrame:
    return only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _labelled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(statistics(batch["text"]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], *[pa.array(c) for c in x.T]], names=["doc_id", "quality", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Forest:
    """Fit on at most max_train labelled documents outside the held-out part."""
    bounded_batches(docs.sparkSession, megabytes=4)
    known = only(labels, doc_id="doc_id", quality="quality").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)  # the fit's bound, and the broadcast's
    schema = "doc_id long, quality int, " + ", ".join(f"{c} double" for c in FEATURES)
    rows = _rows(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(_labelled_features, schema)
    # repeated rows of a document train it once, so the driver gets max_train rows at most
    one = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), *[F.min(c).alias(c) for c in FEATURES]).toPandas().sort_values("doc_id")
    return fit(one[list(FEATURES)].to_numpy(np.float64), one["quality"].to_numpy(np.float64))


def score(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    bounded_batches(docs.sparkSession, megabytes=4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(forest.score(features(statistics(batch["text"]))))], names=["doc_id", "score"])

    scored = _rows(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, all columns unchanged."""
    bounded_batches(docs.sparkSession, megabytes=4)

    def change(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        return batch.filter(pa.array(forest.score(features(statistics(batch.column(at)))) >= threshold))

    return map_texts(docs, change)

"""Quality rules whose cutoffs come with a guarantee on false rejection.

Each rule rejects a document when one of its statistics passes a cutoff; every
rule has a ladder of cutoffs from lenient to strict. The labelled documents that
pass the base rule are dealt into two parts by a hash of their doc_id. A quarter
of them orders the steps of all ladders into one path: only steps that reject a
larger share of the bad than of the good, those that reject fewest good ones
first, and each only if it rejects a bad one that those before it do not. The
other three quarters are the holdout. In every stratum (language) the
path is followed there as one fixed sequence: with each further step all steps so
far reject together, and the sequence goes on while an exact binomial test
refutes, at level delta / strata, that they reject more than ``max_false`` of the
stratum's good documents (a fixed sequence costs no correction; Bonferroni over
the strata that are tested). So with probability 1 - delta no stratum loses more
than ``max_false`` of the good documents that pass the base rule.

A stratum is tested if its holdout is large enough for a cutoff that rejects none
of it to pass; which ones are, follows from the sizes alone. In all others, and
where the first step fails, nothing is certified and no rule rejects: kept is
then the base rule's verdict. Steps that reject equally many good documents go by
how many bad ones they reject, then by rule and place in the ladder.

Scale: one narrow pass computes all statistics; thresholds use every labelled
row through histogram aggregates of (rule, step), of first steps, and of (stratum,
place in the path). Strata too small to certify anything are left out before the driver
sees them, so it gets at most one row a step for every ``least_holdout``
labelled documents.

Defined results: a null text has no words and fails the base rule; a null
language is a stratum of its own; several labels of one document count with
the smallest. Rows that repeat are judged each. Texts of any length are counted
whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .doc_stats import COUNTS, statistics
from .runtime import Scratch, bounded_batches, only

#: Rule -> (numerator, denominator, cutoffs from lenient to strict). Rejected: numerator > cutoff x denominator.
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "n_words", (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05, 0.02)),
    "repeats": ("n_repeat_words", "n_words", (0.48, 0.44, 0.4, 0.36, 0.32, 0.28, 0.24, 0.2, 0.15, 0.1, 0.05, 0.02)),
    "capitals": ("n_caps_words", "n_words", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "word_length": ("word_chars", "n_words", (40.0, 30.0, 20.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0, 7.5, 7.0, 6.5, 6.0)),
    "top_word": ("n_top_word", "n_words", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08)),
}
_EXTRA = tuple(dict.fromkeys(c for n, d, _ in RULES.values() for c in (n, d) if c not in COUNTS))
STATS = (*COUNTS, *_EXTRA)


def binomial_tail(rejected: int, n: int, risk: float) -> float:
    """P(Binomial(n, risk) <= rejected), summed exactly in logarithms."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk) for k in range(min(rejected, n) + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certify(counts: dict[tuple[object, str], tuple[int, list[int]]], risk: float, delta: float, ladders: dict[str, tuple] | None = None) -> dict[tuple[object, str], float]:
    """Strictest certified step by (stratum, sequence).

    counts: the good documents of a stratum and how many each step rejects;
    ladders: the steps of each sequence, those of the rules if not given.
    """
    ladders = ladders or {rule: steps for rule, (_, _, steps) in RULES.items()}
    level = delta / max(1, len(counts))
    chosen: dict[tuple[object, str], float] = {}
    for (stratum, name), (n, rejected) in counts.items():
        for step, k in zip(ladders[name], rejected, strict=True):
            if k > risk * n or binomial_tail(k, n, risk) > level:
                break
            chosen[stratum, name] = step
    return chosen


def least_holdout(risk: float, level: float) -> int:
    """Good documents below which no step can be certified at a level."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def tested(sizes: dict[object, int], risk: float, delta: float) -> list[object]:
    """The most strata, larger ones first, that can share delta and each still certify a step."""
    order = sorted(sizes, key=lambda s: (-sizes[s], repr(s)))
    return order[: max((m for m in range(1, len(order) + 1) if sizes[order[m - 1]] >= least_holdout(risk, delta / m)), default=0)]


def path_of(shares: dict[tuple[str, int], tuple[float, float]]) -> list[tuple[str, float]]:
    """Steps (rule, cutoff) in the order of the path; shares: good and bad ones that a step rejects."""
    places = list(RULES)
    useful = sorted((g, -b, places.index(rule), k) for (rule, k), (g, b) in shares.items() if b > g)
    return [(places[r], RULES[places[r]][2][k]) for _, _, r, k in useful]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and all counts, one row for every row of docs."""
    bounded_batches(docs.sparkSession, megabytes=4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = statistics(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["stratum"], *[pa.array(s[c]) for c in STATS]], names=["doc_id", "stratum", *STATS])

    rows = only(docs, doc_id="doc_id", text="text", stratum="lang")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("stratum").cast("string").alias("stratum"))
    return rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in STATS))


def rejected_steps(rule: str):
    """How many steps of a rule's ladder reject a row: its strictest ones."""
    top, bottom, cutoffs = RULES[rule]
    return sum(((F.col(top) > c * F.col(bottom)).cast("int") for c in cutoffs), F.lit(0))


#: Of so many parts of the labelled documents one orders the path.
PARTS = 4


def _path(labelled: DataFrame) -> list[tuple[str, float]]:
    """The path, from the part that orders it."""
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), rejected_steps(r).alias("steps")) for r in RULES])).alias("x")
    n = {True: 0, False: 0}
    rejected = {(rule, k): {True: 0, False: 0} for rule, (_, _, cutoffs) in RULES.items() for k in range(len(cutoffs))}
    for good, rule, passed, count in labelled.where("part = 0").select("good", steps).groupBy("good", "x.rule", "x.steps").count().collect():
        n[good] += count * (rule == next(iter(RULES)))
        steps_of = len(RULES[rule][2])
        for k in range(steps_of - passed, steps_of):  # the strictest ones
            rejected[rule, k][good] += count
    path = path_of({step: tuple(x[good] / max(1, n[good]) for good in (True, False)) for step, x in rejected.items()})
    first = labelled.where("part = 0 and not good").groupBy(_place(path).alias("place")).count().collect()
    return [path[k] for k in sorted(place for place, _ in first if place < len(path))]


def _place(path: list[tuple[str, float]]):
    """Number of the first step that rejects a row, len(path) if none does."""
    place = F.lit(len(path))
    for k in reversed(range(len(path))):
        top, bottom, _ = RULES[path[k][0]]
        place = F.when(F.col(top) > path[k][1] * F.col(bottom), k).otherwise(place)
    return place


def thresholds(stats: DataFrame, labels: DataFrame, max_false: float = 0.02, delta: float = 0.05) -> dict[tuple[object, str], float]:
    """Certified cutoffs by (stratum, rule) from all labelled rows; stats should be a stored table."""
    known = only(labels, key="doc_id", quality="quality").where(F.col("key").isNotNull()).groupBy(F.col("key").cast("long").alias("key")).agg(F.min("quality").alias("quality")).where("quality IS NOT NULL")
    rows = stats.join(known.select("key", (F.col("quality") == 1).alias("good")), F.col("doc_id") == F.col("key")).where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words")
    labelled = Scratch(stats.sparkSession, "labelled").keep(rows.select("stratum", "good", F.pmod(F.xxhash64("key"), F.lit(PARTS)).alias("part"), *STATS), "rows")
    path = _path(labelled)
    if not path:
        return {}
    holdout = labelled.where("good and part > 0").select("stratum", _place(path).alias("place"))
    large = holdout.groupBy(F.col("stratum").alias("large")).agg(F.count("*").alias("m")).where(F.col("m") >= least_holdout(max_false, delta))
    found: dict[object, list[int]] = {}
    for stratum, at, n in holdout.groupBy("stratum", "place").agg(F.count("*").alias("n")).join(large, F.col("stratum").eqNullSafe(F.col("large")), "left_semi").collect():
        found.setdefault(stratum, [0] * (len(path) + 1))[at] += n
    counts = {(s, "path"): (sum(found[s]), list(accumulate(found[s]))[:-1]) for s in tested({s: sum(x) for s, x in found.items()}, max_false, delta)}
    cutoffs: dict[tuple[object, str], float] = {}
    for (stratum, _), last in certify(counts, max_false, delta, {"path": tuple(range(len(path)))}).items():
        for rule, cutoff in path[: last + 1]:
            cutoffs[stratum, rule] = min(cutoff, cutoffs.get((stratum, rule), cutoff))
    return cutoffs


def judge(stats: DataFrame, cutoffs: dict[tuple[object, str], float]) -> DataFrame:
    """Add base_failed, kept and reason (the first rule that rejects)."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    reason = F.when(base, F.lit("base"))
    for (stratum, rule), cutoff in sorted(cutoffs.items(), key=repr):
        top, bottom, _ = RULES[rule]
        reason = reason.when(F.col("stratum").eqNullSafe(F.lit(stratum)) & (F.col(top) > cutoff * F.col(bottom)), F.lit(rule))
    return stats.withColumn("base_failed", base).withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def apply_rules(docs: DataFrame, labels: DataFrame, max_false: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Statistics and verdict of every document."""
    stats = Scratch(docs.sparkSession, "rules").keep(document_statistics(docs), "statistics")
    return judge(stats, thresholds(stats, labels, max_false, delta))

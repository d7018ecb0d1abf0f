"""Scores of answers: keyword match, blends, ranks, and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: weights of numbers, alloys and terms in the keyword score
KEYWORD_WEIGHTS = {"numbers": 0.4, "alloys": 0.2, "terms": 0.4}


def matched_share(truth: Column, answer: Column) -> dict[str, Column]:
    """precision, recall and f1 of two arrays of texts; a match holds or is held by the other.

    Compared in lower case as sets. Without truths all are 1; without answers, 0.
    """
    t = F.array_distinct(F.transform(truth, F.lower))
    a = F.array_distinct(F.transform(answer, F.lower))
    hits = F.size(F.filter(t, lambda x: F.exists(a, lambda y: F.contains(y, x) | F.contains(x, y))))
    none, empty = F.size(t) == 0, F.size(a) == 0
    pick = lambda c: F.when(none, 1.0).when(empty, 0.0).otherwise(c)
    precision, recall = hits / F.size(a), hits / F.size(t)
    f1 = F.when(hits > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return {"precision": pick(precision), "recall": pick(recall), "f1": pick(f1)}


def keyword_score(parts: dict[str, Column]) -> Column:
    """Weighted sum of the f1 of numbers, alloys and terms."""
    out = F.lit(0.0)
    for name, weight in KEYWORD_WEIGHTS.items():
        out = out + weight * parts[name]
    return out


def blended_score(level: Column, keyword: Column, semantic: Column, judge: Column, parts: Sequence[Column]) -> Column:
    """Overall score by level; without a judge's result the semantic score alone.

    parts: the three judged parts of level L4 (conflict, mechanism, solution).
    """
    deep = 0.3 * parts[0] + 0.35 * parts[1] + 0.35 * parts[2]
    return (
        F.when(level.isin("L1", "L2"), 0.6 * keyword + 0.4 * semantic)
        .when(level == "L3", F.coalesce(0.8 * judge + 0.2 * semantic, semantic))
        .when(level == "L4", F.coalesce(deep, judge, semantic))
        .otherwise(F.coalesce(0.85 * judge + 0.15 * semantic, semantic))
    )


def tie_ranks(judged: DataFrame, keys: Sequence[str] = ("question_id", "dim")) -> DataFrame:
    """Add rank_score: place p of n gives 1 - p / (n - 1), tied methods share their mean.

    judged: keys, method, position (0 first, null if unranked), tie_group (null:
    none), n_methods. Unranked methods get 0; a single method 1.
    """
    own = F.when(F.col("n_methods") > 1, 1 - F.col("position") / (F.col("n_methods") - 1)).otherwise(F.lit(1.0))
    rows = judged.withColumn("__own", F.when(F.col("position").isNull(), 0.0).otherwise(own))
    group = Window.partitionBy(*keys, F.coalesce(F.concat(F.lit("t"), F.col("tie_group").cast("string")), F.concat(F.lit("m"), "method")))
    return rows.withColumn("rank_score", F.avg("__own").over(group)).drop("__own")


def dimension_summary(judgements: DataFrame) -> DataFrame:
    """method, dim, mean (3 places); dim ``overall`` is the mean of the rounded means."""
    by_dim = judgements.groupBy("method", "dim").agg(F.round(F.avg("score"), 3).alias("mean"))
    overall = by_dim.groupBy("method").agg(F.round(F.avg("mean"), 3).alias("mean")).select("method", F.lit("overall").alias("dim"), "mean")
    return by_dim.union(overall)


def ranking(summary: DataFrame) -> DataFrame:
    """Methods by overall mean (ties by name). Methods are few: one window over them."""
    rows = summary.where("dim = 'overall'").select("method", "mean")
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "method")))


def comparison_matrix(judgements: DataFrame, dims: Sequence[str]) -> DataFrame:
    """One row per method with unrounded means by dimension and their mean."""
    rows = judgements.groupBy("method").pivot("dim", list(dims)).agg(F.avg("score"))
    given = F.array(*[F.col(d) for d in dims])
    known = F.filter(given, lambda x: x.isNotNull())
    return rows.withColumn("overall", F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def score_report(scores: DataFrame, dimensions: Sequence[str], score: str = "score") -> DataFrame:
    """Average, range and count by each dimension and over all, in one pass.

    Rows: dimension, value (null for ``overall``), avg, min, max, n. Rows
    without a score are errors and do not count.
    """
    rows = scores.where(F.col(score).isNotNull())
    sets = F.explode(F.array(F.struct(F.lit("overall").alias("dimension"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    return rows.select(sets.alias("g"), score).groupBy("g.dimension", "g.value").agg(F.avg(score).alias("avg"), F.min(score).alias("min"), F.max(score).alias("max"), F.count("*").alias("n"))


def level_analysis(scores: DataFrame, levels: Sequence[str], merged: bool = False) -> DataFrame:
    """Average, count and range for every level, zeros for empty ones, and Overall of the listed.

    scores: difficulty, source, score. A question of the hard set is of level
    hard, or with merged of its difficulty (unknown: L1).
    """
    hard = F.coalesce(F.col("source") == "hard.json", F.lit(False))
    level = F.when(F.col("difficulty").isin("L1", "L2", "L3", "L4"), F.col("difficulty")).otherwise(F.lit("L1")) if merged else F.when(hard, F.lit("hard")).otherwise(F.col("difficulty"))
    rows = scores.withColumn("level", level).where(F.col("level").isin(*levels))
    measures = (F.avg("score").alias("avg"), F.count("score").alias("n"), F.min("score").alias("min"), F.max("score").alias("max"))
    got = rows.rollup("level").agg(*measures).withColumn("level", F.coalesce("level", F.lit("Overall")))
    spine = scores.sparkSession.createDataFrame([(x,) for x in [*levels, "Overall"]], "level string")
    return spine.join(got, "level", "left").select("level", *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("avg", "double"), ("n", "long"), ("min", "double"), ("max", "double"))])


def rescore_summary(scores: DataFrame) -> DataFrame:
    """Average, range (4 places), total and valid scores."""
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return scores.agg(r(F.avg("score")).alias("avg"), r(F.min("score")).alias("min"), r(F.max("score")).alias("max"), F.count("*").alias("total"), F.count("score").alias("valid"))


def last_scores(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last score by a total order for each key."""
    return rows.groupBy(*keys).agg(F.max_by("score", F.struct(*order)).alias("score"))


def wide_scores(last: DataFrame, key: str, methods: Sequence[str]) -> DataFrame:
    return last.groupBy(key).pivot("method", list(methods)).agg(F.first("score"))


def pending(questions: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Questions without an answer."""
    return questions.join(answers.select(key), key, "left_anti")


def agreement(human: DataFrame, machine: DataFrame) -> DataFrame:
    """Decisions on the same sets of members, and the rate of agreement.

    Both: members (array), decision.
    """
    key = lambda d, name: d.select(F.array_sort(F.array_distinct("members")).alias("members"), F.col("decision").alias(name))
    rows = key(human, "human").join(key(machine, "machine"), "members", "left")
    same = F.col("human") == F.col("machine")
    return rows.agg(F.count("*").alias("n"), F.count("machine").alias("n_matched"), F.count_if(same).alias("n_agree"), F.avg(same.cast("int")).alias("rate"))


def deterministic_sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by a seeded hash of their key: the same ones every time."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)

"""Answers and judgements of question sets by models, with retries, stored rounds and resume."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tolerant_json
from ..operators.evaluation import pending
from .providers import ProviderFactory
from .reports import _done

#: Dimensions of a judgement across several.
DIMENSIONS = ("correctness", "completeness", "relevance", "clarity")


def answered_with_retry(complete: Callable[[list[str]], list[str]], prompt: str, accept: Callable[[str], object | None], tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[object | None, int]:
    """What accept makes of the first answer it takes, and the tries that took; waits double in between."""
    for turn in range(1, tries + 1):
        try:
            got = accept(complete([prompt])[0])
        except (OSError, RuntimeError, ValueError):
            got = None
        if got is not None:
            return got, turn
        if turn < tries:
            sleep(wait * 2 ** (turn - 1))
    return None, tries


def read_scores(told: str, names: Sequence[str]) -> dict[str, float] | None:
    """Scores by name out of a judge's answer, held in 0..1; None unless all are numbers."""
    found = tolerant_json(told)
    if not isinstance(found, dict):
        return None
    try:
        return {n: min(1.0, max(0.0, float(found[n]))) for n in names}
    except (KeyError, TypeError, ValueError):
        return None


def judged(rows: DataFrame, factory: ProviderFactory, names: Sequence[str] = ("score",), tries: int = 3, wait: float = 1.0) -> DataFrame:
    """rows (question, truth, answer) with a column for each name; null where no try gave scores.

    Prompts are built and sent where the rows are; how many run at a time is
    the number of tasks.
    """
    names = list(names)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for part in parts:
            given = []
            for question, truth, answer in zip(part["question"], part["truth"], part["answer"], strict=True):
                prompt = "TASK judge\n" + json.dumps({"question": question, "truth": truth, "answer": answer, "names": names}, ensure_ascii=False)
                got, _ = answered_with_retry(provider.complete, prompt, lambda told: read_scores(told, names), tries, wait)
                given.append(got or dict.fromkeys(names))
            yield part.assign(**{n: pd.Series([g[n] for g in given], index=part.index, dtype="float64") for n in names})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, kinds + "".join(f", `{n}` double" for n in names)).select(*rows.columns, *[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names])


def dimension_rows(scored: DataFrame, key: str = "id", names: Sequence[str] = DIMENSIONS) -> DataFrame:
    """key, method, dim, score: one row for each dimension that was scored."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), F.col(n).alias("score")) for n in names]))
    return scored.select(key, "method", each.alias("x")).select(key, "method", "x.*").where("score IS NOT NULL")


def answers_by(questions: DataFrame, method: str, factory: ProviderFactory, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """id, question, truth, method, answer (null after the last try) of a model asked directly."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for part in parts:
            said = [answered_with_retry(provider.complete, f"TASK answer\n{q}", lambda told: told.strip() or None, tries, wait)[0] for q in part["question"].fillna("")]
            yield part.assign(answer=said)

    rows = questions.select("id", "question", "truth", F.lit(method).alias("method"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{kinds}, answer string")


def evaluate(questions: DataFrame, methods: dict[str, ProviderFactory], judge: ProviderFactory, path: str, names: Sequence[str] = ("score",), wait: float = 1.0) -> DataFrame:
    """Judged answers of all methods to all questions (id, question, truth).

    A method's results are a table under path. Questions that have an answer
    and a score there are not asked again; new results are one more part.
    """
    spark, out = questions.sparkSession, None
    for method, factory in methods.items():
        parts = []
        turn = 0
        while _done(spark, f"{path}/{method}/part-{turn}"):
            parts.append(spark.read.parquet(f"{path}/{method}/part-{turn}"))
            turn += 1
        good = None
        for part in parts:
            kept = part.where(" AND ".join(f"`{n}` IS NOT NULL" for n in ("answer", *names)))
            good = kept if good is None else good.unionByName(kept)
        todo = questions if good is None else pending(questions, good)
        if todo.limit(1).count():
            judged(answers_by(todo, method, factory, wait=wait), judge, names, wait=wait).write.parquet(f"{path}/{method}/part-{turn}")
            parts.append(spark.read.parquet(f"{path}/{method}/part-{turn}"))
        for part in parts:
            last = part if part is parts[-1] else part.where(" AND ".join(f"`{n}` IS NOT NULL" for n in ("answer", *names)))
            out = last if out is None else out.unionByName(last)
    return out


def summary_json(scored: DataFrame, score: str = "score") -> DataFrame:
    """One row: methods with count, mean and range as a JSON text (methods are few)."""
    by = scored.groupBy("method").agg(F.count(score).alias("n"), F.round(F.avg(score), 6).alias("mean"), F.min(score).alias("low"), F.max(score).alias("high"))
    return by.agg(F.to_json(F.array_sort(F.collect_list(F.struct("method", "n", "mean", "low", "high")))).alias("summary"))

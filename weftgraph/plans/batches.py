"""Batch jobs of a model service: files of requests in, files of answers out."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import batch_content

OPEN, FAILED = ("validating", "in_progress", "finalizing"), ("failed", "expired", "cancelled")


class BatchService(Protocol):
    def submit(self, path: str) -> str:
        """Start a job on a file of requests and give its number."""

    def status(self, job: str) -> str: ...

    def result(self, job: str) -> str:
        """Path of a completed job's answers."""


def submitted(service: BatchService, paths: Sequence[str], known: Mapping[str, str] | None = None) -> dict[str, str]:
    """Job by file; files that have a job keep it."""
    return {path: (known or {}).get(path) or service.submit(path) for path in paths}


def polled(service: BatchService, jobs: Mapping[str, str], every: float = 60.0, most: int = 1440, sleep: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """Status by file once no job is open, asked for at most so many times."""
    found = dict.fromkeys(jobs, OPEN[0])
    for turn in range(most):
        found |= {path: service.status(jobs[path]) for path, status in found.items() if status in OPEN}
        if not any(s in OPEN for s in found.values()):
            break
        if turn < most - 1:
            sleep(every)
    return found


def batch_answers(spark: SparkSession, service: BatchService, jobs: Mapping[str, str], statuses: Mapping[str, str]) -> DataFrame:
    """custom_id, content (null: no answer) of all completed jobs; of a repeated id the greatest content."""
    paths = [service.result(jobs[path]) for path, status in statuses.items() if status == "completed"]
    if not paths:
        return spark.createDataFrame([], "custom_id string, content string")
    rows = spark.read.text(paths).select(F.get_json_object("value", "$.custom_id").alias("custom_id"), batch_content(F.col("value")).alias("content"))
    return rows.where("custom_id IS NOT NULL").groupBy("custom_id").agg(F.max("content").alias("content"))

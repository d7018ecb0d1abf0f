"""Files that a model reads into page JSON, with a status for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (file name, bytes) -> page JSON.
Reader = Callable[[str, bytes], str]


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """filename and content of the files under a path."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def parsed(rows: DataFrame, reader: Callable[[], Reader], tries: int = 2) -> DataFrame:
    """filename, status (done or failed), body, message; each file is tried a few times on its own."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader()
        for part in parts:
            out = []
            for name, content in zip(part["filename"], part["content"], strict=True):
                body, message = None, "not tried"
                for _ in range(tries):
                    try:
                        body, message = read(name, bytes(content)), None
                        break
                    except Exception as problem:  # a reader's failure is a result: it goes into the status
                        message = str(problem)
                out.append((name, "failed" if body is None else "done", body, message))
            yield pd.DataFrame(out, columns=["filename", "status", "body", "message"])

    return rows.mapInPandas(run, "filename string, status string, body string, message string")


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Files that no earlier run finished."""
    return rows.join(done.where("status = 'done'").select("filename"), "filename", "left_anti")


def status_report(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))

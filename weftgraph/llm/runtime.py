"""Shared plumbing of the training-data operators: batches and columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

__all__ = ["Scratch", "bounded_batches", "fresh", "map_texts", "only", "table"]


def bounded_batches(spark: SparkSession, rows: int = 2000, megabytes: int = 8) -> None:
    """Bound the Arrow batches that Python workers get, by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns (new=old), so that extra columns never clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df does not have, whatever it has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_texts(docs: DataFrame, change: Callable[[pa.RecordBatch, int], pa.RecordBatch], *more: str) -> DataFrame:
    """docs, of which change makes each batch anew, told where text is.

    The batch has docs' columns and then more, which change drops; what the
    columns are called does not matter.
    """
    names = [c for c in docs.columns if c not in more]
    at = names.index("text")
    plain = [f"c{k}" for k in range(len(names))]
    fields = ", ".join(f"{c} {docs.schema[n].dataType.simpleString()}" for c, n in zip(plain, names, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield change(batch, at)

    rows = docs.select(*[F.col(f"`{c}`") for c in names], *more).toDF(*plain, *[f"m{k}" for k in range(len(more))])
    return rows.mapInArrow(run, fields).toDF(*names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

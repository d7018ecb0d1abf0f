"""Tables in the folder that all executors share, to cut lineage between rounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; one is made only where none is set and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


class Scratch:
    """Parquet tables that are written once and reread by later stages.

    A lost executor costs only the tasks it ran. Tables are dropped as soon as
    nothing needs them, the rest when the driver ends.
    """

    def __init__(self, spark: SparkSession, purpose: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def _place(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as reread from the shared folder."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, at = self._place(f"{self.root}/{name}")
            fs.delete(at, True)

    def close(self) -> None:
        try:
            fs, at = self._place(self.root)
            fs.delete(at, True)
        except Exception:  # the session may be gone already; nothing is left to free then
            pass

"""Intermediate tables in the shared folder, dropped as soon as they are used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.session import scratch_path, shuffles_freed


class Scratch:
    """Tables of one run. ``save`` cuts the lineage: later reads need no earlier executor."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count = spark, scratch_path(spark, label), 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, label: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{label}"
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def bytes_of(self, df: DataFrame) -> int:
        """Size of a saved table's files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(df)])
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.getContentSummary(path).getLength()

    def drop(self, *frames: DataFrame) -> None:
        """Delete saved tables that no pending plan reads."""
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

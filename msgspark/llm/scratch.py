"""Intermediate tables of one job, in the shared folder, removed when the application ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import fresh_path, temporary


class Scratch:
    """Writes stages as Parquet in the folder of ``spark.checkpoint.dir`` and reads them back.

    A written stage survives lost executors and cuts the lineage. What a returned frame
    still reads stays until the application ends; other stages are dropped before.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        temporary(self.spark, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._stage = out  # keeps the id taken while the frame lives
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove stages that no later step reads."""
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

"""Tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local master gets a temporary folder, which becomes
    its checkpoint folder; a cluster has no folder that all machines share, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='fabrel-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: df as a table in the shared folder, so that a lost executor costs no recomputation."""
    return Scratch(df.sparkSession, label).written(df, "all")


class Scratch:
    """The tables that one job writes between its steps, in a folder of their own.

    A table goes (`drop`) once all that reads it is written; what a returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, f"{shared_root(spark)}/fabrel/{name}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, label: str) -> DataFrame:
        """df, written as `label` and read again."""
        path = f"{self.folder}/{label}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{label}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

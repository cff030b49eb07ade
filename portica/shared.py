"""The folder that driver and executors share, and rows that are written to it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what the session's context has set; in local mode the warehouse serves."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local["):
        # One process has no executors elsewhere.
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, with the lineage cut; survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of files that Spark wrote."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of an iteration, written to the shared folder and read again; they go when the block ends.

    Unlike a checkpoint, a table read again has the size of its files and not an estimate that grows with each round.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        remove(self.spark, self.folder)

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        df.write.parquet(f"{self.folder}/{self.count}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.count}")

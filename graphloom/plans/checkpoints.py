"""Where plans cut their lineage, and where tables stand that they read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared checkpoint folder (spark.checkpoint.dir); one of our own only where none is set and executors are local."""
    ctx = spark.sparkContext
    if not ctx.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not ctx.master.startswith("local") or ctx.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        ctx.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return ctx.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` as Parquet in the shared checkpoint folder, so that readers prune columns and know its size."""
    at = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Rounds:
    """A table that grows by what each round adds; its plan is one scan, however many rounds there are.

    A round is a folder of its own below one that is read whole, so a round that is lost and made again replaces itself.
    """

    def __init__(self, first: DataFrame) -> None:
        self.spark, self.schema = first.sparkSession, first.schema
        self.at = f"{folder(self.spark)}/{uuid.uuid4().hex}"
        self.count = 0
        self.last = self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        """Adds a round's rows, and returns just them."""
        to = f"{self.at}/round={self.count}"
        df.select(*self.schema.names).write.mode("overwrite").option("compression", "zstd").parquet(to)
        self.count += 1
        self.last = self.spark.read.schema(self.schema).parquet(to)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.at)

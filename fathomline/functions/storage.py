"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.workers import workers_import_package


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/fathomline-{os.getpid()}"
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t", *by: str) -> DataFrame:
    """``df`` written to and read back from the shared folder, a folder for each value of ``by``: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    workers_import_package(df.sparkSession)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Subsets whose members lie together in a stored table, and the column that numbers such ranges.
RANGE, RANGED = 512, "range__"


def ranged(df: DataFrame) -> DataFrame:
    """``df`` with the range of its ``subset_id``, the partition in which stored members of the subset lie."""
    return df.withColumn(RANGED, F.floor(F.col("subset_id") / RANGE).cast("long"))


class Growing:
    """A table that grows by one folder per epoch and is read as one: its plan does not grow with the epochs.

    With ``by_range`` an epoch's folder has a folder for each range of subsets, so a reader that joins on the range reads those
    of the subsets it asks for.
    """

    def __init__(self, spark: SparkSession, schema: str, path: str | None = None, by_range: bool = False):
        self.spark, self.schema, self.path, self.empty, self.by_range = spark, schema, path or f"{shared_dir(spark)}/growing", True, by_range

    def add(self, df: DataFrame, epoch: int) -> DataFrame:
        """Write an epoch's rows (again, if it ran before) and read them back."""
        names, path = [c.split()[0] for c in self.schema.split(", ")], f"{self.path}/epoch={epoch}"
        df, writer = df.select(names), df.select(names).write
        if self.by_range:
            writer = ranged(df).repartition(RANGED).write.partitionBy(RANGED)  # a range has a bounded number of rows
        writer.mode("overwrite").parquet(path)
        self.empty = False
        return self.spark.read.schema(self.schema).parquet(path)

    def read(self) -> DataFrame:
        if self.empty:
            empty = self.spark.createDataFrame([], self.schema)
            return ranged(empty) if self.by_range else empty
        schema = f"{self.schema}, epoch long" + f", {RANGED} long" * self.by_range
        return self.spark.read.schema(schema).parquet(self.path).drop("epoch")

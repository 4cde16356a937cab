"""Helpers shared by the corpus operators: table access, durable scratch tables, linked components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.workers import workers_import_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/fathomline-{os.getpid()}"
    return f"{base.rstrip('/')}/scratch/{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back, so that lost executors never re-run its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


#: Keys of rows to drop are sent to every executor up to this number (16 bytes each); beyond it the rows are shuffled.
MAX_SENT_KEYS = 4_000_000


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone``. The keys are written first, so that their number is known before the rows move."""
    gone = materialize(gone.select(key).distinct(), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= MAX_SENT_KEYS else gone, key, "left_anti")


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def linked_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every id that has an edge, by contraction.

    ``edges`` has long columns ``a`` and ``b``. Each round hooks every node to its smallest neighbour, jumps
    pointers once and contracts the edges to the new roots; the number of rounds grows with the logarithm of the
    longest chain. Hot nodes only meet ``min`` aggregates (combined before the shuffle) and equi-joins that
    adaptive execution may split. Returns ``(id, component_id)``; nulls and self-loops give no row.
    """
    edges = materialize(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        parent = materialize(parent, "parent")
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("a", F.col("pp").alias("p"))
        parent = materialize(parent, "jumped")
        ren_a = parent.select("a", F.col("p").alias("ra"))
        ren_b = parent.select(F.col("a").alias("b"), F.col("p").alias("rb"))
        edges = materialize(
            edges.join(ren_a, "a").join(ren_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
        step = parent.select(F.col("a").alias("c"), F.col("p").alias("nc"))
        if labels is None:
            labels = parent.select(F.col("a").alias("id"), F.col("p").alias("c"))
        else:
            labels = labels.join(step, "c", "left").select("id", F.coalesce("nc", "c").alias("c"))
        labels = materialize(labels, "labels")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component_id"))
    return labels.select("id", F.col("c").alias("component_id"))

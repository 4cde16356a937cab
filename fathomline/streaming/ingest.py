"""Incremental ingest: one version at a time against a stored index, and streams of chunks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.storage import RANGED, ranged, stored
from fathomline.operators.near_exact import FIRSTS, HOOKS, PIECES, Config, Counters, State, of_ids, run_epoch, unpacked
from fathomline.operators.ordinals import block_ordinal

DEDUP = "trace string, version int, pos long, chunk_id string, seq long, is_dup boolean, location long"
COUNTERS = "trace string, container long, recipe long, ord long, ingest long, windows long, loads long, candidates long, last_seq long, version int"


def _read(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).where(F.col("version") < before)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)


def ingest_version(spark: SparkSession, store: str, chunks: DataFrame, version: int, cfg: Config, window_base: int | None = None) -> DataFrame:
    """Deduplicate one version of ``chunks (trace, pos, chunk_id)`` against the store and add what it made.

    Rows, members, hooks, loads and counters are written by ``version=`` partition, which a repeated run overwrites; the
    state is read from earlier versions only, so a repeated run makes the same ids. Members lie by ranges of subsets, of which
    only those that the version loads are read. Hooks lie by version and kind: recipe hooks beyond the version bound are not read. Windows
    are counted for each trace of its own; ``window_base``, if given, for all. Returns the version's rows.
    """
    members, hooks, loads, rows, counters, firsts = (f"{store}/{t}" for t in ("members", "hooks", "loads", "rows", "counters", "firsts"))
    latest = _read(spark, counters, COUNTERS, version).groupBy("trace").agg(F.max_by(F.struct("*"), "version").alias("c")).select("c.*").collect()  # one row per trace
    names = [c.split()[0] for c in COUNTERS.split(", ")][1:-2]
    live = _read(spark, hooks, of_ids(HOOKS, chunks), version)
    live = live.where((F.col("kind") != "recipe") | (F.col("version") >= version - cfg.most("version_bound"))) if cfg.kind == "hybrid" else live
    held = _read(spark, members, f"{of_ids(PIECES, chunks)}, {RANGED} long", version)
    state = State(unpacked(held), live, _read(spark, firsts, f"{of_ids(FIRSTS, chunks)}, version int", version).drop("version"), {r.trace: Counters(**{n: r[n] for n in names}) for r in latest}, held)
    ended = {r.trace: r.last_seq for r in latest}
    bases = spark.createDataFrame(list(ended.items()), "trace string, base__ long")  # one row per trace
    order = F.col("pos")
    windowed = chunks.select("trace", F.lit(version).alias("version"), "pos", "chunk_id", F.floor(order / cfg.window_size).cast("bigint").alias("win"), (order % cfg.window_size).cast("int").alias("win_pos"))
    base = F.coalesce("base__", F.lit(0)) if window_base is None else F.lit(window_base)
    windowed = stored(windowed.join(F.broadcast(bases), "trace", "left").withColumn("seq", F.col("win") + 1 + base).drop("base__"), "windowed")
    made = run_epoch(windowed, state, cfg)
    ended |= {r[0]: r[1] for r in windowed.groupBy("trace").agg(F.max("seq")).collect()}  # one row per trace
    after = spark.createDataFrame([(t, *(getattr(c, n) for n in names), ended.get(t, 0), version) for t, c in made.counters.items()], COUNTERS)
    picked = made.rows.select("trace", "version", "pos", "chunk_id", "seq", "is_dup", F.col("location").cast("long").alias("location"))
    tables = [(ranged(made.pieces).repartition(RANGED), members, [RANGED]), (made.hooks, hooks, ["kind"]), (made.loads, loads, []), (picked, rows, []), (after, counters, [])]
    if made.firsts is not None:
        tables.append((made.firsts.withColumn("version", F.lit(version)), firsts, []))
    for table, path, more in tables:
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", *more).parquet(path)
    return spark.read.schema(of_ids(DEDUP, chunks)).parquet(rows).where(F.col("version") == version)


def stream_exact_dedup(stream: DataFrame) -> DataFrame:
    """First occurrence of every id of a stream; the state holds every id seen, as exact deduplication needs."""
    return stream.dropDuplicates(["trace", "chunk_id"])


def stream_near_exact(stream: DataFrame, store: str, cfg: Config, checkpoint: str):
    """Start near-exact deduplication of a stream of ``trace, ordinal, chunk_id``: each micro-batch is an epoch.

    Windows restart with each batch; the batch id is the version, so a retried batch overwrites what it wrote.
    """

    def epoch(batch: DataFrame, batch_id: int) -> None:
        blocks = batch.select("trace", "ordinal", "chunk_id", F.floor(F.col("ordinal") / 4096).alias("block"))
        ranked = block_ordinal(blocks, ["trace"], ["block"], ["ordinal"], "pos").select("trace", F.col("pos").cast("bigint").alias("pos"), "chunk_id")
        ingest_version(batch.sparkSession, store, ranked, batch_id, cfg)

    return stream.writeStream.foreachBatch(epoch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

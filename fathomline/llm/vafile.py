"""Operator 10, exact top-k inner products by vector-approximation files.

Every component becomes floor(256 * x), x as double. The vector-approximation file is a Parquet table with one row per
block of at most ``BLOCK_ROWS`` vectors: one byte per component (its cell among at most 256 equal ones of the block's own
range in that dimension) in one column, the exact integers in another, which a scan of the cells does not read.

1. All cells are scanned for every query: a score lies between ``bound`` and ``bound + gap``, known from the cells alone.
   The k-th best lower bound over all blocks is what a vector must be able to reach.
2. The cells are scanned again and the vectors whose upper bound reaches it are listed, best bound first.
3. Only blocks with such vectors have their exact column joined; exact scores are taken in order of the bounds until
   the k-th best of them passes the next bound.

Queries and vectors meet as blocks, in an equi-join on a salt, so neither side passes through the driver. Bounds
allow for the rounding of doubles; scores are exact for integers of any size (doubles where every partial sum stays
below 2**53, else Python integers). A score beyond 64 bits is returned as the nearest long, and such scores are
ordered by their value as doubles.

Equal vectors are one class: a class takes part with its k + 1 smallest ids (no other can be among the k best of a
query), and equal queries are asked once. Vectors take no part if they, their id or a component are null, a component
times 256 is not finite, or they have no component; vectors of different lengths are not compared. Of repeated ids,
one row (the smallest vector) is the query, and rows with the query's id are not its candidates; repeated candidates
each count. Ties go to the smaller ``vec_id``. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.common import materialize, table

SCALE, BLOCK_ROWS, QUERY_ROWS, CELLS, SALTS = 256.0, 4096, 512, 256, 32
_EXACT = float(1 << 53)


def scaled(vectors: DataFrame) -> DataFrame:
    """``vec_id, ints`` of the vectors that take part; the integers are held in doubles, which is exact at any size."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * SCALE)
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where("vec_id is not null and embedding is not null").where(F.size("embedding") > 0).where(F.coalesce(usable, F.lit(False)))
    whole = F.transform(x, lambda v: F.when(F.abs(v) < _EXACT, F.floor(v).cast("double")).otherwise(v))  # doubles from 2**53 on are integers
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("ints"))


def _pack(ints: np.ndarray) -> bytes:
    """Rows of integers as 32-bit ones where they fit, else as doubles; the first byte says which."""
    small = np.abs(ints).max(initial=0) < 1 << 31
    return (b"i" + ints.astype("<i4").tobytes()) if small else (b"d" + ints.astype("<f8").tobytes())


def _unpack(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i4" if raw[:1] == b"i" else "<f8", offset=1).reshape(-1, dims)


def _batched(batches: Iterator[pa.RecordBatch], rows_per_block: int) -> Iterator[tuple[int, list[list], np.ndarray]]:
    """Rows of ``(.., ints)`` gathered into blocks of equal dimension: dimension, the other columns, and the matrix."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        others = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True))
        for row, values in zip(others, batch.columns[-1], strict=True):
            x = values.values.to_numpy()
            rows, xs = held.setdefault(len(x), ([], []))
            rows.append(row), xs.append(x)
            if len(rows) == rows_per_block:
                del held[len(x)]
                yield len(x), [list(c) for c in zip(*rows, strict=True)], np.stack(xs)
    for dims, (rows, xs) in held.items():
        yield dims, [list(c) for c in zip(*rows, strict=True)], np.stack(xs)


def build_blocks(classes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The vector-approximation file of ``classes (vec_id, n, ints)``: ``block, dims, low, width, cells, ids, exact`` as flat bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, (dims, (ids, copies), ints) in enumerate(_batched(batches, block_rows)):
            low, high = ints.min(0), ints.max(0)
            with np.errstate(over="ignore"):
                width = np.maximum(np.floor((high - low) / CELLS) + 1, 1.0)
            width = np.where(np.isfinite(width), width, np.finfo(np.float64).max / CELLS)
            cells = np.clip(np.floor((ints - low) / width), 0, CELLS - 1).astype(np.uint8)
            named = np.stack([np.array(ids, dtype="<i8"), np.array(copies, dtype="<i8")])
            cols = [pa.array([first + k], pa.int64()), pa.array([dims], pa.int32())] + [pa.array([b], pa.binary()) for b in (low.astype("<f8").tobytes(), width.astype("<f8").tobytes(), cells.tobytes(), named.tobytes(), _pack(ints))]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "dims", "low", "width", "cells", "ids", "exact"])

    return classes.select("vec_id", "n", "ints").mapInArrow(run, "block long, dims int, low binary, width binary, cells binary, ids binary, exact binary")


def query_blocks(queries: DataFrame) -> DataFrame:
    """``queries (qid, sure, ints)`` in blocks, once for each salt: ``salt, dims, qids, sure, qs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, (qids, sure), ints in _batched(batches, QUERY_ROWS):
            cols = [pa.array([dims], pa.int32())] + [pa.array([b], pa.binary()) for b in (np.array(qids, dtype="<i8").tobytes(), np.array(sure, dtype="<f8").tobytes(), ints.astype("<f8").tobytes())]
            yield pa.RecordBatch.from_arrays(cols, names=["dims", "qids", "sure", "qs"])

    packed = queries.select("qid", "sure", "ints").mapInArrow(run, "dims int, qids binary, sure binary, qs binary")
    return packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def bounds(cells: np.ndarray, low: np.ndarray, width: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, vectors by queries, from the cells alone."""
    with np.errstate(all="ignore"):
        weighted = queries * width
        near = cells.astype(np.float64) @ weighted.T
        base = queries @ low
        spread = queries * (width - 1)
        size = np.abs(queries) @ (np.abs(low) + CELLS * width)
        slack = np.where(size * len(low) < _EXACT, 0.0, size * len(low) * 2.0**-48)  # nothing is rounded below 2**53
        down, up = near + (base + np.minimum(spread, 0).sum(1) - slack), near + (base + np.maximum(spread, 0).sum(1) + slack)
    return np.where(np.isnan(down), -np.inf, down), np.where(np.isnan(up), np.inf, up)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where these are exact, else as Python integers."""
    biggest = np.abs(rows).max(initial=0) * float(np.abs(query).max(initial=0))
    if biggest * len(query) < _EXACT:
        return (rows.astype(np.float64) @ query).astype(np.int64)
    q = [int(v) for v in query]
    return np.array([sum(int(a) * b for a, b in zip(r, q, strict=True)) for r in rows.tolist()], dtype=object)


def read_in_order(exact: np.ndarray, slots: np.ndarray, upper: np.ndarray, query: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, object]]:
    """Slot and score of the ``k`` best of a block; ``slots`` stand in descending order of ``upper``."""
    taken: list[tuple[object, int, int]] = []
    at, step = 0, 2 * k
    while at < len(slots):
        some = slots[at : at + step]
        taken += [(-s, int(ids[j]), int(j)) for s, j in zip(exact_scores(exact[some], query).tolist(), some, strict=True)]
        taken = sorted(taken)[:k]
        at, step = at + step, step * 2
        if len(taken) == k and at < len(slots) and -taken[-1][0] > upper[at]:
            break  # the k-th result is certain
    return [(j, -s) for s, _, j in taken]


_LONG = (1 << 63) - 1
_CANDIDATES = "block long, qids binary, qs binary, counts binary, slots binary, upper binary"
_FOUND = "qid long, vec_id long, n long, score long, size double"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("size"), "vec_id")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def search(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``qid, vec_id, n, score, size``: the ``k`` best ids of the blocks for each of ``queries (qid, ints)``."""
    cells = blocks.select("block", "dims", "low", "width", "cells").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))

    def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
        for block, dims, low, width, codes, qids, sure, qs in zip(*(batch.column(c).to_pylist() for c in ("block", "dims", "low", "width", "cells", "qids", "sure", "qs")), strict=True):
            queries_here = np.frombuffer(qs, dtype="<f8").reshape(-1, dims)
            found = bounds(np.frombuffer(codes, dtype=np.uint8).reshape(-1, dims), np.frombuffer(low, dtype="<f8"), np.frombuffer(width, dtype="<f8"), queries_here)
            yield block, np.frombuffer(qids, dtype="<i8"), np.frombuffer(sure, dtype="<f8"), queries_here, *found

    def lower_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, qids, _, _, down, _ in parts(batch):
                some = min(k, len(down))
                top = np.partition(down, len(down) - some, axis=0)[len(down) - some :]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(qids, some)), pa.array(top.ravel())], names=["qid", "bound"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, qids, sure, queries_here, _, up in parts(batch):
                counts, slots, upper = [], [], []
                for j in range(len(qids)):
                    own = np.flatnonzero(up[:, j] >= sure[j])  # whatever could still enter, ties included
                    own = own[np.argsort(-up[own, j], kind="stable")]
                    counts.append(len(own)), slots.append(own.astype("<i4")), upper.append(up[own, j])
                asked = np.flatnonzero(counts)
                if len(asked):
                    flat = (qids[asked], queries_here[asked], np.array(counts, dtype="<i4")[asked], np.concatenate(slots), np.concatenate(upper))
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64())] + [pa.array([a.tobytes()], pa.binary()) for a in flat], names=["block", "qids", "qs", "counts", "slots", "upper"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, named, raw, qids, qs, counts, slots, upper in zip(*(batch.column(c).to_pylist() for c in ("dims", "ids", "exact", "qids", "qs", "counts", "slots", "upper")), strict=True):
                ids, copies = np.frombuffer(named, dtype="<i8").reshape(2, -1)
                exact, slot, bound = _unpack(raw, dims), np.frombuffer(slots, dtype="<i4"), np.frombuffer(upper, dtype="<f8")
                rows, at = [], 0
                for qid, query, n in zip(np.frombuffer(qids, dtype="<i8").tolist(), np.frombuffer(qs, dtype="<f8").reshape(-1, dims), np.frombuffer(counts, dtype="<i4").tolist(), strict=True):
                    for j, score in read_in_order(exact, slot[at : at + n], bound[at : at + n], query, ids, k):
                        rows.append((qid, int(ids[j]), int(copies[j]), max(-_LONG - 1, min(_LONG, score)), _double(score)))
                    at += n
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["qid", "vec_id", "n", "score", "size"])

    asked = query_blocks(queries.withColumn("sure", F.lit(float("-inf"))))
    low = cells.join(asked, ["salt", "dims"]).select("block", "dims", "low", "width", "cells", "qids", "sure", "qs").mapInArrow(lower_bounds, "qid long, bound double")
    ranked = low.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound")))).where(F.col("at") <= k)
    sure = ranked.groupBy("qid").agg(F.when(F.count("*") == k, F.min("bound")).otherwise(float("-inf")).alias("sure"))
    sure = materialize(queries.join(sure, "qid"), "sure_bounds")
    again = cells.join(query_blocks(sure), ["salt", "dims"]).select("block", "dims", "low", "width", "cells", "qids", "sure", "qs")
    listed = materialize(again.mapInArrow(candidates, _CANDIDATES), "candidates")
    joined = listed.join(blocks.select("block", "dims", "ids", "exact"), "block")
    return _best(joined.select("dims", "ids", "exact", "qids", "qs", "counts", "slots", "upper").mapInArrow(read, _FOUND), k)


def _double(score: int) -> float:
    try:
        return float(score)
    except OverflowError:
        return float("inf") if score > 0 else float("-inf")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of ``vectors`` for each of ``queries`` (both ``vec_id, ints``)."""
    each = vectors.groupBy("ints", "vec_id").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("ints").orderBy("vec_id"))
    blocks = materialize(build_blocks(each.withColumn("at", first).where(F.col("at") <= k + 1), block_rows), "va_blocks")
    asked = materialize(queries.groupBy("vec_id").agg(F.min("ints").alias("ints")), "queries")
    classes = materialize(asked.groupBy("ints").agg(F.min("vec_id").alias("qid")), "query_classes")
    found = materialize(search(blocks, classes.select("qid", "ints"), k + 1), "found")
    of = asked.join(classes, "ints").select(F.col("vec_id").alias("query_id"), "qid")
    rows = of.join(found, "qid").where(F.col("vec_id") != F.col("query_id"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("size"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ints = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(ints, ints.where("vec_id % 50 = 0"))

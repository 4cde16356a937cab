"""Operator 8, best-fit packing with Martello-Toth dominance reduction.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. A packing depends on lengths only, and
there are at most ``capacity`` different ones, so the instance is a histogram: dominance fixes bins for whole length
classes, best-fit-decreasing packs the rest, and the result is a list of bin patterns with multiplicities. Its size
depends on the capacity, not on the data. Pieces then find their bin by their rank within their length class, which
comes from per-partition counts; no class is ever gathered in one task.

Nulls: a null text is an empty document (its end id alone); a null ``doc_id`` stays null. Equal rows are packed
separately. Very long texts are encoded whole and cut: their first piece takes what is left over, all others are full.
Equally long pieces are interchangeable, and take their places in the order of partitions and rows. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from fathomline.llm.byte_tokens import byte_tokens, default_tokenizer
from fathomline.llm.common import materialize, table, text_or_empty

#: A bin pattern: lengths in order of their offsets, and how many bins look like this.
Pattern = tuple[tuple[int, ...], int]


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fix bins that some optimal packing contains; returns them and the lengths that are left.

    For an item j and the largest item k that fits beside it, {j} or {j, k} dominates every other bin with
    j if nothing fits beside j, if k fills the bin exactly, or if no two items fit beside j together.
    """
    left = Counter({n: c for n, c in counts.items() if c > 0})
    fixed: list[Pattern] = []

    def take(bin_: tuple[int, ...], n: int) -> None:
        fixed.append((bin_, n))
        for x in bin_:
            left[x] -= n
            if not left[x]:
                del left[x]

    before = -1
    while len(fixed) > before:  # fixed bins can make further items reducible
        before = len(fixed)
        for j in sorted(left, reverse=True):
            while j in left:
                others = sorted(n for n in left if n <= capacity - j and left[n] > (n == j))
                if not others:
                    take((j,), left[j])
                    continue
                k, smallest = others[-1], others[0]
                second = smallest if left[smallest] - (smallest == j) > 1 else others[1] if len(others) > 1 else capacity
                if j + k != capacity and j + smallest + second <= capacity:
                    break  # not dominated: left for best-fit
                take((j, k), left[j] // 2 if k == j else min(left[j], left[k]))
    return fixed, dict(left)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit-decreasing over length classes: equal bins are treated together, each item going to the tightest bin."""
    open_bins: Counter = Counter()  # pattern -> how many
    for n in sorted(counts, reverse=True):
        todo = counts[n]
        tight = sorted((p for p in open_bins if capacity - sum(p) >= n), key=lambda p: (capacity - sum(p), p))
        for p in tight:
            if not todo:
                break
            fits, bins = (capacity - sum(p)) // n, open_bins.pop(p)
            full = min(bins, todo // fits)
            todo -= full * fits
            if full:
                open_bins[p + (n,) * fits] += full
            if full < bins:
                if todo:
                    open_bins[p + (n,) * todo] += 1
                    full, todo = full + 1, 0
                if full < bins:
                    open_bins[p] += bins - full
        fits = capacity // n
        if todo // fits:
            open_bins[(n,) * fits] += todo // fits
        if todo % fits:
            open_bins[(n,) * (todo % fits)] += 1
    return list(open_bins.items())


def pack_histogram(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, rest = dominance_reduction(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _runs(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, runs of ranks in its class: first rank, first bin, offset in the bin."""
    used: Counter = Counter()
    runs: dict[int, list[tuple[int, int, int]]] = {}
    first_bin = 0
    for lengths, bins in patterns:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((used[n], first_bin, offset))
            used[n] += bins
            offset += n
        first_bin += bins
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


_PIECES = "part int, local_rank long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int, tokenizer_path: str, end_id: int) -> DataFrame:
    """Pieces of every document with their place among the equally long pieces of their partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, seen = TaskContext.get().partitionId(), byte_tokens(tokenizer_path), Counter()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py()).astype("<u4"), np.uint32(end_id))
                first = len(ids) % capacity or capacity
                for piece, at in enumerate([0, *range(first, len(ids), capacity)]):
                    got = ids[at : first + piece * capacity]
                    rows.append((part, seen[len(got)], doc_id, piece, at, len(got), zlib.crc32(got.tobytes())))
                    seen[len(got)] += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in _PIECES.split(", ")]
            cols = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.select("doc_id", text_or_empty(F.col("text")).alias("text")).mapInArrow(cut, _PIECES)


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(cut_pieces(docs, capacity, tokenizer_path or default_tokenizer(), end_id), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.Window.partitionBy("length").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1))
    base = by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # one row per length: at most ``capacity``
    runs = _runs(pack_histogram(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                first, bins, offset = runs[int(n)]
                at = np.searchsorted(first, rank[mine], side="right") - 1
                seq[mine], off[mine] = bins[at] + rank[mine] - first[at], offset[at]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    schema = T.StructType([f for f in ranked.schema.fields if f.name != "rank"]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

"""Global ordinals without a global sort, windows and segments.

Ordinals are prefix sums on three levels: rows are counted by block, blocks by runs of ``SPAN`` blocks, and only the
runs get a running sum over the whole key. Blocks are then summed inside their run and rows numbered inside their
block, so no task holds more than a block, a run of block counts, or one row per ``SPAN`` blocks.

Keys of joins, windows and grouped minima go from the most telling (``chunk_id``, ``seq``) to the least (``trace``) in the whole
library: sorts compare the first column's prefix, and equal prefixes cost a comparison of whole rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.ids import content_boundary, pattern_boundary

SPAN = 1024


def sums_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the same ``keys`` before this one in ``order``, whose last column is a number."""
    run = F.floor(F.col(order[-1]) / SPAN).cast("bigint").alias("run__")
    first = [*keys, *order[:-1], "run__"]
    marked = df.withColumn("run__", run)
    before = Window.partitionBy(*keys).orderBy(*order[:-1], "run__").rowsBetween(Window.unboundedPreceding, -1)
    runs = marked.groupBy(*first).agg(F.sum(value).alias("v__")).withColumn("base__", F.coalesce(F.sum("v__").over(before), F.lit(0))).drop("v__")
    inside = Window.partitionBy(*first).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return marked.join(runs, first).withColumn(name, F.col("base__") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("run__", "base__")


def block_ordinal(df: DataFrame, keys: list[str], block: list[str], order: list[str], name: str) -> DataFrame:
    """Add the 0-based rank of each row within ``keys``, ordered by ``block`` (its last column a number) and then ``order``."""
    counts = df.groupBy(*keys, *block).agg(F.count("*").alias("n__"))
    offsets = sums_before(counts, keys, block, "n__", "first__").drop("n__")
    inside = Window.partitionBy(*reversed(block), *keys).orderBy(*order)
    return df.join(offsets, [*reversed(block), *keys]).withColumn(name, F.col("first__") + F.row_number().over(inside) - 1).drop("first__")


def version_bases(chunks: DataFrame, window_size: int, usable: Column | None = None) -> DataFrame:
    """``trace, version, base``: windows before each version."""
    n = F.count("*") if usable is None else F.count_if(usable)
    sizes = chunks.groupBy("trace", "version").agg(F.ceil(n / window_size).alias("w"))
    before = Window.partitionBy("trace").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("trace", "version", F.coalesce(F.sum("w").over(before), F.lit(0)).cast("bigint").alias("base"))


def assign_windows(chunks: DataFrame, window_size: int, legacy_skip: bool = False) -> DataFrame:
    """Count-based tumbling windows that restart with each version: ``win``, ``win_pos`` (0-based), global ``seq`` (1-based).

    ``legacy_skip`` drops the first and last line of every ``window_size + 2``, as a double look-ahead reader does.
    """
    step = window_size + 2 if legacy_skip else window_size
    rows = chunks.withColumn("win", F.floor(F.col("pos") / step).cast("bigint")).withColumn("win_pos", (F.col("pos") % step).cast("int"))
    bases = version_bases(chunks, step)
    if legacy_skip:
        rows = rows.where(F.col("win_pos").between(1, window_size)).withColumn("win_pos", F.col("win_pos") - 1)
    return rows.join(F.broadcast(bases), ["trace", "version"]).withColumn("seq", F.col("base") + F.col("win") + 1).drop("base")  # bases: one row per version


def segment_fixed(chunks: DataFrame, segment_size: int, drop_boundary: bool = False) -> DataFrame:
    """Segments of fixed length inside each window; ``drop_boundary`` leaves out the first chunk of every later segment."""
    out = chunks.withColumn("seg", F.floor(F.col("win_pos") / segment_size).cast("bigint"))
    return out.where((F.col("win_pos") == 0) | (F.col("win_pos") % segment_size != 0)) if drop_boundary else out


def _segment_by(chunks: DataFrame, boundary: Column) -> DataFrame:
    so_far = Window.partitionBy("seq", "trace").orderBy("win_pos").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("seg", F.sum((boundary & (F.col("win_pos") > 0)).cast("bigint")).over(so_far))


def segment_content(chunks: DataFrame, bit_num: int) -> DataFrame:
    """A chunk whose low bits are all ones starts a segment; no segment crosses a window."""
    return _segment_by(chunks, content_boundary(F.col("chunk_id"), bit_num))


def segment_pattern(chunks: DataFrame, bit_num: int) -> DataFrame:
    return _segment_by(chunks, pattern_boundary(F.col("chunk_id"), bit_num))

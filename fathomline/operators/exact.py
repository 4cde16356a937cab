"""Exact deduplication, packing of stored chunks and recipes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.storage import stored
from fathomline.operators.ordinals import block_ordinal, sums_before

#: Windows whose stored chunks are numbered together.
PACK_SPAN = 64


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """``trace, chunk_id, version, pos, n``: the first occurrence of every id and how often it occurs.

    A missing id is one id here, as it is for partitioned stores; ``exact_dedup`` alone holds each chunk without an id as new.
    """
    firsts = chunks.groupBy("chunk_id", "trace").agg(F.min(F.struct("version", "pos")).alias("f"), F.count("*").alias("n"))
    return firsts.select("trace", "chunk_id", "f.version", "f.pos", "n")


def exact_dedup(chunks: DataFrame) -> DataFrame:
    """Add ``is_dup``: whether the id occurred before. A grouped minimum and a join, so hot ids are combined early.

    A chunk without an id equals no other one: it is always new.
    """
    firsts = unique_chunks(chunks.where("chunk_id is not null")).select("trace", "chunk_id", F.col("version").alias("fv"), F.col("pos").alias("fp"))
    joined = chunks.join(firsts, ["chunk_id", "trace"], "left")
    return joined.withColumn("is_dup", F.coalesce((F.col("version") != F.col("fv")) | (F.col("pos") != F.col("fp")), F.lit(False))).drop("fv", "fp")


def pack_containers(new_rows: DataFrame, container_size: int, base_id: int = 0, base_ord: int = 0) -> DataFrame:
    """Stored chunks in arrival order (``seq``, ``win_pos``) fill containers; adds ``ord, container_id, slot``."""
    packed = block_ordinal(new_rows, ["trace"], ["seq"], ["win_pos"], "k")
    return (
        packed.withColumn("container_id", F.floor(F.col("k") / container_size) + base_id)
        .withColumn("slot", (F.col("k") % container_size).cast("int"))
        .withColumn("ord", F.col("k") + base_ord)
        .drop("k")
    )


def pack_partitioned(new_rows: DataFrame, container_size: int) -> DataFrame:
    """Containers for each hash partition of its own: adds ``slot`` and ``container_id``, counted per ``part``."""
    packed = block_ordinal(new_rows, ["trace", "part"], ["version"], ["pos"], "k")
    return packed.withColumn("container_id", F.floor(F.col("k") / container_size)).withColumn("slot", (F.col("k") % container_size).cast("int")).drop("k")


def seal_status(containers: DataFrame, seal_tail: bool = False) -> DataFrame:
    """``trace, container_id, sealed_seq``: the window that first searches a container, when one more chunk has come; null for the tail."""
    firsts = containers.groupBy("trace", "container_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    after = firsts.select("trace", (F.col("container_id") - 1).alias("container_id"), F.col("first_seq").alias("after"))  # ids have no gaps
    sealed = F.coalesce("after", "last_seq") if seal_tail else F.col("after")
    return firsts.join(after, ["container_id", "trace"], "left").select("trace", "container_id", sealed.alias("sealed_seq"))


def with_locations(windowed: DataFrame, container_size: int) -> DataFrame:
    """Exact deduplication with the container of every chunk: adds ``is_dup, location``. The flagged rows are written once."""
    flagged = stored(exact_dedup(windowed), "flagged")
    return locate(flagged, pack_containers(flagged.where(~F.col("is_dup")), container_size))


def pack_firsts(windowed: DataFrame, window_size: int, container_size: int) -> DataFrame:
    """``pack_containers`` of the first occurrence of every id, straight from windows: ``trace, chunk_id, version, seq, win_pos, ord, container_id, slot``.

    A place is one number, so firsts are found by a hash aggregate, before any shuffle and without a sort. Chunks without an id are all new.
    They are numbered in blocks of ``PACK_SPAN`` windows and written once; what comes before a block is a sum over few rows.
    """
    known, place = windowed.where("chunk_id is not null"), F.col("seq") * window_size + F.col("win_pos")
    firsts = known.groupBy("chunk_id", "trace").agg(F.min(place).alias("place"), F.min("version").alias("version"))  # versions rise with seq
    new = firsts.select("trace", "chunk_id", "place", "version").unionByName(windowed.where("chunk_id is null").select("trace", "chunk_id", place.alias("place"), "version"))
    inside = Window.partitionBy("block__", "trace").orderBy("place")
    numbered = new.withColumn("block__", F.expr(f"place div {window_size * PACK_SPAN}")).withColumn("nth__", F.row_number().over(inside))
    numbered = stored(numbered, "packed")
    above = sums_before(numbered.groupBy("trace", "block__").agg(F.max("nth__").cast("long").alias("n__")), ["trace"], ["block__"], "n__", "above__").drop("n__")
    k = F.col("above__") + F.col("nth__") - 1
    at = [F.expr(f"place div {window_size}").alias("seq"), (F.col("place") % window_size).cast("int").alias("win_pos"), k.alias("ord"), F.floor(k / container_size).alias("container_id"), (k % container_size).cast("int").alias("slot")]
    return numbered.join(stored(above, "blocks"), ["block__", "trace"]).select("trace", "chunk_id", "version", *at)


def locate_firsts(windowed: DataFrame, packed: DataFrame) -> DataFrame:
    """``windowed`` with ``is_dup, location, ord``, from what ``pack_firsts`` made of it; ``ord`` of stored chunks only."""
    homes = packed.select("trace", "chunk_id", F.col("seq").alias("seq__"), F.col("win_pos").alias("win_pos__"), F.col("container_id").alias("location"), F.col("ord").alias("ord__"))
    dup = (F.col("seq") != F.col("seq__")) | (F.col("win_pos") != F.col("win_pos__"))
    found = windowed.where("chunk_id is not null").join(homes.where("chunk_id is not null"), ["chunk_id", "trace"]).select(*windowed.columns, dup.alias("is_dup"), "location", F.when(~dup, F.col("ord__")).alias("ord"))
    own = packed.where("chunk_id is null").select("trace", "seq", "win_pos", F.lit(False).alias("is_dup"), F.col("container_id").alias("location"), "ord")
    return found.unionByName(windowed.where("chunk_id is null").join(own, ["seq", "win_pos", "trace"]).select(*found.columns))


def locate(flagged: DataFrame, packed: DataFrame) -> DataFrame:
    """``flagged`` with ``location``, the container of every chunk in ``packed``."""
    homes = packed.where("chunk_id is not null").select("trace", "chunk_id", F.col("container_id").alias("location"))
    own = packed.where("chunk_id is null").select(*flagged.columns, F.col("container_id").alias("location"))
    return flagged.where("chunk_id is not null").join(homes, ["chunk_id", "trace"]).select(*flagged.columns, "location").unionByName(own)


def build_recipes(dedup_out: DataFrame, container_size: int, base_id: int = 0) -> DataFrame:
    """All chunks in ingest order, with their locations: adds ``recipe_id, slot``."""
    packed = block_ordinal(dedup_out, ["trace"], ["seq"], ["win_pos"], "gpos")
    return packed.withColumn("recipe_id", F.floor(F.col("gpos") / container_size) + base_id).withColumn("slot", (F.col("gpos") % container_size).cast("int"))


def version_extents(windowed: DataFrame) -> DataFrame:
    """``trace, version, n, low, high, first_seq``: chunks, least and largest position and first window; a row per version."""
    per = windowed.groupBy("trace", "version").agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high"), F.min("seq").alias("first_seq"))
    return stored(per, "versions")


def number_recipes(windowed: DataFrame, container_size: int) -> DataFrame:
    """``build_recipes`` of rows of ``assign_windows``, with columns to be joined later. Where positions have no gaps inside a version, they
    are the ordinals but for what comes before the version, and no row is moved.
    """
    per = version_extents(windowed)
    if not per.where("n <> high - low + 1").isEmpty():
        return build_recipes(windowed, container_size)
    before = Window.partitionBy("trace").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("trace", "version", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("first__"))
    numbered = windowed.join(F.broadcast(first), ["trace", "version"]).withColumn("gpos", F.col("first__") + F.col("pos")).drop("first__")
    return numbered.withColumn("recipe_id", F.floor(F.col("gpos") / container_size)).withColumn("slot", (F.col("gpos") % container_size).cast("int"))


def build_segment_recipes(segmented: DataFrame, base_id: int = 0) -> DataFrame:
    """One recipe per segment of a window (``seg``): adds ``recipe_id, slot``; whole segments are kept."""
    counts = segmented.groupBy("trace", "seq").agg((F.max("seg") + 1).alias("n"))
    offsets = sums_before(counts, ["trace"], ["seq"], "n", "first_recipe").drop("n")
    slot = F.row_number().over(Window.partitionBy("seq", "seg", "trace").orderBy("win_pos")) - 1
    return segmented.join(offsets, ["seq", "trace"]).withColumn("slot", slot).withColumn("recipe_id", F.col("first_recipe") + F.col("seg") + base_id).drop("first_recipe")


def number_segment_recipes(windowed: DataFrame, window_size: int, segment_size: int) -> Callable[[DataFrame], DataFrame]:
    """What adds the ``recipe_id`` of ``build_segment_recipes`` to rows of ``windowed`` cut by ``segment_fixed``; they need ``trace, version, seq, win_pos``.

    Where positions have no gaps, all windows but a version's last are full: a window's first recipe follows from the version's, and no row is moved.
    """
    per, seg = version_extents(windowed), F.floor(F.col("win_pos") / segment_size)
    if not per.where("low <> 0 or n <> high + 1").isEmpty():
        counts = windowed.groupBy("trace", "seq").agg((F.max(seg) + 1).alias("n"))
        offsets = stored(sums_before(counts, ["trace"], ["seq"], "n", "first__").drop("n"), "first_recipes")
        return lambda rows: rows.join(offsets, ["seq", "trace"]).withColumn("recipe_id", F.col("first__") + seg).drop("first__")
    full = -(-window_size // segment_size)
    own = F.expr(f"n div {window_size} * {full} + (n % {window_size} + {segment_size - 1}) div {segment_size}")
    before = Window.partitionBy("trace").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    first = F.broadcast(per.select("trace", "version", (F.coalesce(F.sum(own).over(before), F.lit(0)) - F.col("first_seq") * full).alias("first__")))  # one row per version
    return lambda rows: rows.join(first, ["trace", "version"]).withColumn("recipe_id", F.col("first__") + F.col("seq") * full + seg).drop("first__")


def subset_meta(rows: DataFrame, kind: str, id_col: str) -> DataFrame:
    """``trace, kind, subset_id, chunk_num, seq, version`` of containers or recipes."""
    return rows.groupBy("trace", F.lit(kind).alias("kind"), F.col(id_col).alias("subset_id")).agg(F.count("*").alias("chunk_num"), F.max("seq").alias("seq"), F.max("version").alias("version"))

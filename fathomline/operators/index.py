"""Sampled fingerprint index: hooks from ids to subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.ids import is_feature, is_hook


def build_hooks(subsets: DataFrame, sampled: Column, id_col: str, ord_col: str, kind: str = "container") -> DataFrame:
    """``trace, chunk_id, kind, subset_id, ord, version`` of the sampled ids; each subset once per id, at its first ordinal."""
    rows = subsets.where(sampled).groupBy("trace", "chunk_id", F.col(id_col).alias("subset_id")).agg(F.min(ord_col).alias("ord"), F.min("version").alias("version"))
    return rows.select("trace", "chunk_id", F.lit(kind).alias("kind"), "subset_id", "ord", "version")


def build_hybrid_hooks(
    rows: DataFrame, ones: int = 7, zeros: int = 7, uniform: bool = False, feature_ones: int = 7, feature_zeros: int = 0, ratio: int = 8, hook: Column | None = None, feature: Column | None = None
) -> DataFrame:
    """Hooks in four roles from ``trace, version, chunk_id, is_dup, location, recipe_id, ord``; repeats are kept.

    New chunks: a feature points to its recipe and to its container, a hook to its container. Every hook points to its recipe.
    ``hook`` and ``feature`` take the place of what the numbers say.
    """
    new = ~F.col("is_dup")
    hook = is_hook(F.col("chunk_id"), ones, zeros) if hook is None else hook
    feature = feature if feature is not None else is_feature(F.col("chunk_id"), F.col("ord"), uniform, feature_ones, feature_zeros, ratio)
    roles = F.filter(
        F.array(
            F.when(new & feature, F.struct(F.lit("recipe_ptr").alias("role"), F.col("recipe_id").alias("subset_id"))),
            F.when(new & feature, F.struct(F.lit("cnr_ptr").alias("role"), F.col("location").alias("subset_id"))),
            F.when(new & hook, F.struct(F.lit("cnr_hook").alias("role"), F.col("location").alias("subset_id"))),
            F.when(hook, F.struct(F.lit("recipe_hook").alias("role"), F.col("recipe_id").alias("subset_id"))),
        ),
        lambda r: r.isNotNull(),
    )
    return rows.where(hook | (new & feature)).select("trace", "version", "chunk_id", F.explode(roles).alias("r")).select("trace", "version", "chunk_id", "r.role", "r.subset_id")


def split_hybrid_hooks(rows: DataFrame, new: DataFrame, hook: Column, feature: Column) -> DataFrame:
    """``build_hybrid_hooks`` where stored chunks are given apart: ``rows (trace, version, chunk_id, recipe_id)`` are all chunks, ``new`` those that
    are stored, with ``location`` and what ``feature`` needs. Only stored chunks point to containers, so no other chunk's container is looked up.
    """
    parts = [("recipe_ptr", new.where(feature), "recipe_id"), ("cnr_ptr", new.where(feature), "location"), ("cnr_hook", new.where(hook), "location"), ("recipe_hook", rows.where(hook), "recipe_id")]
    made = [part.select("trace", "version", "chunk_id", F.lit(role).alias("role"), F.col(subset).alias("subset_id")) for role, part, subset in parts]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


def sample_min_hash(new_rows: DataFrame, count: int) -> DataFrame:
    """``trace, seq, chunk_id, rank``: of each window's new ids the ``count`` smallest; ids are hashes, so these are a sample."""
    rank = F.row_number().over(Window.partitionBy("seq", "trace").orderBy("chunk_id"))
    return new_rows.select("trace", "seq", "chunk_id").distinct().withColumn("rank", rank).where(F.col("rank") <= count)


def lookup_hooks(ids: DataFrame, hooks: DataFrame) -> DataFrame:
    """The subsets of each of ``ids (trace, chunk_id)``."""
    return ids.select("trace", "chunk_id").distinct().join(hooks, ["chunk_id", "trace"])


def hooks_version_bound(hooks: DataFrame, cur_version: int, bound: int) -> DataFrame:
    """Hooks of the last ``bound + 1`` versions."""
    return hooks.where(F.col("version") >= cur_version - bound)


def pointer_counts(hooks: DataFrame, bound: int) -> DataFrame:
    """``trace, version, pointers, live_pointers``: pointers made by a version, and those of the last ``bound + 1`` versions."""
    per = hooks.groupBy("trace", "version").agg(F.count("*").alias("pointers"))
    return per.withColumn("live_pointers", F.sum("pointers").over(Window.partitionBy("trace").orderBy("version").rangeBetween(-bound, 0)))


def index_stats(hooks: DataFrame, chunks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``trace, fingerprints, pointers, sample_ratio, recipe_ratio, container_ratio``.

    ``recipe_ratio``: all chunks for each recipe hook; ``container_ratio``: stored chunks for each container hook; 0.0 without
    such hooks. ``stored``: a row for each stored chunk, by default what exact deduplication stores. ``sample_ratio`` is null
    for an empty index.
    """
    of = lambda kind: F.count_if(F.col("kind") == kind)
    sizes = hooks.groupBy("trace").agg(F.countDistinct("chunk_id").alias("fingerprints"), F.count("*").alias("pointers"), of("recipe").alias("recipe_hooks"), of("container").alias("container_hooks"))
    totals = chunks.groupBy("trace").agg(F.count("*").alias("total"))
    kept = (chunks.select("trace", "chunk_id").distinct() if stored is None else stored).groupBy("trace").agg(F.count("*").alias("stored"))
    ratio = lambda n, d: F.coalesce(F.try_divide(n, d), F.lit(0.0))
    return totals.join(sizes, "trace", "left").join(kept, "trace", "left").select(
        "trace", F.coalesce("fingerprints", F.lit(0)).alias("fingerprints"), F.coalesce("pointers", F.lit(0)).alias("pointers"), F.floor(F.try_divide("total", "fingerprints")).alias("sample_ratio"),
        ratio("total", "recipe_hooks").alias("recipe_ratio"), ratio("stored", "container_hooks").alias("container_ratio"))

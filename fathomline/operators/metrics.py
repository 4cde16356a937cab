"""Reports over deduplicated versions and windows, and locality metrics. A rate over nothing is null."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.near_exact import Config


def _rate(total: str, stored: str):
    return F.round(F.try_divide(F.col(total).cast("double"), F.col(stored).cast("double")), 6)


def version_report(flagged: DataFrame, loads: DataFrame | None = None) -> DataFrame:
    """Per version and so far: chunks, stored chunks, windows, loads by kind, deduplication rate. ``loads``: ``trace, version, seq, kind`` per load."""
    per = flagged.groupBy("trace", "version").agg(F.count("*").alias("total"), F.count_if(~F.col("is_dup")).alias("stored"), F.countDistinct("seq").alias("windows"))
    if loads is not None:
        io = loads.groupBy("trace", "version").agg(F.count_if(F.col("kind") == "container").alias("cnr_loads"), F.count_if(F.col("kind") == "recipe").alias("recipe_loads"))
        per = per.join(io, ["trace", "version"], "left").fillna(0, ["cnr_loads", "recipe_loads"]).withColumn("loads", F.col("cnr_loads") + F.col("recipe_loads"))
    so_far = Window.partitionBy("trace").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    for c in [c for c in per.columns if c not in ("trace", "version")]:
        per = per.withColumn(f"all_{c}", F.sum(c).over(so_far))
    return per.withColumn("dedup_rate", _rate("total", "stored")).withColumn("all_dedup_rate", _rate("all_total", "all_stored"))


def hook_sums(hooks: DataFrame, versions: DataFrame, bound: int) -> DataFrame:
    """``trace, version, all_recipe, all_cnr, index_size, stored_recipe_hooks``: hooks so far by what they point to, indexed ids, and recipe hooks of the last ``bound + 1`` versions."""
    recipe = F.col("role").isin("recipe", "recipe_hook")
    cnr = F.col("role").isin("container", "cnr_ptr", "cnr_hook")
    made = hooks.groupBy("trace", "version").agg(F.count_if(recipe).alias("r"), F.count_if(cnr).alias("c"))
    firsts = hooks.groupBy("trace", "chunk_id").agg(F.min("version").alias("version")).groupBy("trace", "version").agg(F.count("*").alias("f"))
    per = versions.select("trace", "version").join(made, ["trace", "version"], "left").join(firsts, ["trace", "version"], "left").fillna(0)
    so_far = Window.partitionBy("trace").orderBy("version")
    total = lambda c, w: F.sum(c).over(w)
    return per.select(
        "trace", "version", total("r", so_far.rowsBetween(Window.unboundedPreceding, 0)).alias("all_recipe"), total("c", so_far.rowsBetween(Window.unboundedPreceding, 0)).alias("all_cnr"),
        total("f", so_far.rowsBetween(Window.unboundedPreceding, 0)).alias("index_size"), total("r", so_far.rangeBetween(-bound, 0)).alias("stored_recipe_hooks"))


def engine_report(rows: DataFrame, loads: DataFrame, hooks: DataFrame, cfg: Config, engine: str = "near_exact") -> DataFrame:
    """The whole report of a near-exact run: 22 columns, for a hybrid index 28, beside ``trace`` and ``version``. A sample ratio without hooks is 0."""
    per = version_report(rows, loads)
    per = per.join(hook_sums(hooks, per, cfg.version_bound), ["trace", "version"])
    ratio = lambda n, d: F.coalesce(_rate(n, d), F.lit(0.0))
    sizes = [F.lit(v).cast("int").alias(n) for n, v in (("cache_size", cfg.cache_size), ("container_size", cfg.container_size), ("window_size", cfg.window_size), ("io_cap", cfg.io_cap))]
    if cfg.kind == "hybrid":
        named = [F.lit(cfg.cap_adaptive).alias("cap_adaptive"), F.lit(float(cfg.hybrid_ratio)).alias("hybrid_recipe_ratio"), F.lit("uniform_for_cnr" if cfg.uniform else "random_for_cnr").alias("cnr_sampling"),
                 "index_size", "stored_recipe_hooks", F.col("all_cnr").alias("cnr_hooks"), (F.col("stored_recipe_hooks") + F.col("all_cnr")).alias("stored_hooks")]
    else:
        named = [F.lit(cfg.policy).alias("policy")]
    counts = ["windows", "cnr_loads", "recipe_loads", "loads", "total", "stored"]
    return per.select(
        "trace", "version", F.lit(engine).alias("engine"), *named, *sizes, *counts, *[f"all_{c}" for c in counts],
        ratio("all_total", "all_recipe").alias("recipe_sample_ratio"), ratio("all_stored", "all_cnr").alias("cnr_sample_ratio"), "dedup_rate", "all_dedup_rate")


def window_report(flagged: DataFrame) -> DataFrame:
    """``trace, version, seq, total, stored, rate`` of every window."""
    per = flagged.groupBy("trace", "version", "seq").agg(F.count("*").alias("total"), F.count_if(~F.col("is_dup")).alias("stored"))
    return per.withColumn("rate", _rate("total", "stored"))


def hit_counts(windowed: DataFrame, hooks: DataFrame, flagged: DataFrame) -> DataFrame:
    """``trace, version, hook_hits, cache_hits, cache_misses``."""
    hooked = hooks.select("trace", "chunk_id").distinct()
    hits = windowed.join(hooked, ["chunk_id", "trace"], "left_semi").groupBy("trace", "version").agg(F.count("*").alias("hook_hits"))
    cache = flagged.groupBy("trace", "version").agg(F.count_if("is_dup").alias("cache_hits"), F.count_if(~F.col("is_dup")).alias("cache_misses"))
    return cache.join(hits, ["trace", "version"], "left").fillna(0, ["hook_hits"]).select("trace", "version", "hook_hits", "cache_hits", "cache_misses")


def restore_cost(located: DataFrame) -> DataFrame:
    """``trace, version, n_windows, locations, mean_locations``: distinct containers that restoring a window needs."""
    per = located.select("trace", "version", "seq", "location").distinct().groupBy("trace", "version", "seq").agg(F.count("location").alias("n"))
    return per.groupBy("trace", "version").agg(F.count("*").alias("n_windows"), F.sum("n").alias("locations"), F.round(F.avg("n"), 6).alias("mean_locations"))


def index_breadth(selected: DataFrame, subsets: DataFrame) -> DataFrame:
    """``trace, seq, breadth``: distinct locations among all chunks of a window's loads. ``subsets``: ``trace, kind, subset_id, location``."""
    places = subsets.select("trace", "kind", "subset_id", "location").distinct()
    return selected.join(places, ["subset_id", "kind", "trace"]).select("trace", "seq", "location").distinct().groupBy("trace", "seq").agg(F.count("*").alias("breadth"))


def recipe_fragmentation(recipes: DataFrame) -> DataFrame:
    """``trace, recipe_id, chunks, containers``."""
    return recipes.groupBy("trace", "recipe_id").agg(F.count("*").alias("chunks"), F.countDistinct("location").alias("containers"))


def coverage_curve(windowed: DataFrame, subsets: DataFrame, version: int, k: int = 10) -> DataFrame:
    """``trace, kind, rank, subset_id, hits, covered``: distinct chunks of the version's first window that its best ``1..k`` earlier subsets cover.

    ``subsets``: ``trace, kind, subset_id, chunk_id, version`` from exact deduplication.
    """
    target = windowed.where((F.col("version") == version) & (F.col("win") == 0)).select("trace", "chunk_id").distinct()
    members = subsets.where(F.col("version") < version).join(target, ["chunk_id", "trace"], "left_semi")
    hits = members.groupBy("trace", "kind", "subset_id").agg(F.count("*").alias("hits"))
    order = Window.partitionBy("trace", "kind").orderBy(F.desc("hits"), "subset_id")
    top = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = members.join(top, ["subset_id", "kind", "trace"]).groupBy("trace", "kind", "chunk_id").agg(F.min("rank").alias("rank"))
    new = first.groupBy("trace", "kind", "rank").agg(F.count("*").alias("new"))
    curve = top.join(new, ["trace", "kind", "rank"], "left").fillna(0, ["new"])
    run = Window.partitionBy("trace", "kind").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return curve.select("trace", "kind", "rank", "subset_id", "hits", F.sum("new").over(run).alias("covered"))

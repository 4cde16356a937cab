"""The deduplication library's queries over traces made from the test tables; windows and containers of 256."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import ids as I
from fathomline.functions.storage import shared_dir, stored
from fathomline.operators import bloom as B
from fathomline.operators import exact as E
from fathomline.operators import index as H
from fathomline.operators import metrics as M
from fathomline.operators import near_exact as N
from fathomline.operators import ordinals as O
from fathomline.operators import select as C
from fathomline.operators import strict as K
from fathomline.operators import sweep as X
from fathomline.sources import traces as T
from fathomline.streaming import ingest as G

W = 256
CFG = N.Config(window_size=W, container_size=W, policy="sort", segment_size=64, hook_bits=(3, 3), feature_bits=(3, 0))
LAST, BATCHES = 4, 4


def windowed(spark: SparkSession, d: str) -> DataFrame:
    return O.assign_windows(T.snapshot_trace(spark, d), W)


class Steps:
    """What a query takes over the snapshot trace; each step is written once, when it is first used, and later ones read it."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self.hook, self.feature = I.is_hook_number(F.col("chunk_id"), 3, 3), I.sample_position(F.col("ord"), 8)  # of ``numbered``

    @cached_property
    def windowed(self) -> DataFrame:
        return stored(windowed(self.spark, self.d), "windowed")

    @cached_property
    def packed(self) -> DataFrame:
        return E.pack_firsts(self.windowed, W, W)

    @property
    def located(self) -> DataFrame:
        return E.locate_firsts(self.windowed, self.packed)

    @property
    def recipes(self) -> DataFrame:
        """Rows are numbered where they lie, before they meet their containers; a query that reads them more than once writes them."""
        return E.locate_firsts(E.number_recipes(self.windowed, W), self.packed)

    @cached_property
    def hooks(self) -> DataFrame:
        return stored(H.build_hooks(self.packed, I.sample_position(F.col("ord"), 8), "container_id", "ord"), "hooks")

    @cached_property
    def last(self) -> DataFrame:
        return self.windowed.where(F.col("version") == LAST)

    @cached_property
    def pairs(self) -> DataFrame:
        return stored(C.hook_pairs(C.hook_hits(self.last, earlier(self.hooks)), earlier(self.hooks)), "pairs")

    @cached_property
    def numbered(self) -> DataFrame:
        """``windowed`` with ids as numbers, for hybrid hooks: 8 bytes a key instead of 17 characters, and a hook is two low bits."""
        trace = T.snapshot_trace(self.spark, self.d, make_id=I.content_number, spread=True)
        return stored(O.assign_windows(trace, W).select("trace", "version", "pos", "seq", "win_pos", "chunk_id"), "numbered")

    @cached_property
    def new(self) -> DataFrame:
        """What is stored of ``numbered``."""
        return E.pack_firsts(self.numbered, W, W).withColumnRenamed("container_id", "location")

    @cached_property
    def newest(self) -> DataFrame:
        return self.numbered.where(F.col("version") == LAST).select("trace", "seq", "chunk_id")

    @cached_property
    def cut(self) -> Callable[[DataFrame], DataFrame]:
        """Adds the segment recipes of rows of ``numbered``."""
        return E.number_segment_recipes(self.numbered, W, 64)

    @property
    def role_hooks(self) -> DataFrame:
        """Hooks of exact rows of all versions with segment recipes, in four roles; ids are numbers."""
        return H.split_hybrid_hooks(self.cut(self.numbered), self.cut(self.new), self.hook, self.feature)

    @property
    def indexed(self) -> DataFrame:
        """``trace, chunk_id`` of earlier versions' hooks, once each: a stored chunk tells whether its id has any, and later ones add none."""
        return earlier(self.new).where(self.hook | self.feature).select("trace", "chunk_id")

    @property
    def window_pairs(self) -> DataFrame:
        """The distinct ids of the newest windows with the hooks they hit; ids meet their hooks where they are told apart."""
        hooks = earlier(self.role_hooks).select("trace", "chunk_id", "role", "subset_id")
        return self.newest.repartition("chunk_id", "trace").distinct().join(hooks, ["chunk_id", "trace"])

    @cached_property
    def role_pairs(self) -> DataFrame:
        """``window_pairs``, written for queries that read them more than once."""
        return stored(self.window_pairs, "role_pairs")


def earlier(hooks: DataFrame) -> DataFrame:
    return hooks.where(F.col("version") < LAST)


def all_windowed(spark: SparkSession, d: str) -> DataFrame:
    """All traces with their windows; the trace is written once, and everything else reads it."""
    return O.assign_windows(stored(T.all_traces(spark, d), "traces"), W)


def version_dedup_report(spark, d):
    return M.version_report(E.exact_dedup(all_windowed(spark, d)))


def window_dedup_report(spark, d):
    return M.window_report(E.exact_dedup(all_windowed(spark, d)))


def unique_chunks(spark, d):
    return E.unique_chunks(T.all_traces(spark, d))


def windows_legacy(spark, d):
    return O.assign_windows(T.snapshot_trace(spark, d), W, legacy_skip=True).select("trace", "version", "pos", "seq", "win", "win_pos")


def packed_containers(spark, d):
    s = Steps(spark, d)
    return s.packed.select("trace", "container_id", "slot", "chunk_id", "version", "seq", "ord")


def seal_status(spark, d):
    s = Steps(spark, d)
    return E.seal_status(s.packed)


def recipes_exact(spark, d):
    s = Steps(spark, d)
    return s.recipes.select("trace", "recipe_id", "slot", "chunk_id", "location", "version", "seq")


def segment_recipes(spark, d):
    return E.build_segment_recipes(O.segment_fixed(windowed(spark, d), 100)).select("trace", "version", "pos", "recipe_id", "slot")


def subset_meta(spark, d):
    s = Steps(spark, d)
    return E.subset_meta(s.packed, "container", "container_id").unionByName(E.subset_meta(s.recipes, "recipe", "recipe_id"))


def _segments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("trace", "version", "seq", "seg").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def segments_fixed(spark, d):
    return _segments(O.segment_fixed(windowed(spark, d), 100))


def segments_fixed_dropped(spark, d):
    return _segments(O.segment_fixed(windowed(spark, d), 100, drop_boundary=True))


def segments_content(spark, d):
    return _segments(O.segment_content(windowed(spark, d), 4))


def segments_pattern(spark, d):
    return _segments(O.segment_pattern(windowed(spark, d), 2))


def sample_position(spark, d):
    s = Steps(spark, d)
    return s.packed.where(I.sample_position(F.col("ord"), 8)).select("trace", "chunk_id", "ord")


def sample_chunk_id(spark, d):
    return E.unique_chunks(T.all_traces(spark, d)).where(I.sampler("chunkID", F.col("chunk_id"), F.lit(0), 8)).select("trace", "chunk_id")


def sample_bits(spark, d):
    c = F.col("chunk_id")
    flags = [I.sample_low_ones(c, 3).alias("low_ones"), I.sample_low_zeros(c, 3).alias("low_zeros"), I.sample_high_ones(c, 3).alias("high_ones"), I.sample_high_zeros(c, 3).alias("high_zeros"), I.is_hook(c, 2, 4).alias("hook"), I.sample_low_ones(c, 0).alias("never")]
    return E.unique_chunks(T.snapshot_trace(spark, d)).select("trace", "chunk_id", I.fingerprint_number(c).alias("fp"), *flags)


def sample_min_hash(spark, d):
    return H.sample_min_hash(E.exact_dedup(windowed(spark, d)).where(~F.col("is_dup")), 5)


def hook_index(spark, d):
    s = Steps(spark, d)
    return s.hooks


def sample_features(spark, d):
    """Both kinds of container features of hybrid indexes: by ordinal, and uniform by id bits."""
    s = Steps(spark, d)
    rows = s.packed
    feature = lambda uniform: I.is_feature(F.col("chunk_id"), F.col("ord"), uniform, 4, 3, 8)
    return rows.select("trace", "chunk_id", "ord", feature(False).alias("by_position"), feature(True).alias("uniform")).where("by_position or uniform")


def hook_hits_distinct(spark, d):
    s = Steps(spark, d)
    hits = s.newest.join(s.indexed, ["chunk_id", "trace"], "left_semi").distinct()
    return hits.select("trace", "seq", I.number_id(F.col("chunk_id")).alias("chunk_id"))


def hook_lookup(spark, d):
    s = Steps(spark, d)
    return H.lookup_hooks(s.last, earlier(s.hooks)).select("trace", "chunk_id", "subset_id", "ord")


def hook_stats(spark, d):
    s = Steps(spark, d)
    return H.index_stats(s.hooks, T.snapshot_trace(spark, d))


def hooks_version_bound(spark, d):
    s = Steps(spark, d)
    return H.hooks_version_bound(s.hooks, LAST, 2).select("trace", "chunk_id", "subset_id", "version")


def hook_pointer_counts(spark, d):
    s = Steps(spark, d)
    return H.pointer_counts(s.hooks, 2)


def hybrid_hooks(spark, d):
    s = Steps(spark, d)
    return s.role_hooks.withColumn("chunk_id", I.number_id(F.col("chunk_id")))


def hook_hits(spark, d):
    s = Steps(spark, d)
    return C.hook_hits(s.last, earlier(s.hooks))


def hit_counts(spark, d):
    flagged = stored(E.exact_dedup(windowed(spark, d)), "flagged")
    hooks = H.build_hooks(E.pack_containers(flagged.where(~F.col("is_dup")), W), I.sample_position(F.col("ord"), 8), "container_id", "ord")
    return M.hit_counts(flagged, earlier(hooks), flagged)


def candidate_scores(spark, d):
    s = Steps(spark, d)
    return C.candidate_scores(s.pairs).select("trace", "seq", "subset_id", "score", "n_hooks", F.col("first.first_pos").alias("first_pos"), F.col("first.ord").alias("first_ord"))


def select_sort(spark, d):
    s = Steps(spark, d)
    return C.select_sort(C.candidate_scores(s.pairs), 4)


def select_fifo(spark, d):
    s = Steps(spark, d)
    return C.select_fifo(C.candidate_scores(s.pairs), 2)


def select_all(spark, d):
    s = Steps(spark, d)
    return C.select_all(C.candidate_scores(s.pairs))


def select_sparse(spark, d):
    s = Steps(spark, d)
    return C.select_sparse(s.pairs, 4)


def select_level(spark, d):
    s = Steps(spark, d)
    meta = E.subset_meta(s.packed, "container", "container_id")
    return C.select_level(C.candidate_scores(s.pairs), meta, 4, W, W)


def select_hybrid(spark, d):
    s = Steps(spark, d)
    return C.select_hybrid(s.role_pairs, 4, 0.5)


def select_hybrid_basic(spark, d):
    s = Steps(spark, d)
    return C.select_hybrid_basic(s.window_pairs)


def select_hybrid_dense(spark, d):
    s = Steps(spark, d)
    meta = E.subset_meta(s.cut(s.numbered), "recipe", "recipe_id").unionByName(E.subset_meta(s.new, "container", "location"))
    return C.select_hybrid_dense(s.window_pairs, meta, 8)


def adaptive_cap(spark, d):
    s = Steps(spark, d)
    rp = s.role_pairs
    selected = C.select_hybrid(rp, 2).groupBy("trace", "seq").agg(F.count("*").alias("n_selected"))
    candidates = rp.where("role = 'cnr_ptr'").groupBy("trace", "seq").agg(F.countDistinct("subset_id").alias("n_candidates"))
    per = s.newest.select("trace", "seq").distinct().join(selected, ["seq", "trace"], "left").join(candidates, ["seq", "trace"], "left").fillna(0)
    return C.adaptive_io_cap(per, 2, 8)


def _step(spark, d, load) -> DataFrame:
    """The last version against exact containers of the earlier ones."""
    rows = stored(windowed(spark, d), "windowed")
    last = rows.where(F.col("version") == LAST)
    new = E.pack_firsts(rows, W, W).where(F.col("version") < LAST)
    hooks = stored(H.build_hooks(new, I.sample_position(F.col("ord"), 8), "container_id", "ord"), "hooks")
    selected = stored(C.select_sort(C.candidate_scores(C.hook_pairs(C.hook_hits(last, hooks), hooks)), 4), "selected")
    return N.dedup_against(last, load(last, selected, _held(new))).select("trace", "version", "pos", "seq", "chunk_id", "is_dup", "location")


def _held(rows: DataFrame) -> DataFrame:
    return rows.select("trace", F.lit("container").alias("kind"), F.col("container_id").alias("subset_id"), "chunk_id", F.col("container_id").alias("location"), "seq", "version")


def dedup_step_sort(spark, d):
    return _step(spark, d, N.load_subsets)


def dedup_step_no_flush(spark, d):
    return _step(spark, d, N.load_without_flush)


def numbers(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot trace with ids as numbers, dealt over all tasks, for runs whose results show no id."""
    return T.snapshot_trace(spark, d, make_id=I.content_number, spread=True)


def _near(spark, d, **change) -> DataFrame:
    cfg = replace(CFG, **change)
    rows, loads, state = N.near_exact_dedup(numbers(spark, d), cfg)
    return M.engine_report(rows, loads, state.hooks, cfg, "hybrid" if cfg.kind == "hybrid" else "near_exact")


def near_exact_report(spark, d):
    return _near(spark, d, io_cap=4)


def near_exact_no_flush_report(spark, d):
    return _near(spark, d, io_cap=1, policy="fifo", flush=False)


def near_exact_recipe_report(spark, d):
    return _near(spark, d, kind="recipe", io_cap=4)


def hybrid_report(spark, d):
    return _near(spark, d, kind="hybrid", io_cap=4, hybrid_ratio=0.5, cap_adaptive=True, cache_size=16)


def restore_cost(spark, d):
    s = Steps(spark, d)
    return M.restore_cost(s.located)


def index_breadth(spark, d):
    s = Steps(spark, d)
    numbered = earlier(E.number_recipes(s.windowed, W))
    hooks = stored(H.build_hooks(numbered, I.sample_position(F.col("gpos"), 8), "recipe_id", "gpos", "recipe"), "hooks")
    subsets = E.locate_firsts(numbered, s.packed).select("trace", F.lit("recipe").alias("kind"), F.col("recipe_id").alias("subset_id"), "location")
    selected = C.select_sort(C.candidate_scores(C.hook_pairs(C.hook_hits(s.last, hooks), hooks)), 4)
    return M.index_breadth(selected, subsets)


def recipe_fragmentation(spark, d):
    s = Steps(spark, d)
    return M.recipe_fragmentation(s.recipes)


def coverage_curve(spark, d):
    flagged = stored(E.exact_dedup(windowed(spark, d)), "flagged")
    r = E.build_recipes(flagged, W).select("trace", F.lit("recipe").alias("kind"), F.col("recipe_id").alias("subset_id"), "chunk_id", "version")
    c = E.pack_containers(flagged.where(~F.col("is_dup")), W).select("trace", F.lit("container").alias("kind"), F.col("container_id").alias("subset_id"), "chunk_id", "version")
    return M.coverage_curve(flagged, stored(r.unionByName(c), "subsets"), LAST)


def fnv_partition(spark, d):
    return B.hash_partition(E.unique_chunks(T.snapshot_trace(spark, d)), 65).select("trace", "chunk_id", "part")


def _store(spark, d) -> tuple[DataFrame, DataFrame, int]:
    """The trace, its partitioned store, and the number of partitions, which grows with the data."""
    trace = stored(T.snapshot_trace(spark, d), "snapshot")
    parts = B.partitions_for(trace, W)
    return trace, stored(B.partitioned_store(trace, parts, W), "store"), parts


def partitioned_containers(spark, d):
    return B.partitioned_store(T.snapshot_trace(spark, d), 65, W)


def bloom_filters(spark, d):
    """Every filter's members, set bits and the digest of their positions."""
    _, store, _ = _store(spark, d)
    _, m = B.bloom_size(W, 0.001)
    byte = lambda i: F.conv(F.hex(F.substring(F.col("bits"), (i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    at = F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.call_function("getbit", byte(i), (i % 8)) == 1)
    return B.bloom_build(store, W).withColumn("at", at).select("trace", "part", "bf_no", "members", F.size("at").cast("long").alias("set_bits"), F.md5(F.array_join(F.col("at").cast("array<string>"), ",").cast("binary")).alias("digest"))


def bloom_members(spark, d):
    """Stored ids that the filter of their own container may hold: all of them; and what other filters of their partition hold."""
    _, store, _ = _store(spark, d)
    hits = B.bloom_probe(store, B.bloom_build(store, W), W)
    own = hits.join(store.select("trace", "part", "chunk_id", F.col("bf_no").alias("own")), ["trace", "part", "chunk_id"])
    return own.groupBy("trace", "part").agg(F.count_if(F.col("bf_no") == F.col("own")).alias("found"), F.count_if(F.col("bf_no") != F.col("own")).alias("others"))


def _loads(spark, d, cache: int) -> DataFrame:
    trace, store, _ = _store(spark, d)
    loads = B.bloom_loads(trace, store, W, cache)
    return loads.groupBy("trace", "part", "version").agg(F.count("*").alias("matches"), F.count_if("load").alias("loads"))


def bloom_loads(spark, d):
    return _loads(spark, d, 1)


def bloom_loads_cached(spark, d):
    return _loads(spark, d, 2)


def bloom_report(spark, d):
    trace, store, parts = _store(spark, d)
    return B.bloom_report(trace, store, B.bloom_loads(trace, store, W), W, partitions=parts)


def bloom_fpp(spark, d):
    _, store, _ = _store(spark, d)
    return B.bloom_fpp(store, B.bloom_build(store, W), W)


def _sweep_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = stored(windowed(spark, d), "windowed")
    new = E.pack_firsts(rows, W, W).where(F.col("version") < LAST)
    return rows.where(F.col("version") == LAST), new


def io_cap_sweep(spark, d):
    last, new = _sweep_tables(spark, d)
    hooks = stored(H.build_hooks(new, I.sample_position(F.col("ord"), 8), "container_id", "ord"), "hooks")
    return X.io_cap_sweep(last, hooks, _held(new), [1, 2, 4, 6, 20])


def ratio_sweep(spark, d):
    last, new = _sweep_tables(spark, d)
    return X.ratio_sweep(last, new, _held(new), [4, 8, 32], 4)


def run_sweep(spark, d):
    """Whole runs of three caps over three traces, all versions."""
    traces = numbers(spark, d).unionByName(T.doc_lines_trace(spark, d, I.content_number)).unionByName(T.events_trace(spark, d, I.content_number))
    return X.run_sweep(stored(traces, "traces"), CFG, [{"io_cap": c} for c in (4, 6, 20)])


def bit_sweep(spark, d):
    """Whole hybrid runs that differ in the sampled bits and in how long recipe hooks live."""
    grid = [{"hook_bits": (b, b), "version_bound": v} for b, v in ((2, 1000), (3, 1000), (3, 0), (4, 1))]
    return X.run_sweep(stored(numbers(spark, d), "snapshot"), replace(CFG, kind="hybrid", io_cap=4, hybrid_ratio=0.5), grid)


def _strict(spark, d, policy: str) -> DataFrame:
    cfg = replace(CFG, policy=policy, grid=({"io_cap": 1}, {"io_cap": 4}))
    rows, loads, _ = K.strict_dedup(stored(numbers(spark, d), "snapshot"), cfg)
    return X.variant_report(rows, loads, cfg)


def strict_sort_report(spark, d):
    """Strict sealing: every window sees what the windows before it have sealed."""
    return _strict(spark, d, "sort")


def strict_fifo_report(spark, d):
    return _strict(spark, d, "fifo")


def ingest_bounded(spark, d):
    """Two traces ingested version by version into one hybrid index whose recipe hooks live for a version; their windows count apart."""
    store, cfg = f"{shared_dir(spark)}/store", replace(CFG, kind="hybrid", io_cap=4, hybrid_ratio=0.5, version_bound=0)
    trace = stored(numbers(spark, d).unionByName(T.doc_lines_trace(spark, d, I.content_number)), "traces", "version")
    for v in sorted(r.version for r in trace.select("version").distinct().collect()):  # one row per version
        G.ingest_version(spark, store, trace.where(F.col("version") == v), v, cfg)
    rows = spark.read.schema(N.of_ids(G.DEDUP, trace)).parquet(f"{store}/rows")
    per = rows.groupBy("trace", "version").agg(F.count("*").alias("total"), F.count_if(~F.col("is_dup")).alias("stored"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    loads = spark.read.parquet(f"{store}/loads").groupBy("trace", "version").agg(F.count("*").alias("loads"))
    return per.join(loads, ["trace", "version"], "left").fillna(0, ["loads"])


def strategy_compare(spark, d):
    variants = {"sort": {"policy": "sort"}, "fifo": {"policy": "fifo"}, "sparse": {"policy": "sparse"}, "level": {"policy": "level"},
                "recipe": {"kind": "recipe", "policy": "sort"}, "hybrid": {"kind": "hybrid", "io_cap": 4, "hybrid_ratio": 0.5}}
    return X.compare_strategies(stored(T.snapshot_trace(spark, d), "snapshot"), CFG, variants, numbers=stored(numbers(spark, d), "numbers"))


def recipe_roundtrip(spark, d):
    s = Steps(spark, d)
    path = f"{shared_dir(spark)}/recipes"
    T.write_recipes(s.recipes, path)
    return T.read_recipes(spark, path)


def recipe_files_roundtrip(spark, d):
    s = Steps(spark, d)
    path = f"{shared_dir(spark)}/recipe_files"
    T.export_recipe_files(s.recipes, path)
    return T.read_recipe_files(spark, path, "snapshot")


def _written_and_read(spark, report: DataFrame) -> DataFrame:
    path = f"{shared_dir(spark)}/report"
    T.write_version_report(report, path)
    return T.read_version_report(spark, path, report.schema)


def report_roundtrip(spark, d):
    return _written_and_read(spark, version_dedup_report(spark, d))


def near_exact_report_roundtrip(spark, d):
    """The report of a near-exact run (22 columns) as text, read back."""
    return _written_and_read(spark, near_exact_report(spark, d))


def hybrid_report_roundtrip(spark, d):
    """The report of a hybrid run (28 columns) as text, read back."""
    return _written_and_read(spark, hybrid_report(spark, d))


def window_rates_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/rates"
    T.write_window_rates(M.window_report(E.exact_dedup(windowed(spark, d))), path)
    return T.read_window_rates(spark, path)


def manifest_roundtrip(spark, d):
    """A text trace and its manifest, written and read back: a line per version, a folder of part files for each."""
    base, trace = shared_dir(spark), T.snapshot_trace(spark, d)
    T.write_trace(trace, f"{base}/trace")
    lines = "\n".join(f"file=v{v} 8" for v in range(LAST + 1))
    spark.createDataFrame([(lines,)], "value string").coalesce(1).write.text(f"{base}/manifest")
    return T.read_trace(spark, f"{base}/trace", T.read_manifest(spark, f"{base}/manifest", "snapshot"))


def trace_roundtrip(spark, d):
    path = f"{shared_dir(spark)}/trace"
    T.write_trace(T.snapshot_trace(spark, d), path)
    return T.read_written_trace(spark, path, "snapshot")


def events_stream(spark: SparkSession, d: str, base: str) -> DataFrame:
    """The events table as files that arrive in a landing folder."""
    events = spark.read.parquet(f"{d}/events.parquet")
    events.write.parquet(f"{base}/landing")
    return spark.readStream.schema(events.schema).parquet(f"{base}/landing")


def stream_exact_dedup(spark, d):
    """Ids of the events stream, each at its first arrival, by a stream that runs until its input is read."""
    base = shared_dir(spark)
    source = events_stream(spark, d, base)
    ids = source.select(F.lit("events").alias("trace"), I.content_id(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))).alias("chunk_id"))
    query = G.stream_exact_dedup(ids).writeStream.format("parquet").option("path", f"{base}/ids").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("trace string, chunk_id string").parquet(f"{base}/ids")


def stream_near_exact(spark, d):
    """Near-exact deduplication of the events stream, a micro-batch per epoch: the events land in ``BATCHES`` files, read one by one."""
    base = shared_dir(spark)
    events = spark.read.parquet(f"{d}/events.parquet")
    n = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    for b in range(BATCHES):  # files arrive one after another
        events.where(F.floor(F.col("event_id") * BATCHES / n) == b).coalesce(1).write.mode("append").parquet(f"{base}/landing")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing")
    ids = source.select(F.lit("events").alias("trace"), F.col("event_id").alias("ordinal"), I.content_id(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type"))).alias("chunk_id"))
    G.stream_near_exact(ids, f"{base}/store", CFG, f"{base}/state").awaitTermination()
    rows = spark.read.schema(G.DEDUP).parquet(f"{base}/store/rows")
    return rows.groupBy("trace", "version").agg(F.count("*").alias("total"), F.count_if(~F.col("is_dup")).alias("stored"), F.countDistinct("seq").alias("windows"))


def incremental_ingest(spark, d):
    """The versions ingested one by one against the stored index; equals the epoch run."""
    store = f"{shared_dir(spark)}/store"
    trace = stored(T.snapshot_trace(spark, d), "snapshot")
    for v in sorted(r.version for r in trace.select("version").distinct().collect()):
        G.ingest_version(spark, store, trace.where(F.col("version") == v), v, CFG)
    return M.version_report(spark.read.schema(G.DEDUP).parquet(f"{store}/rows")).select("trace", "version", "total", "stored", "windows")


NAMES = """version_dedup_report window_dedup_report unique_chunks windows_legacy packed_containers seal_status recipes_exact segment_recipes subset_meta
segments_fixed segments_fixed_dropped segments_content segments_pattern sample_position sample_chunk_id sample_bits sample_min_hash sample_features hook_index
hook_lookup hook_stats hooks_version_bound hook_pointer_counts hybrid_hooks hook_hits hook_hits_distinct hit_counts candidate_scores select_sort select_fifo
select_all select_sparse select_level select_hybrid select_hybrid_basic select_hybrid_dense adaptive_cap dedup_step_sort dedup_step_no_flush near_exact_report
near_exact_no_flush_report near_exact_recipe_report hybrid_report restore_cost index_breadth recipe_fragmentation coverage_curve fnv_partition
partitioned_containers bloom_filters bloom_members bloom_loads bloom_loads_cached bloom_report bloom_fpp io_cap_sweep ratio_sweep run_sweep bit_sweep
strict_sort_report strict_fifo_report ingest_bounded strategy_compare
recipe_roundtrip recipe_files_roundtrip report_roundtrip near_exact_report_roundtrip hybrid_report_roundtrip window_rates_roundtrip trace_roundtrip manifest_roundtrip stream_exact_dedup stream_near_exact
incremental_ingest""".split()

"""Near-exact deduplication: each window is held against the few subsets that its hooks choose.

The index is frozen for an epoch (a version, ``n`` windows or one window); all windows of an epoch run in parallel,
and what it stored becomes searchable at its end. Between epochs the state is Parquet, never lineage: members, hooks and
loads are tables that grow by a folder per epoch, and of each trace a row of counters is kept (next ids and ordinals; and
windows, loads and candidates so far, by which an adaptive cap goes on).

Members are kept in pieces: a row holds what one window put into one subset, as an array. An epoch makes a row of each of its
windows too, and a window meets the pieces of its loads in one task (``find``), so what is shuffled are windows and pieces, not
chunks. Ids may be text or numbers (``content_number``), which cost less.

Many configurations run as one: with ``Config.grid`` each trace is taken once for each variant, under the name
``<number>|<trace>``, which is part of every key of the state, so each variant has the feedback of its own versions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from fathomline.functions.ids import is_feature, is_hook, is_hook_number, sampler
from fathomline.functions.storage import RANGED, Growing, ranged, stored
from fathomline.functions.workers import workers_import_package
from fathomline.operators import select as S
from fathomline.operators.index import build_hooks, build_hybrid_hooks
from fathomline.operators.ordinals import assign_windows, segment_content, segment_fixed, sums_before

MEMBERS = "trace string, kind string, subset_id long, chunk_id string, location long, seq long, version int"
PIECES = "trace string, kind string, subset_id long, ids array<string>, places array<long>, seq long, version int"
HOOKS = "trace string, chunk_id string, kind string, role string, subset_id long, ord long, version int"


def of_ids(schema: str, rows: DataFrame) -> str:
    """``schema`` with ids of the type that ``rows`` have."""
    kind = dict(rows.dtypes)["chunk_id"]
    return schema.replace("chunk_id string", f"chunk_id {kind}").replace("ids array<string>", f"ids array<{kind}>")


@dataclass(frozen=True)
class Config:
    """Settings, with the names and defaults of the original configuration."""

    kind: str = "container"  # container, recipe or hybrid
    policy: str = "sparse"  # sort, fifo, sparse, level or all
    io_cap: int = 1
    window_size: int = 1024
    container_size: int = 1024
    method: str = "position"
    ratio: int = 8
    cap_adaptive: bool = False
    cache_size: int = 1024
    segment_size: int = 1024
    segmenting_bits: int = 0
    hook_bits: tuple[int, int] = (7, 7)
    feature_bits: tuple[int, int] = (7, 0)
    uniform: bool = False
    hybrid_ratio: float = 2.3
    version_bound: int = 1000
    flush: bool = True
    intra: str = "none"  # or exact: repeats inside an epoch point at their first occurrence
    grid: tuple[dict, ...] = ()  # variants: settings of VARIED that differ; traces are named "<number>|<trace>"

    def each(self, name: str, make: Callable[..., Column]) -> Column:
        """``make`` of a setting; in a grid, of the setting of each row's variant."""
        values = [v.get(name, getattr(self, name)) for v in self.grid] or [getattr(self, name)]
        number, out = F.split("trace", r"\|")[0], None
        for value in dict.fromkeys(values):
            own = number.isin([str(i) for i, v in enumerate(values) if v == value])
            out = make(value) if len(set(values)) == 1 else F.when(own, make(value)) if out is None else out.when(own, make(value))
        return out

    def most(self, name: str) -> int:
        return max([v.get(name, getattr(self, name)) for v in self.grid] or [getattr(self, name)])


#: Settings that the variants of a grid may differ in; all others shape the tables or the plan.
VARIED = ("io_cap", "ratio", "hook_bits", "feature_bits", "hybrid_ratio", "version_bound")
LOADS = "trace string, seq long, kind string, subset_id long, load_rank int, version int"
FIRSTS = "trace string, chunk_id string, seq long, load_rank int, location long"


@dataclass(frozen=True)
class Counters:
    """Of one trace: next container, recipe, stored ordinal and ingest ordinal; windows, loads and candidates so far."""

    container: int = 0
    recipe: int = 0
    ord: int = 0
    ingest: int = 0
    windows: int = 0
    loads: int = 0
    candidates: int = 0


@dataclass
class State:
    """What earlier epochs left: members of searchable subsets, hooks, counters by trace, and (where nothing is flushed) the first load of every id.

    ``pieces`` are the same members as they are stored; without them they are made from ``members``.
    """

    members: DataFrame
    hooks: DataFrame
    firsts: DataFrame
    counters: dict[str, Counters] = field(default_factory=dict)
    pieces: DataFrame | None = None


@dataclass
class Made:
    """What an epoch made: its rows, its loads, the pieces of new members, hooks, the counters after it, and ids that were never loaded before."""

    rows: DataFrame
    loads: DataFrame
    pieces: DataFrame
    hooks: DataFrame
    counters: dict[str, Counters]
    firsts: DataFrame | None = None

    @property
    def members(self) -> DataFrame:
        return unpacked(self.pieces)


def empty_state(chunks: DataFrame) -> State:
    return State(*(chunks.sparkSession.createDataFrame([], of_ids(s, chunks)) for s in (MEMBERS, HOOKS, FIRSTS)))


def unpacked(pieces: DataFrame) -> DataFrame:
    """The members of ``pieces``, a row for each; a member of a container lies where its container is."""
    named = ["trace", "kind", "subset_id", "seq", "version", *[RANGED] * (RANGED in pieces.columns)]
    rows = pieces.select(*named, "places", F.posexplode("ids").alias("at__", "chunk_id"))
    return rows.select(*named[:3], "chunk_id", F.coalesce(F.get("places", F.col("at__")), "subset_id").alias("location"), *named[3:])


def piece_meta(pieces: DataFrame, candidates: DataFrame) -> DataFrame:
    """``subset_meta`` of the candidates, from their pieces."""
    met = _of_loaded(pieces, candidates.withColumnRenamed("score", "load_rank"))
    return met.groupBy("trace", "kind", "subset_id").agg(F.sum(F.size("ids")).alias("chunk_num"), F.max("seq").alias("seq"), F.max("version").alias("version"))


def packed(members: DataFrame) -> DataFrame:
    """Pieces of ``members``, one for each subset and window."""
    whole = members.groupBy("subset_id", "seq", "kind", "trace", *[RANGED] * (RANGED in members.columns)).agg(F.collect_list(F.struct("chunk_id", "location")).alias("m"), F.max("version").alias("version"))
    return whole.withColumns({"ids": F.col("m.chunk_id"), "places": F.col("m.location")}).drop("m")


def _of_loaded(members: DataFrame, selected: DataFrame) -> DataFrame:
    """Members of selected subsets; of a table kept by ranges only the ranges of these are read (the filter on ranks, true of all, lets Spark prune by them)."""
    ids, key = selected.where("load_rank > 0").select("trace", "kind", "subset_id").distinct(), ["subset_id", "kind", "trace"]
    return members.join(ranged(ids), [*key, RANGED], "left_semi").drop(RANGED) if RANGED in members.columns else members.join(ids, key, "left_semi")


def places(windowed: DataFrame, selected: DataFrame, members: DataFrame) -> DataFrame:
    """``trace, kind, subset_id, chunk_id, location`` of incoming ids in selected subsets: members are pruned twice before they are grouped."""
    held = _of_loaded(members, selected)
    held = held.join(windowed.select("trace", "chunk_id"), ["chunk_id", "trace"], "left_semi")
    return held.groupBy("trace", "kind", "subset_id", "chunk_id").agg(F.min("location").alias("location"))


def loaded(selected: DataFrame, members: DataFrame) -> DataFrame:
    """``trace, seq, chunk_id, location``: all ids that the loads of each window hold, at the first load's (least) location.

    A window has at most its loads' members, however often an id was stored, so the work grows with the loads.
    """
    key, ranks = ["subset_id", "kind", "trace"], selected.where("load_rank > 0").select("trace", "seq", "kind", "subset_id", "load_rank")
    held = members.drop("seq").join(ranged(ranks), [*key, RANGED]) if RANGED in members.columns else members.drop("seq").join(ranks, key)
    # dealt once, for both minima and for the rows that meet them
    held = held.select("chunk_id", "seq", "trace", "load_rank", "location").repartition("chunk_id", "seq", "trace")
    least = held.groupBy("chunk_id", "seq", "trace", "load_rank").agg(F.min("location").alias("location"))
    return least.groupBy("chunk_id", "seq", "trace").agg(F.min_by("location", "load_rank").alias("location"))


def load_subsets(windowed: DataFrame, selected: DataFrame, members: DataFrame) -> DataFrame:
    """``trace, seq, chunk_id, location``: ids of each window that its loads hold, at the first load's location."""
    ids = windowed.select("trace", "seq", "chunk_id").distinct()
    return ids.join(loaded(selected, members), ["chunk_id", "seq", "trace"]).select("trace", "seq", "chunk_id", "location")


def load_without_flush(windowed: DataFrame, selected: DataFrame, members: DataFrame) -> DataFrame:
    """As ``load_subsets`` for a cache that is never emptied: ``selected`` has the loads of earlier windows and epochs too, the first location wins."""
    first = places(windowed, selected, members).join(selected, ["subset_id", "kind", "trace"]).groupBy("trace", "chunk_id").agg(F.min(F.struct("seq", "load_rank", "location")).alias("f"))
    ids = windowed.select("trace", "seq", "chunk_id").distinct().join(first, ["chunk_id", "trace"])
    return ids.where(F.col("f.seq") <= F.col("seq")).select("trace", "seq", "chunk_id", F.col("f.location").alias("location"))


def first_loads(loads: DataFrame, pieces: DataFrame, firsts: DataFrame) -> DataFrame:
    """``trace, chunk_id, seq, load_rank, location``: when ids came into a cache that is never emptied, of those that ``firsts`` has not.

    Later epochs have larger ``seq``, so what an earlier one loaded stays first: the table only grows, by what an epoch's own loads hold.
    """
    held = unpacked(_of_loaded(pieces, loads)).groupBy("trace", "kind", "subset_id", "chunk_id").agg(F.min("location").alias("location"))
    first = held.join(loads, ["subset_id", "kind", "trace"]).groupBy("trace", "chunk_id").agg(F.min(F.struct("seq", "load_rank", "location")).alias("f"))
    return first.join(firsts.select("trace", "chunk_id"), ["chunk_id", "trace"], "left_anti").select("trace", "chunk_id", "f.*")


def dedup_against(windowed: DataFrame, found: DataFrame) -> DataFrame:
    """Add ``is_dup, location``; repeats of a new id inside a window are all new."""
    return windowed.join(found, ["chunk_id", "seq", "trace"], "left").withColumn("is_dup", F.col("location").isNotNull())


def choose(hits: DataFrame, state: State, pieces: DataFrame, cfg: Config) -> DataFrame:
    """``trace, seq, kind, subset_id, load_rank``: what each window loads, by its hits; under an adaptive cap, all that it might."""
    hooks = state.hooks
    if cfg.kind == "hybrid":
        pairs = _live_pairs(hits, hooks, cfg).drop("version")
        variants = [replace(cfg, grid=(), **v) for v in cfg.grid] or [cfg]
        limits = {i: S.hybrid_recipe_limit(v.io_cap, v.hybrid_ratio) for i, v in enumerate(variants)}
        by_trace = F.element_at(F.array(*map(F.lit, limits.values())), (F.split("trace", r"\|")[0].cast("int") + 1) if cfg.grid else F.lit(1))
        selected = S.select_hybrid(pairs, 0, limits=by_trace, most=max(limits.values()))
        return stored(selected, "selected") if cfg.cap_adaptive else S.apply_io_cap(selected, cfg.each("io_cap", F.lit))
    hits = hits.drop("version")
    if cfg.policy in ("sort", "sparse"):
        return select_from(S.leading_pairs(hits, hooks, cfg.most("io_cap")), None, cfg)

    def made(candidates: DataFrame) -> DataFrame:
        """When the candidates were made: of their members only."""
        return piece_meta(pieces, candidates)

    return select_from(S.hook_pairs(hits, hooks), made, cfg)


def select_from(pairs: DataFrame, meta: Callable[[DataFrame], DataFrame] | None, cfg: Config) -> DataFrame:
    """The loads of each window by the policy, from its hits and what they point to. ``meta`` gives the facts of candidates, for ``level``."""
    cap, most = cfg.each("io_cap", F.lit), cfg.most("io_cap")
    if cfg.policy == "sparse":
        return S.select_sparse(pairs, cap, most)
    candidates = S.candidate_scores(pairs)
    if cfg.policy == "sort":
        return S.select_sort(candidates, cap)
    if cfg.policy == "fifo":
        return S.select_fifo(candidates, cap)
    if cfg.policy == "level":
        candidates = stored(candidates, "candidates")
        return S.select_level(candidates, meta(candidates), cap, cfg.window_size, cfg.container_size, most)
    if cfg.policy == "all":
        return S.apply_io_cap(S.select_all(candidates), cap)
    raise ValueError(f"unknown policy: {cfg.policy}")


def _live_pairs(ids: DataFrame, hooks: DataFrame, cfg: Config) -> DataFrame:
    """``trace, seq, version, chunk_id, role, subset_id``: distinct hits of each window; recipe hooks of more than ``version_bound`` versions ago have expired."""
    pairs = ids.select("trace", "seq", "version", "chunk_id").join(hooks.select("trace", "chunk_id", "role", "subset_id", F.col("version").alias("made")), ["chunk_id", "trace"])
    return pairs.where(~F.col("role").startswith("recipe") | (F.col("made") >= F.col("version") - cfg.each("version_bound", F.lit))).drop("made")


def _counted(df: DataFrame, counters: dict[str, Counters], *names: str) -> DataFrame:
    """Add counters of each row's trace as ``<name>__``; one row per trace is sent."""
    rows = [(t, *(getattr(c, n) for n in names)) for t, c in counters.items()]
    table = df.sparkSession.createDataFrame(rows, "trace string, " + ", ".join(f"{n}__ long" for n in names))
    joined = df.join(F.broadcast(table), "trace", "left")
    return joined.withColumns({f"{n}__": F.coalesce(f"{n}__", F.lit(0).cast("long")) for n in names})


def _cap(windows: DataFrame, hits: DataFrame, selected: DataFrame, state: State, cfg: Config) -> tuple[DataFrame, dict[str, tuple]]:
    """Loads under the adaptive cap, and by trace the windows, loads and candidates of this epoch."""
    pointers = hits.select("trace", "seq", "chunk_id").join(state.hooks.where("role = 'cnr_ptr'").select("trace", "chunk_id", "subset_id"), ["chunk_id", "trace"])
    n_candidates = pointers.groupBy("trace", "seq").agg(F.countDistinct("subset_id").alias("n_candidates"))
    n_selected = selected.groupBy("trace", "seq").agg(F.count("*").alias("n_selected"))
    per = windows.select("trace", "seq").join(n_selected, ["seq", "trace"], "left").join(n_candidates, ["seq", "trace"], "left").fillna(0)
    per = stored(per, "per_window")
    caps = stored(S.adaptive_io_cap(per, cfg.each("io_cap", F.lit), cfg.cache_size, {t: (c.windows, c.loads, c.candidates) for t, c in state.counters.items()}), "caps")
    sums = per.join(caps, ["seq", "trace"]).groupBy("trace").agg(F.count("*"), F.sum("loads"), F.sum("n_candidates")).collect()  # one row per trace
    chosen = selected.join(caps.select("trace", "seq", "cap"), ["seq", "trace"]).where(F.col("load_rank") <= F.greatest("cap", F.lit(1))).drop("cap")
    return chosen, {r[0]: tuple(r)[1:] for r in sums}


def hits_of(windowed: DataFrame, hooks: DataFrame, cfg: Config) -> DataFrame:
    """The hits of all windows; of a grid, chunks meet the hooks of all variants once, and what a variant has no hook of meets nothing later."""
    if cfg.grid:
        hooks = hooks.select(F.split("trace", r"\|", 2)[1].alias("trace"), "chunk_id")
    return stored(by_variant(S.hook_hits(windowed, hooks, "version"), cfg), "hits")


def window_blocks(windowed: DataFrame) -> DataFrame:
    """A row for each window: ``ids`` and whatever else its chunks have, as arrays in their order."""
    whole = [c for c in ("seq", "trace", "version", "win") if c in windowed.columns]
    own = [c for c in windowed.columns if c not in (*whole, "win_pos", "chunk_id")]
    rows = windowed.repartition("seq", "trace").groupBy(*whole).agg(F.sort_array(F.collect_list(F.struct("win_pos", "chunk_id", *own))).alias("r"))
    return rows.select(*whole, F.col("r.chunk_id").alias("ids"), *[F.col(f"r.{c}").alias(c) for c in ("win_pos", *own)])


#: Windows that are searched together.
SEARCHED = 256


def search(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The windows among ``rows`` with ``found``, the place of each chunk at its first load that holds it (the least), and ``nth`` and ``news``, the numbers
    and the ids of those that none holds. A window's row (rank 0) comes before the pieces of its loads. Chunks without an id are never found.
    """
    rank, ids = rows["load_rank"].to_numpy(), rows["ids"]
    first, lengths = rank == 0, ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, window = ids.flatten(), np.repeat(np.cumsum(first) - 1, lengths)
    code = flat.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    point, own = window * (len(flat) + 1) + code, np.repeat(first, lengths)
    want, at = np.unique(point[own], return_inverse=True)
    held = ~own & (code >= 0)
    place = np.repeat(rows["home"].fill_null(0).to_numpy(zero_copy_only=False), lengths)
    listed = np.repeat(rows["places"].is_valid().to_numpy(zero_copy_only=False), lengths)
    place[listed] = rows["places"].flatten().to_numpy(zero_copy_only=False)
    near = np.minimum(np.searchsorted(want, point), max(len(want) - 1, 0))
    met = held & (want[near] == point) if len(want) else held & False
    base, none = int(place[met].max(initial=0)) + 1, np.iinfo(np.int64).max
    best = np.full(len(want), none)
    np.minimum.at(best, near[met], np.repeat(rank.astype(np.int64), lengths)[met] * base + place[met])
    found = best[at]
    fresh, size = found == none, lengths[first]
    ends = np.r_[0, np.cumsum(size)].astype(np.int32)
    above = np.r_[0, np.cumsum(fresh)]
    nth = above[1:] - np.repeat(above[ends[:-1]], size) - 1
    lists = {"found": pa.array(found % base, mask=fresh), "nth": pa.array(nth.astype(np.int32))}
    made = [pa.ListArray.from_arrays(pa.array(ends), values) for values in lists.values()]
    made.append(pa.ListArray.from_arrays(pa.array(above[ends].astype(np.int32)), flat.filter(pa.array(own)).filter(pa.array(fresh))))
    kept = [c for c in rows.schema.names if c not in ("load_rank", "places", "home")]
    windows = rows.filter(pa.array(first))
    return pa.RecordBatch.from_arrays([*(windows[c] for c in kept), *made], names=[*kept, *lists, "news"])


def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``search`` of rows sorted by window and rank, ``SEARCHED`` windows at a time; no more is held than a batch and a window."""
    held: list[pa.RecordBatch] = []
    for rows in batches:
        starts = np.flatnonzero(rows["load_rank"].to_numpy() == 0).tolist()
        if starts and held:  # the window that began before ends here
            yield search(pa.concat_batches([*held, rows.slice(0, starts[0])]))
            held = []
        for a, b in zip(starts[:-1:SEARCHED], [*starts[SEARCHED:-1:SEARCHED], starts[-1]] if len(starts) > 1 else [], strict=True):
            yield search(rows.slice(a, b - a))
        if rows.num_rows:
            held.append(rows.slice(starts[-1] if starts else 0))
    if held:
        yield search(pa.concat_batches(held))


def find(blocks: DataFrame, loads: DataFrame | None, pieces: DataFrame | None) -> DataFrame:
    """``blocks`` with ``found``, ``nth`` and ``news`` (see ``search``): each window meets the pieces of its loads in one task."""
    if loads is None:
        n = F.size("ids")
        return blocks.withColumns({"found": F.array_repeat(F.lit(None).cast("long"), n), "nth": F.sequence(F.lit(0), n - 1), "news": F.col("ids")})
    workers_import_package(blocks.sparkSession)
    ranks, key = loads.where("load_rank > 0").select("trace", "seq", "kind", "subset_id", "load_rank"), ["subset_id", "kind", "trace"]
    met = pieces.drop("seq", "version").join(ranged(ranks), [*key, RANGED]) if RANGED in pieces.columns else pieces.drop("seq", "version").join(ranks, key)
    rows = blocks.withColumn("load_rank", F.lit(0)).unionByName(met.select("seq", "trace", "load_rank", "ids", "places", F.col("subset_id").alias("home")), allowMissingColumns=True)
    fields = [*blocks.schema.fields, t.StructField("found", t.ArrayType(t.LongType())), t.StructField("nth", t.ArrayType(t.IntegerType())), t.StructField("news", blocks.schema["ids"].dataType)]
    return rows.repartition("seq", "trace").sortWithinPartitions("seq", "trace", "load_rank").mapInArrow(searched, t.StructType(fields))


def run_epoch(windowed: DataFrame, state: State, cfg: Config, keep_loads: Callable[[DataFrame], DataFrame] = stored) -> Made:
    """Deduplicate one epoch, of a grid for all variants; its rows have ``is_dup, location, ord``. ``keep_loads`` writes the loads and returns what it wrote."""
    spent, firsts, columns = {}, None, windowed.columns
    pieces = (packed(state.members) if state.pieces is None else state.pieces) if state.counters else None
    by_window = cfg.flush and cfg.intra == "none" and not (cfg.kind == "hybrid" and cfg.segmenting_bits)
    if by_window:
        blocks = by_variant(stored(window_blocks(windowed), "blocks"), cfg)
        windows = blocks.select("trace", "version", "seq")
    else:
        windows = by_variant(windowed.select("trace", "version", "seq").distinct(), cfg)
    if state.counters:
        hits = hits_of(windowed, state.hooks, cfg)
        selected = choose(hits, state, pieces, cfg)
        if cfg.kind == "hybrid" and cfg.cap_adaptive:
            selected, spent = _cap(windows, hits, selected, state, cfg)
    else:  # nothing to search yet
        selected = windowed.sparkSession.createDataFrame([], S.SELECTED)
        if cfg.kind == "hybrid" and cfg.cap_adaptive:
            spent = {r[0]: (r[1], 0, 0) for r in windows.groupBy("trace").count().collect()}  # one row per trace
    loads = keep_loads(selected.join(windows, ["seq", "trace"]).select("trace", "seq", "kind", "subset_id", "load_rank", "version"))
    if by_window:
        made = stored(find(blocks, loads if state.counters else None, pieces), "found")
        numbered = stored(chunks_of(made, columns, cfg), "flagged")
        segs = F.floor(F.array_max("win_pos") / cfg.segment_size) + 1 if cfg.kind == "hybrid" else F.lit(1).cast("long")
        per = made.select("trace", "seq", F.size("news").cast("long").alias("new"), F.size("ids").cast("long").alias("all"), segs.alias("segs"))
    else:
        firsts, numbered = _by_chunks(by_variant(windowed, cfg), loads, state, pieces, cfg)
        sums = {"new": F.count_if(~F.col("is_dup") & ~F.col("again")), "all": F.count("*"), "segs": F.max("seg") + 1}
        per = numbered.groupBy("trace", "seq").agg(*[c.alias(n) for n, c in sums.items()])
    out, first, after = _placed(numbered, per, columns, state.counters, cfg, spent)
    if cfg.intra == "exact":
        home = out.where("not is_dup").groupBy("trace", "chunk_id").agg(F.min("location").alias("home"))
        out = out.join(home, ["chunk_id", "trace"], "left").withColumn("location", F.when(F.col("again"), F.col("home")).otherwise(F.col("location"))).drop("home")
        out = stored(out, "dedup_out")
    new = out.where("not is_dup").withColumn("container_id", F.col("location"))

    def member(rows: DataFrame, kind: str, col: str) -> DataFrame:
        return rows.select("trace", F.lit(kind).alias("kind"), F.col(col).cast("long").alias("subset_id"), "chunk_id", F.col("location").cast("long").alias("location"), F.col("seq").cast("long").alias("seq"), F.col("version").cast("int").alias("version"))

    def hook(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select("trace", "chunk_id", F.lit(kind).alias("kind"), F.lit(kind).alias("role"), F.col("subset_id").cast("long").alias("subset_id"), F.col("ord").cast("long").alias("ord"), F.col("version").cast("int").alias("version"))

    number = dict(windowed.dtypes)["chunk_id"] == "bigint"
    sampled = lambda at: cfg.each("ratio", lambda r: sampler(cfg.method, F.col("chunk_id"), F.col(at), r, number))
    if cfg.kind == "recipe":
        hooks = hook(build_hooks(out, sampled("gpos"), "recipe_id", "gpos"), "recipe")
    elif cfg.kind == "hybrid":
        id_hook = cfg.each("hook_bits", lambda bits: (is_hook_number if number else is_hook)(F.col("chunk_id"), *bits))
        varied = "feature_bits" if cfg.uniform else "ratio"
        feature = cfg.each(varied, lambda v: is_feature(F.col("chunk_id"), F.col("ord"), cfg.uniform, *(v if cfg.uniform else cfg.feature_bits), cfg.ratio if cfg.uniform else v, number))
        roles = build_hybrid_hooks(out, hook=id_hook, feature=feature)
        hooks = roles.select("trace", "chunk_id", F.when(F.col("role").startswith("recipe"), "recipe").otherwise("container").alias("kind"), "role", F.col("subset_id").cast("long").alias("subset_id"), F.lit(0).cast("long").alias("ord"), F.col("version").cast("int").alias("version"))
    else:
        hooks = hook(build_hooks(new, sampled("ord"), "container_id", "ord"), "container")
    if by_window:
        held = _pieces(made.join(first, ["seq", "trace"]), cfg)
    elif cfg.kind == "recipe":
        held = packed(member(out, "recipe", "recipe_id"))
    else:
        held = member(new, "container", "container_id")
        held = packed(held.unionByName(member(out, "recipe", "recipe_id")) if cfg.kind == "hybrid" else held)
    return Made(out.select(*columns, "is_dup", "location", "ord"), loads, held, hooks, after, firsts)


def chunks_of(made: DataFrame, columns: list[str], cfg: Config) -> DataFrame:
    """The chunks of windows that ``find`` has searched, a row for each, with their numbers among the window's new ones and among all."""
    whole = [c for c in ("seq", "trace", "version", "win") if c in columns]
    own = {c: f"{c}s__" for c in columns if c not in (*whole, "chunk_id")}
    rows = made.select(*whole, "found", "nth", *[F.col(c).alias(n) for c, n in own.items()], F.posexplode("ids").alias("at__", "chunk_id"))
    rows = rows.select(*whole, "chunk_id", *[F.get(n, F.col("at__")).alias(c) for c, n in own.items()], F.get("found", F.col("at__")).alias("location"), F.get("nth", F.col("at__")).cast("long").alias("nth__"), F.col("at__").cast("long").alias("at__"))
    seg = F.floor(F.col("win_pos") / cfg.segment_size) if cfg.kind == "hybrid" else F.lit(0).cast("long")
    return rows.select(*columns, F.col("location").isNotNull().alias("is_dup"), F.lit(False).alias("again"), "location", seg.alias("seg"), "nth__", "at__")


def _pieces(made: DataFrame, cfg: Config) -> DataFrame:
    """The pieces of new members from searched windows with what comes before them: containers take new chunks in turn; recipes take all, in turn or by segment."""
    size, n, out = cfg.container_size, F.size("news"), []

    def filled(rows: DataFrame, before: str, count: Column) -> DataFrame:
        """Subsets that a window's chunks fill, with where its part begins and ends among them."""
        rows = rows.where(count > 0).withColumn("own__", F.explode(F.sequence(F.floor(F.col(before) / size), F.floor((F.col(before) + count - 1) / size))))
        begin = F.greatest(F.col("own__") * size - F.col(before), F.lit(0).cast("long")).cast("int")
        return rows.withColumns({"begin__": begin, "end__": F.least((F.col("own__") + 1) * size - F.col(before), count.cast("long")).cast("int")})

    def piece(rows: DataFrame, kind: str, base: str, ids: str, places: Column) -> DataFrame:
        part = lambda a: F.slice(a, F.col("begin__") + 1, F.col("end__") - F.col("begin__"))
        return rows.select("trace", F.lit(kind).alias("kind"), (F.col("own__") + F.col(base)).cast("long").alias("subset_id"), part(ids).alias("ids"), (part("places") if kind == "recipe" else places).alias("places"), F.col("seq").cast("long").alias("seq"), F.col("version").cast("int").alias("version"))

    nowhere = F.lit(None).cast("array<bigint>")  # a container's members lie in it
    if cfg.kind != "recipe":
        out.append(piece(filled(made, "new__", n), "container", "container__", "news", nowhere))
    if cfg.kind != "container":
        home = lambda f, k: F.coalesce(f, F.floor((F.col("new__") + k) / size) + F.col("container__"))
        placed = made.withColumn("places", F.zip_with("found", "nth", home))
        if cfg.kind == "recipe":
            rows = filled(placed, "all__", F.size("ids"))
        else:
            last = F.floor(F.array_max("win_pos") / cfg.segment_size)
            rows = placed.withColumn("own__", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            above = lambda s: F.size(F.filter("win_pos", lambda p: p < s * cfg.segment_size))
            rows = rows.withColumns({"begin__": above(F.col("own__")), "end__": above(F.col("own__") + 1)}).where("begin__ < end__").withColumn("own__", F.col("own__") + F.col("segs__"))
        out.append(piece(rows, "recipe", "recipe__", "ids", nowhere))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def _by_chunks(windowed: DataFrame, loads: DataFrame, state: State, pieces: DataFrame | None, cfg: Config) -> tuple[DataFrame | None, DataFrame]:
    """What ``find`` gives, chunk by chunk, where nothing is flushed, where repeats are found inside an epoch, and for segments by content."""
    firsts = None
    if not cfg.flush:
        firsts = state.firsts if pieces is None else stored(first_loads(loads.drop("version"), pieces, state.firsts), "firsts")
        since = (state.firsts.unionByName(firsts) if pieces is not None else firsts).select("trace", "chunk_id", F.col("seq").alias("since"), "location")
        flagged = windowed.join(since, ["chunk_id", "trace"], "left").withColumn("location", F.when(F.col("since") <= F.col("seq"), F.col("location"))).drop("since")
        flagged = flagged.withColumn("is_dup", F.col("location").isNotNull())
    elif pieces is not None:
        flagged = dedup_against(windowed, loaded(loads, unpacked(pieces)))
    else:
        flagged = windowed.withColumns({"location": F.lit(None).cast("long"), "is_dup": F.lit(False)})
    if cfg.intra == "exact":
        flagged = stored(flagged, "found")
        new = flagged.where(~F.col("is_dup")).groupBy("trace", "chunk_id").agg(F.min(F.struct("seq", "win_pos")).alias("f"))
        flagged = flagged.join(new, ["chunk_id", "trace"], "left").withColumn("again", F.coalesce(~F.col("is_dup") & (F.struct("seq", "win_pos") > F.col("f")), F.lit(False))).drop("f")
    else:
        flagged = flagged.withColumn("again", F.lit(False))
    if cfg.kind == "hybrid":
        flagged = segment_content(flagged, cfg.segmenting_bits) if cfg.segmenting_bits else segment_fixed(flagged, cfg.segment_size)
    else:
        flagged = flagged.withColumn("seg", F.lit(0).cast("long"))
    inside = Window.partitionBy("seq", "trace").orderBy("win_pos").rowsBetween(Window.unboundedPreceding, 0)
    fresh = ~F.col("is_dup") & ~F.col("again")
    numbered = flagged.withColumns({"nth__": F.sum(fresh.cast("long")).over(inside) - 1, "at__": F.count("*").over(inside) - 1})
    return firsts, stored(numbered.select(*windowed.columns, "is_dup", "again", "location", "seg", "nth__", "at__"), "flagged")


def _placed(numbered: DataFrame, per: DataFrame, columns: list[str], before: dict[str, Counters], cfg: Config, spent: dict[str, tuple]) -> tuple[DataFrame, DataFrame, dict[str, Counters]]:
    """Rows of an epoch with the containers of what is stored and the recipes of all, what comes before each window, and the counters after the epoch.

    Rows are ``numbered`` inside their windows; what comes before a window is a sum over windows, of their numbers ``per`` window.
    So what reads the rows adds the sums of their windows.
    """
    fresh, sums = ~F.col("is_dup") & ~F.col("again"), ["new", "all", "segs"]
    per = stored(per, "per_window")
    totals = per.groupBy("trace").agg(*[F.sum(n).alias(n) for n in sums]).collect()  # one row per trace
    first = per
    for n in ("new", *(["all"] if cfg.kind == "recipe" else ["segs"] if cfg.kind == "hybrid" else [])):
        first = sums_before(first, ["trace"], ["seq"], n, f"{n}__")
    first = stored(_counted(first.drop(*sums), before, "container", "ord", "recipe", "ingest"), "first")  # a row per window, which Spark sends if it is small
    k = F.col("new__") + F.col("nth__")
    placed = numbered.join(first, ["seq", "trace"])
    more = {"location": F.when(fresh, F.floor(k / cfg.container_size) + F.col("container__")).otherwise(F.col("location")), "ord": F.when(fresh, k + F.col("ord__"))}
    if cfg.kind == "recipe":
        g = F.col("all__") + F.col("at__")
        more |= {"recipe_id": F.floor(g / cfg.container_size) + F.col("recipe__"), "gpos": g + F.col("ingest__")}
    elif cfg.kind == "hybrid":
        more["recipe_id"] = F.col("segs__") + F.col("seg") + F.col("recipe__")
    placed = placed.withColumns(more).withColumn("is_dup", F.col("is_dup") | F.col("again"))
    after = dict(before)
    for r in totals:
        c = after.get(r.trace, Counters())
        recipes = -(-r["all"] // cfg.container_size) if cfg.kind == "recipe" else r.segs if cfg.kind == "hybrid" else 0
        windows, loads, candidates = spent.get(r.trace, (0, 0, 0))
        after[r.trace] = Counters(c.container - (-r.new // cfg.container_size), c.recipe + recipes, c.ord + r.new, c.ingest + r["all"], c.windows + windows, c.loads + loads, c.candidates + candidates)
    return placed.select(*columns, "is_dup", "again", "location", *[n for n in more if n != "location"]), first, after


ROWS = "trace string, version int, pos long, chunk_id string, win long, win_pos int, seq long, is_dup boolean, location long, ord long"


def by_variant(rows: DataFrame, cfg: Config) -> DataFrame:
    """``rows`` once for each variant of the grid, the trace named after it."""
    for v in cfg.grid:
        if other := set(v) - set(VARIED):
            raise ValueError(f"a grid cannot vary {sorted(other)}")
    if not cfg.grid:
        return rows
    numbered = rows.withColumn("variant__", F.explode(F.array(*[F.lit(str(i)) for i in range(len(cfg.grid))])))
    return numbered.withColumn("trace", F.concat_ws("|", "variant__", "trace")).drop("variant__")


def near_exact_dedup(chunks: DataFrame, cfg: Config, epoch: str | int = "version") -> tuple[DataFrame, DataFrame, State]:
    """All epochs of ``chunks (trace, version, pos, chunk_id)``; returns rows, loads and the final state.

    ``epoch``: ``version``, ``window``, or a number of windows (which then runs over ``seq``, across versions). With a grid
    each trace runs once for each variant, as ``<number>|<trace>``.
    """
    spark = chunks.sparkSession
    windowed = stored(assign_windows(chunks, cfg.window_size), "windowed", *["version"] * (epoch == "version"))  # an epoch reads its own version's folder
    key = F.col("version") if epoch == "version" else F.floor((F.col("seq") - 1) / (1 if epoch == "window" else int(epoch)))
    pieces, hooks, loads, rows, firsts = (Growing(spark, of_ids(s, chunks), by_range=s == PIECES) for s in (PIECES, HOOKS, LOADS, ROWS, FIRSTS))
    state = empty_state(chunks)
    for (number,) in sorted(tuple(r) for r in windowed.select(key.alias("e")).distinct().collect()):  # one row per epoch
        made = run_epoch(windowed.where(key == number), state, cfg, lambda df, n=number: loads.add(df, n))
        parts = [(pieces, made.pieces), (hooks, made.hooks), (rows, made.rows.withColumn("location", F.col("location").cast("long")))]
        if made.firsts is not None:
            parts.append((firsts, made.firsts))
        with ThreadPoolExecutor(len(parts)) as pool:  # writes that do not wait for one another
            list(pool.map(lambda p, n=number: p[0].add(p[1], n), parts))
        state = State(unpacked(pieces.read()), hooks.read(), firsts.read(), made.counters, pieces.read())
    return rows.read(), loads.read(), state

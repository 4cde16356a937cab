"""Near-exact deduplication with strict sealing: the order of one window after another, found as a fixed point.

A container stays open until one more chunk is stored, and is searched by the windows after that one; it goes on across
windows and versions. So each window depends on all earlier ones. A run that walks the windows would take as many steps;
here the versions are taken in turn, and all windows of a version at once. What earlier versions sealed is settled: it is
searched and packed once. The flags that this gives are a first guess; the version's own containers are packed from it, and
only windows that hit a hook sealed inside the version are searched again, until no flag changes. A window depends on the flags
before it, so a round settles at least one more window, and the run has only one fixed point, the walk's result. Where ids of
a version do not come back inside it, no window is searched twice.

As in runs by epochs, members lie in pieces, a window meets the pieces of its loads in one task, and the chunks of a trace meet the
hooks of all variants of a grid once.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.ids import sampler
from fathomline.functions.storage import Growing, ranged, stored
from fathomline.operators.exact import seal_status
from fathomline.operators.index import build_hooks
from fathomline.operators.near_exact import HOOKS, LOADS, PIECES, ROWS, Config, by_variant, chunks_of, find, hits_of, of_ids, packed, piece_meta, select_from, window_blocks
from fathomline.operators.ordinals import assign_windows, sums_before
from fathomline.operators.select import window_ids

WINDOW = ["seq", "trace"]
PACKED = ["trace", "version", "seq", "chunk_id", "ord", "container_id"]


def _flagged(made: DataFrame, columns: list[str], cfg: Config) -> DataFrame:
    """The chunks of searched windows with ``is_dup``, ``location`` and ``nth``, the number of stored chunks before a stored one in its window."""
    return chunks_of(made, columns, cfg).select(*columns, "is_dup", "location", F.col("nth__").alias("nth"))


def _placed(flagged: DataFrame, before: dict[str, int], cfg: Config) -> DataFrame:
    """Rows of ``_flagged`` with ``ord`` and ``location`` of what is stored; ``before``: by trace, the chunks that earlier versions stored."""
    per = stored(flagged.groupBy(*WINDOW).agg(F.count_if(~F.col("is_dup")).alias("new")), "per_window")
    base = F.broadcast(per.sparkSession.createDataFrame(list(before.items()), "trace string, base long"))  # one row per trace
    first = sums_before(per, ["trace"], ["seq"], "new", "above").join(base, "trace", "left")
    first = stored(first.select("trace", "seq", (F.col("above") + F.coalesce("base", F.lit(0))).alias("first")), "first")  # one row per window
    k = F.col("first") + F.col("nth")
    placed = flagged.join(first, WINDOW).withColumn("ord", F.when(~F.col("is_dup"), k))
    return placed.withColumn("location", F.when(F.col("is_dup"), F.col("location")).otherwise(F.floor(k / cfg.container_size))).drop("first", "nth")


def _hooks(searchable: DataFrame, cfg: Config) -> DataFrame:
    number = dict(searchable.dtypes)["chunk_id"] == "bigint"
    sampled = cfg.each("ratio", lambda r: sampler(cfg.method, F.col("chunk_id"), F.col("ord"), r, number))
    return build_hooks(searchable, sampled, "container_id", "ord").withColumn("role", F.col("kind"))


def _pieces(searchable: DataFrame) -> DataFrame:
    home = F.col("container_id")
    rows = searchable.select("trace", F.lit("container").alias("kind"), home.alias("subset_id"), "chunk_id", home.alias("location"), F.col("seq").cast("long").alias("seq"), F.col("version").cast("int").alias("version"))
    return packed(rows).withColumn("places", F.lit(None).cast("array<bigint>"))  # a container's members lie in it


def _selected(hits: DataFrame, hooks: DataFrame, pieces: DataFrame, cfg: Config) -> DataFrame:
    """The loads of windows; ``hooks`` have ``since``, the window that sealed their container."""
    pairs = hits.join(hooks.select("trace", "chunk_id", "kind", "subset_id", "ord", "since"), ["chunk_id", "trace"]).where("since < seq").drop("since")

    def made(candidates: DataFrame) -> DataFrame:
        return piece_meta(pieces, candidates)

    return select_from(pairs, made, cfg)


def _version(own: DataFrame, tail: DataFrame | None, before: dict[str, int], members: Growing, hooks: Growing, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The fixed point of one version: its rows, its loads, the chunks and the hooks of containers that it sealed, and the chunks of those still open."""
    settled = hooks.read().withColumn("since", F.lit(0).cast("long"))  # before every window of this version
    blocks = by_variant(stored(window_blocks(own), "blocks"), cfg)
    if hooks.empty:
        loads = own.sparkSession.createDataFrame([], LOADS).drop("version")
        made = find(blocks, None, None)
    else:
        loads = stored(_selected(hits_of(own, settled, cfg), settled, members.read(), cfg), "loads")
        made = find(blocks, loads, members.read())
    flagged, again = stored(_flagged(made, own.columns, cfg), "flagged"), None
    ids = own.select("chunk_id", "seq", F.col("trace").alias("of"))
    while True:
        rows = _placed(flagged, before, cfg)
        new = rows.where(~F.col("is_dup")).select(*PACKED[:-1], F.col("location").alias("container_id"))
        new = stored(new if tail is None else new.unionByName(tail), "packed")
        since = stored(seal_status(new).withColumnRenamed("sealed_seq", "since"), "since")  # one row per container
        sealed = new.join(since.where("since is not null"), ["container_id", "trace"])
        fresh = stored(_hooks(sealed, cfg).join(since.withColumnRenamed("container_id", "subset_id"), ["subset_id", "trace"]), "fresh_hooks")
        of = F.split("trace", r"\|", 2)[1] if cfg.grid else F.col("trace")  # chunks meet the hooks of all variants
        hit = ids.join(fresh.select("chunk_id", of.alias("of"), "trace", "since"), ["chunk_id", "of"]).where("since < seq").select(*WINDOW)
        again = stored((hit if again is None else hit.unionByName(again)).distinct(), "again")  # windows that this version's hooks do or did concern
        if again.isEmpty():
            break
        known = members.read().unionByName(ranged(_pieces(sealed)))
        searched = flagged.join(again, WINDOW, "left_semi")
        now = stored(_selected(window_ids(searched), settled.unionByName(fresh.select(settled.columns)), known, cfg), "loads")
        found = stored(_flagged(find(blocks.join(again, WINDOW, "left_semi"), now, known), own.columns, cfg), "found")
        was = searched.select(*WINDOW, "win_pos", F.col("is_dup").alias("was"))
        loads = stored(loads.join(again, WINDOW, "left_anti").unionByName(now), "loads")
        flagged = stored(flagged.join(again, WINDOW, "left_anti").unionByName(found), "flagged")
        if found.join(was, ["win_pos", *WINDOW]).where("was <> is_dup").isEmpty():
            rows = _placed(flagged, before, cfg)  # the same places, with the locations of this round
            break
    open_ = new.join(since.where("since is null"), ["container_id", "trace"], "left_semi").select(PACKED)
    return rows, loads, sealed, fresh.select(settled.columns).drop("since"), open_


def strict_dedup(chunks: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, loads and hooks of a run over ``chunks (trace, version, pos, chunk_id)`` in which each window sees all that was sealed before it.

    Containers only, for every policy, and for the variants of a grid at once. Repeats of a new id inside a window are all new, as in
    runs by epochs. An id that is null is never found. An empty trace gives no rows.
    """
    if cfg.kind != "container" or not cfg.flush or cfg.intra != "none":
        raise ValueError("strict sealing is of containers, with flushed loads")
    spark = chunks.sparkSession
    windowed = stored(assign_windows(chunks, cfg.window_size), "windowed", "version")
    members, hooks, loads, rows = (Growing(spark, of_ids(s, chunks), by_range=s == PIECES) for s in (PIECES, HOOKS, LOADS, ROWS))
    tail, before = None, {}  # chunks of the open container, less than one for each trace; and by trace, how many chunks are stored
    for (v,) in sorted(tuple(r) for r in windowed.select("version").distinct().collect()):  # one row per version
        made, chosen, sealed, fresh, open_ = _version(windowed.where(F.col("version") == v), tail, before, members, hooks, cfg)
        parts = [(rows, made.withColumn("location", F.col("location").cast("long"))), (loads, chosen.withColumn("version", F.lit(v).cast("int"))), (members, _pieces(sealed)), (hooks, fresh)]
        with ThreadPoolExecutor(len(parts)) as pool:  # writes that do not wait for one another
            own = list(pool.map(lambda p, n=v: p[0].add(p[1], n), parts))[0]
        tail = stored(open_, "tail")
        before |= {r[0]: r[1] + 1 for r in own.groupBy("trace").agg(F.max("ord")).collect() if r[1] is not None}  # one row per trace
    return rows.read(), loads.read(), hooks.read()

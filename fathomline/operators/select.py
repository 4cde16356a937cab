"""Candidate subsets of a window and the policies that choose which to load.

Ties, which the semantics leave open, go to the smaller subset id. The greedy and clustering policies see one window's hits
at a time, each with the subsets it points to; everything else is joins, aggregates and window functions. Where a hook
points to very many subsets, ``leading_pairs`` leaves those that ``sort`` and ``sparse`` can choose, so that a window has at most
``HEAVY`` rows a hit beside them.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.storage import stored
from fathomline.functions.workers import workers_import_package
from fathomline.operators.ordinals import SPAN, sums_before

#: A hook that points to more subsets is heavy.
HEAVY = 64
SELECTED = "trace string, seq long, kind string, subset_id long, load_rank int"


def window_ids(windowed: DataFrame, *more: str) -> DataFrame:
    """``trace, seq, chunk_id, cnt, first_pos``: the ids of each window, with their multiplicity; ``more`` columns that a window has one value of."""
    return windowed.groupBy("trace", "seq", *more, "chunk_id").agg(F.count("*").alias("cnt"), F.min("win_pos").alias("first_pos"))


def hook_hits(windowed: DataFrame, hooks: DataFrame, *more: str) -> DataFrame:
    """``trace, seq, chunk_id, cnt, first_pos`` and ``more``: indexed ids of each window, with their multiplicity. Rows without a hook go before any are grouped."""
    return window_ids(windowed.join(hooks.select("trace", "chunk_id"), ["chunk_id", "trace"], "left_semi"), *more)


def hook_pairs(hits: DataFrame, hooks: DataFrame) -> DataFrame:
    """``trace, seq, chunk_id, cnt, first_pos, kind, subset_id, ord``: each hit with the subsets it points to."""
    return hits.join(hooks.select("trace", "chunk_id", "kind", "subset_id", "ord"), ["chunk_id", "trace"])


def leading_pairs(hits: DataFrame, hooks: DataFrame, most: int, heavy: int = HEAVY) -> DataFrame:
    """The pairs of ``hook_pairs`` without subsets that neither ``select_sort`` nor ``select_sparse`` can choose under a cap of ``most``.

    Subsets that a window meets by heavy hooks only, and by the same ones, count alike for it whatever the hits weigh, and the smaller id goes
    first: of each such group the ``most`` smallest ids lead. Groups depend on the set of heavy hooks alone, so they are found once for all
    windows that hit the same set, and a hook in every window costs its subsets once, not once a window. Subsets met by other hooks all stay.
    """
    key, subset = ["chunk_id", "trace"], ["kind", "subset_id"]
    counts = stored(hooks.groupBy(*key).agg(F.count("*").alias("points")).where(F.col("points") > heavy).select(*key), "heavy_hooks")
    if counts.isEmpty():
        return hook_pairs(hits, hooks)
    light = stored(hook_pairs(hits.join(counts, key, "left_anti"), hooks), "light_pairs")
    hot = stored(hits.join(counts, key, "left_semi"), "heavy_hits")
    posts = stored(hooks.join(counts, key, "left_semi").select(*key, *subset, "ord"), "heavy_posts")
    sets = stored(hot.groupBy("trace", "seq").agg(F.sort_array(F.collect_set("chunk_id")).alias("met")).withColumn("met_key", F.sha2(F.array_join("met", ","), 256)), "heavy_sets")  # at most a window's ids
    once = sets.groupBy("trace", "met_key").agg(F.first("met").alias("met")).select("trace", "met_key", F.explode("met").alias("chunk_id"))
    groups = once.join(posts.select(*key, *subset), key).groupBy("trace", "met_key", *subset).agg(F.sha2(F.array_join(F.sort_array(F.collect_set("chunk_id")), ","), 256).alias("by"))
    rank = F.row_number().over(Window.partitionBy("trace", "met_key", "kind", "by").orderBy("subset_id"))
    leaders = groups.withColumn("nth", rank).where(F.col("nth") <= max(most, 1)).select("trace", "met_key", *subset)
    lead = sets.select("trace", "seq", "met_key").join(leaders, ["trace", "met_key"]).select("trace", "seq", *subset)
    chosen = lead.union(light.select("trace", "seq", *subset)).distinct()
    both = hot.join(chosen, ["seq", "trace"]).join(posts, [*key, *subset])
    return light.unionByName(both.select(light.columns))


def candidate_scores(pairs: DataFrame) -> DataFrame:
    """``trace, seq, kind, subset_id, score, n_hooks, first``: hits with multiplicity, distinct hooks, and where the subset was first met."""
    return pairs.groupBy("seq", "subset_id", "kind", "trace").agg(
        F.sum("cnt").alias("score"), F.countDistinct("chunk_id").alias("n_hooks"), F.min(F.struct("first_pos", "ord")).alias("first"))


def apply_io_cap(selected: DataFrame, io_cap: int | Column) -> DataFrame:
    """The first ``io_cap`` loads of each window; at least one. A column is a cap for each row."""
    return selected.where(F.col("load_rank") <= F.greatest(io_cap if isinstance(io_cap, Column) else F.lit(io_cap), F.lit(1)))


def _ranked(candidates: DataFrame, *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("seq", "trace").orderBy(*order))
    return candidates.withColumn("load_rank", rank.cast("int"))


def select_sort(candidates: DataFrame, io_cap: int | Column) -> DataFrame:
    """Most hits first."""
    ranked = _ranked(candidates, F.desc("score"), "subset_id", "kind")
    return apply_io_cap(ranked, io_cap).select("trace", "seq", "kind", "subset_id", "load_rank")


def select_fifo(candidates: DataFrame, io_cap: int | Column) -> DataFrame:
    """The first subsets met while walking the hits; loaded in ascending id."""
    chosen = apply_io_cap(_ranked(candidates, "first", "subset_id", "kind"), io_cap)
    return _ranked(chosen.drop("load_rank"), "subset_id", "kind").select("trace", "seq", "kind", "subset_id", "load_rank")


def select_all(candidates: DataFrame) -> DataFrame:
    """Every candidate, by id."""
    return _ranked(candidates, "subset_id", "kind").select("trace", "seq", "kind", "subset_id", "load_rank")


def greedy_cover(hook: np.ndarray, subset: np.ndarray, limit: int, weight: dict | None = None) -> list:
    """Subsets in the order in which each adds the most uncovered hooks (over ``weight``, if given); stops when none adds any."""
    h, _ = pd.factorize(hook)  # hooks are only told apart
    names, s = np.unique(subset, return_inverse=True)
    pairs = np.unique(np.stack([h, s], axis=1), axis=0)
    size = np.array([float(weight[n]) for n in names.tolist()]) if weight else np.ones(len(names))
    covered, out = np.zeros(h.max() + 1 if len(h) else 0, dtype=bool), []
    while len(out) < limit:
        gain = np.bincount(pairs[~covered[pairs[:, 0]], 1], minlength=len(names)) / size
        if not len(gain) or gain.max() == 0:
            break
        best = int(gain.argmax())  # the first of equals has the smallest id
        out.append(names[best].item())
        covered[pairs[pairs[:, 1] == best, 0]] = True
    return out


def select_sparse(pairs: DataFrame, io_cap: int | Column, most: int | None = None) -> DataFrame:
    """Greedy cover of a window's distinct hooks; for a cap that differs by row, ``most`` is the largest. A cap only cuts the same order."""
    limit = max(io_cap if most is None else most, 1)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        kinds = rows.drop_duplicates(["w", "subset_id"])[["w", "subset_id", "kind"]]
        return _covering(rows, limit).merge(kinds, how="left", on=["w", "subset_id"])

    return apply_io_cap(_by_windows(pairs.select("trace", "seq", "chunk_id", "kind", "subset_id"), pick), io_cap)


def level_clusters(candidates: list[tuple[int, int, int]], reach: float) -> list[int]:
    """Subsets of the best level. ``candidates``: id, score, sequence number, in scan order; clusters are first-fit around their first member."""
    clusters: list[tuple[int, list[int], int]] = []
    for subset, score, seq in candidates:
        for k, (center, members, total) in enumerate(clusters):
            if abs(seq - center) <= reach:
                clusters[k] = center, [*members, subset], total + score
                break
        else:
            clusters.append((seq, [subset], score))
    return max(clusters, key=lambda c: c[2])[1] if clusters else []  # the first of equals


def select_level(candidates: DataFrame, meta: DataFrame, io_cap: int | Column, window_size: int, container_size: int, most: int | None = None) -> DataFrame:
    """The cluster of candidates made at about the same time that has the most hits."""
    reach, limit = 2 * window_size / container_size, max(io_cap if most is None else most, 1)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["w", "score", "subset_id"], ascending=[True, False, True], kind="stable")
        cut, out = np.r_[np.flatnonzero(np.r_[True, np.diff(rows["w"].to_numpy()) != 0]), len(rows)], []
        w, kind, ids, score, made = (rows[c].tolist() for c in ("w", "kind", "subset_id", "score", "made"))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):  # a window's candidates
            kinds = dict(zip(ids[a:b], kind[a:b], strict=True))
            out += [(w[a], kinds[i], i) for i in level_clusters(list(zip(ids[a:b], score[a:b], made[a:b], strict=True)), reach)[:limit]]
        return pd.DataFrame(out, columns=["w", "kind", "subset_id"])

    timed = candidates.join(meta.select("trace", "kind", "subset_id", F.col("seq").alias("made")), ["subset_id", "kind", "trace"])
    return apply_io_cap(_by_windows(timed.select("trace", "seq", "kind", "subset_id", "score", "made"), pick), io_cap)


def hybrid_recipe_limit(io_cap: int, ratio: float) -> int:
    return math.ceil(io_cap * ratio) if 0 <= ratio <= 1 else io_cap


def select_hybrid(role_pairs: DataFrame, io_cap: int, ratio: float = 2.3, overlap: float = 0.6, limits: Column | None = None, most: int = 0) -> DataFrame:
    """Recipes by greedy cover of ``recipe_hook``; then containers by ``cnr_ptr`` hits, without those that the recipes' hooks overlap.

    ``role_pairs``: ``trace, seq, chunk_id, role, subset_id`` of the distinct hit ids of each window. A container is
    left out if more than ``floor(overlap * its hit cnr_hooks)`` of these are hooks of the chosen recipes. ``limits``: recipes
    by row, at most ``most``, in place of those of the cap and ratio.
    """
    limits, most = (F.lit(hybrid_recipe_limit(io_cap, ratio)), hybrid_recipe_limit(io_cap, ratio)) if limits is None else (limits, most)
    roles = ("recipe_hook", "cnr_hook", "cnr_ptr")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        role, w, subset, cut = (rows[c].to_numpy() for c in ("role", "w", "subset_id", "most"))
        (chunk, _), (home, names) = pd.factorize(rows["chunk_id"].to_numpy()), pd.factorize(subset, sort=True)  # homes rise with the ids
        point, owner = w * (chunk.max() + 1) + chunk, w * len(names) + home  # a window's chunk, a window's subset
        hooks, held, left = role == 1, role == 2, role == 3
        place = greedy_covers(w[hooks], chunk[hooks], subset[hooks], most)
        place[place > cut[hooks]] = 0
        covered = np.unique(point[hooks][place > 0])
        recipes = pd.DataFrame({"w": w[hooks], "subset_id": subset[hooks], "place": place})[place > 0].drop_duplicates().sort_values(["w", "place"])
        met = pd.DataFrame({"owner": owner[held], "point": point[held]}).drop_duplicates()
        met = met.assign(covered=np.isin(met["point"].to_numpy(), covered)).groupby("owner")["covered"].agg(["size", "sum"])
        gone = met.index[met["sum"] > np.floor(overlap * met["size"])].to_numpy()
        to = pd.DataFrame({"owner": owner[left], "point": point[left]}).drop_duplicates()
        to = to[~np.isin(to["owner"].to_numpy(), gone)].groupby("owner").size().reset_index(name="score")
        to = to.assign(w=to["owner"] // len(names), subset_id=names[to["owner"] % len(names)]).sort_values(["w", "score", "owner"], ascending=[True, False, True])
        return _in_turn(recipes[["w", "subset_id"]], to[["w", "subset_id"]])

    return _by_windows(role_pairs.where(F.col("role").isin(*roles)).select("trace", "seq", "chunk_id", _role_codes(*roles), "subset_id", limits.cast("int").alias("most")), pick)


def greedy_covers(window: np.ndarray, hook: np.ndarray, subset: np.ndarray, limit: int, size: np.ndarray | None = None) -> np.ndarray:
    """``greedy_cover`` of many windows at once: for each pair, the place of its subset in its window's cover from 1, or 0 if it is not chosen.

    ``size``: the weight of each pair's subset. A round picks one subset in every window that still gains by one.
    """
    if not len(window):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((subset, window))
    w, s = window[order], subset[order]
    fresh = np.r_[True, (w[1:] != w[:-1]) | (s[1:] != s[:-1])]
    node = np.empty(len(w), dtype=np.int64)
    node[order] = np.cumsum(fresh) - 1  # subsets of a window side by side, the smallest id first
    own, weight = w[fresh], np.ones(int(fresh.sum())) if size is None else size[order][fresh].astype(float)
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    runs = np.diff(np.r_[starts, len(own)])
    h, _ = pd.factorize(hook)  # hooks are only told apart
    _, point = np.unique(window.astype(np.int64) * (h.max() + 1) + h, return_inverse=True)
    pairs = np.unique(node * (point.max() + 1) + point)
    at, of = np.divmod(pairs, point.max() + 1)
    covered, place = np.zeros(point.max() + 1, dtype=bool), np.zeros(len(own), dtype=np.int64)
    for nth in range(1, limit + 1):
        gain = np.bincount(at[~covered[of]], minlength=len(own)) / weight
        best = np.flatnonzero((gain == np.repeat(np.maximum.reduceat(gain, starts), runs)) & (gain > 0))
        if not len(best):
            break
        place[best[np.r_[True, own[best[1:]] != own[best[:-1]]]]] = nth  # the first of equals has the smallest id
        covered[of[place[at] == nth]] = True
    return place[node]


def whole_windows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``seq, trace`` in batches that end where a window ends; no more is held than a batch and a window."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        last = (rows["seq"] == rows["seq"].iat[-1]) & (rows["trace"] == rows["trace"].iat[-1])
        cut = int(last.to_numpy().argmax())
        ends = held and not cut and (held[-1]["seq"].iat[-1], held[-1]["trace"].iat[-1]) != (rows["seq"].iat[0], rows["trace"].iat[0])
        if cut or ends:
            yield pd.concat([*held, rows.iloc[:cut]], ignore_index=True)
            held = []
        held.append(rows.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _by_windows(pairs: DataFrame, pick: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``SELECTED`` rows of whole windows: ``pick`` gets pairs with their window's number ``w`` and gives ``w, kind, subset_id`` in order of load."""
    workers_import_package(pairs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_windows(batches):
            first = np.r_[True, (rows["seq"].to_numpy()[1:] != rows["seq"].to_numpy()[:-1]) | (rows["trace"].to_numpy()[1:] != rows["trace"].to_numpy()[:-1])]
            out = pick(rows.assign(w=np.cumsum(first) - 1))
            key = rows.loc[first, ["trace", "seq"]].reset_index(drop=True).loc[out["w"]].reset_index(drop=True)
            out = out.reset_index(drop=True)
            yield pd.DataFrame({"trace": key["trace"], "seq": key["seq"], "kind": out["kind"], "subset_id": out["subset_id"].astype("int64"), "load_rank": (out.groupby("w").cumcount() + 1).astype("int32")})

    return pairs.repartition("seq", "trace").sortWithinPartitions("seq", "trace").mapInPandas(run, SELECTED)


def _covering(rows: pd.DataFrame, limit: int, size: str | None = None) -> pd.DataFrame:
    """The subsets of each window's greedy cover, in order: ``w, subset_id``."""
    place = greedy_covers(rows["w"].to_numpy(), rows["chunk_id"].to_numpy(), rows["subset_id"].to_numpy(), limit, rows[size].to_numpy() if size else None)
    chosen = rows[["w", "subset_id"]].assign(place=place)[place > 0].drop_duplicates()
    return chosen.sort_values(["w", "place"])[["w", "subset_id"]]


def _among(rows: pd.DataFrame, others: pd.DataFrame, by: list[str]) -> np.ndarray:
    return pd.MultiIndex.from_frame(rows[by]).isin(pd.MultiIndex.from_frame(others[by]))


def _in_turn(recipes: pd.DataFrame, containers: pd.DataFrame) -> pd.DataFrame:
    """Each window's recipes, then its containers."""
    return pd.concat([recipes.assign(kind="recipe"), containers.assign(kind="container")], ignore_index=True).sort_values("w", kind="stable")


def _role_codes(*roles: str) -> Column:
    """The place of ``role`` among ``roles``; numbers reach Python cheaper than names."""
    return F.array_position(F.array(*map(F.lit, roles)), F.col("role")).cast("int").alias("role")


def select_hybrid_basic(role_pairs: DataFrame, n_recipes: int = 6) -> DataFrame:
    """Recipes by greedy cover; containers by the hits that the chosen recipes' ``recipe_ptr`` hooks leave."""
    limit, roles = max(n_recipes, 1), ("recipe_hook", "recipe_ptr", "cnr_ptr")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        recipes = _covering(rows[rows["role"] == 1], limit)
        pointers, left = rows[rows["role"] == 2], rows[rows["role"] == 3]
        left = left[~_among(left, pointers[_among(pointers, recipes, ["w", "subset_id"])], ["w", "chunk_id"])]
        scores = left.groupby(["w", "subset_id"], as_index=False)["chunk_id"].nunique().sort_values(["w", "chunk_id", "subset_id"], ascending=[True, False, True])
        return _in_turn(recipes, scores[["w", "subset_id"]])

    return _by_windows(role_pairs.where(F.col("role").isin(*roles)).select("trace", "seq", "chunk_id", _role_codes(*roles), "subset_id"), pick)


def select_hybrid_dense(role_pairs: DataFrame, meta: DataFrame, io_cap: int, n_recipes: int = 5) -> DataFrame:
    """Greedy by density (uncovered hooks over chunks of the subset): recipes first, then containers for what is left."""
    limit, roles = max(io_cap, 1), ("recipe_hook", "cnr_ptr")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(chunk_num=rows["chunk_num"].fillna(1))
        hooks, left = rows[rows["role"] == 1], rows[rows["role"] == 2]
        recipes = _covering(hooks, n_recipes, "chunk_num")
        left = left[~_among(left, hooks[_among(hooks, recipes, ["w", "subset_id"])], ["w", "chunk_id"])]
        return _in_turn(recipes, _covering(left, limit, "chunk_num"))

    kind = F.when(F.col("role") == "recipe_hook", "recipe").otherwise("container")
    sized = role_pairs.where(F.col("role").isin(*roles)).withColumn("kind", kind).join(meta.select("trace", "kind", "subset_id", "chunk_num"), ["subset_id", "kind", "trace"], "left")
    return apply_io_cap(_by_windows(sized.select("trace", "seq", "chunk_id", _role_codes(*roles), "subset_id", "chunk_num"), pick), io_cap)


Pieces = list[tuple[float, int, int]]


def credit_step(pieces: Pieces, cap: int, low: int, high: int) -> Pieces:
    """The credit after one more window, as a function of the credit at a block's begin.

    ``pieces``: from where, slope (0 or 1) and offset. The window adds ``cap`` and spends what there is between ``low`` and ``high``.
    """
    out: Pieces = []

    def add(begin: float, slope: int, offset: int) -> None:
        if not out or out[-1][1:] != (slope, offset):
            out.append((begin, slope, offset))

    for k, (begin, slope, offset) in enumerate(pieces):
        end = pieces[k + 1][0] if k + 1 < len(pieces) else math.inf
        if not slope:
            add(begin, 0, offset + cap - min(max(offset, low), high))
            continue
        for at, until, kind, change in ((-math.inf, low - offset, 1, offset + cap - low), (low - offset, high - offset, 0, cap), (high - offset, math.inf, 1, offset + cap - high)):
            if max(begin, at) < min(end, until):
                add(max(begin, at), kind, change)
    return out


def credit_at(pieces: Pieces, credit: int) -> int:
    """What ``pieces`` make of a credit."""
    _, slope, offset = pieces[max(bisect.bisect_right(pieces, credit, key=lambda p: p[0]) - 1, 0)]
    return slope * credit + offset


def adaptive_io_cap(per_window: DataFrame, io_cap: int | Column, cache_size: int, before: dict[str, tuple[int, int, int]] | None = None, span: int = SPAN) -> DataFrame:
    """``trace, seq, cap, loads`` from ``trace, seq, n_selected, n_candidates``.

    The cap holds if no more are selected, or if the window has fewer candidate containers than the windows so far on
    average; otherwise the loads saved so far may be spent. ``before``: by trace, the windows, loads and candidates of
    earlier epochs.

    The credit is a recurrence over windows, but each window maps the credit by a function of slopes 0 and 1, and such
    functions compose: a block of ``span`` windows is composed into one function, the functions of a trace's blocks (a row for each)
    give the credit at every block's begin, and then all blocks are walked in parallel.
    """
    workers_import_package(per_window.sparkSession)
    rows = per_window.select("trace", "seq", "n_selected", "n_candidates", F.lit(1).alias("one__"), (io_cap if isinstance(io_cap, Column) else F.lit(io_cap)).cast("long").alias("cap0"))
    rows = stored(rows, "per_window")
    rows = sums_before(sums_before(rows, ["trace"], ["seq"], "one__", "i__"), ["trace"], ["seq"], "n_candidates", "met__")
    earlier = [(t, *c) for t, c in (before or {}).items()]
    start = per_window.sparkSession.createDataFrame(earlier, "trace string, i0 long, spent0 long, met0 long")  # one row per trace
    rows = rows.join(F.broadcast(start), "trace", "left").fillna(0, ["i0", "spent0", "met0"])
    i, met = F.col("i__") + F.col("i0") + 1, F.col("met__") + F.col("met0") + F.col("n_candidates")
    fixed = (F.col("n_selected") <= F.col("cap0")) | (F.col("n_candidates") * i < met)
    # a window spends its credit between low and high; a fixed one always the same
    held = F.least("n_selected", F.greatest("cap0", F.lit(1)))
    low = F.when(fixed, held).otherwise(F.least("n_selected", F.lit(1)))
    high = F.when(fixed, held).otherwise(F.least("n_selected", F.lit(max(cache_size, 1))))
    rows = rows.select("trace", "seq", "cap0", fixed.alias("fixed"), low.cast("long").alias("low"), high.cast("long").alias("high"), (F.col("cap0") * (F.col("i0") + 1) - F.col("spent0")).alias("first"), F.floor(F.col("seq") / span).alias("block"))
    rows = stored(rows, "credit_steps")

    def compose(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block, pieces = block.sort_values("seq"), [(-math.inf, 1, 0)]
        for cap, lo, hi in zip(block["cap0"].tolist(), block["low"].tolist(), block["high"].tolist(), strict=True):
            pieces = credit_step(pieces, cap, lo, hi)
        return pd.DataFrame({"trace": [key[0]], "block": [key[1]], "first": [block["first"].iloc[0]], "at": [[p[0] for p in pieces]], "slope": [[p[1] for p in pieces]], "offset": [[p[2] for p in pieces]]})

    def begin(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks, credits = blocks.sort_values("block"), []
        credit = int(blocks["first"].iloc[0])
        for at, slope, offset in zip(blocks["at"], blocks["slope"], blocks["offset"], strict=True):
            credits.append(credit)
            credit = credit_at(list(zip(at, slope, offset, strict=True)), credit)
        return pd.DataFrame({"trace": blocks["trace"], "block": blocks["block"], "credit": credits})

    def walk(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("seq")
        credit, caps, loads = int(block["credit"].iloc[0]), [], []
        for cap, fixed_, lo, hi in zip(block["cap0"].tolist(), block["fixed"].tolist(), block["low"].tolist(), block["high"].tolist(), strict=True):
            caps.append(cap if fixed_ else min(cache_size, credit))
            loads.append(min(max(credit, lo), hi))
            credit += cap - loads[-1]
        return pd.DataFrame({"trace": block["trace"], "seq": block["seq"], "cap": caps, "loads": loads}).astype({"cap": "int64", "loads": "int64"})

    functions = rows.groupBy("trace", "block").applyInPandas(compose, "trace string, block long, first long, at array<double>, slope array<long>, offset array<long>")
    credits = functions.groupBy("trace").applyInPandas(begin, "trace string, block long, credit long")
    return rows.join(credits, ["trace", "block"]).groupBy("trace", "block").applyInPandas(walk, "trace string, seq long, cap long, loads long")

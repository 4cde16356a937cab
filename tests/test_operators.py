"""Operators on small hand-worked tables and invariants of whole runs."""

import subprocess
import sys
import threading
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import ids as I
from fathomline.functions.storage import Growing, ranged, stored
from fathomline.operators import bloom as B
from fathomline.operators import exact as E
from fathomline.operators import index as H
from fathomline.operators import metrics as M
from fathomline.operators import near_exact as N
from fathomline.operators import ordinals as O
from fathomline.operators import select as C
from fathomline.operators import strict as K
from fathomline.operators import sweep as X
from fathomline.plans import queries as Q
from fathomline.sources import traces as T
from fathomline.streaming import ingest as G

TINY = N.Config(window_size=4, container_size=3, ratio=1, io_cap=1, policy="sort")


def chunks(spark, *versions, trace="t"):
    rows = [(trace, v, p, c) for v, text in enumerate(versions) for p, c in enumerate(text.split())]
    return spark.createDataFrame(rows, "trace string, version int, pos long, chunk_id string")


@pytest.fixture(scope="module")
def tiny(spark):
    return chunks(spark, "a b c d e a b c", "a b c x e f g z")


def report(rows, loads=None):
    got = M.version_report(rows, loads).orderBy("trace", "version").collect()
    return [(r.total, r.stored) + ((r.loads,) if loads is not None else ()) for r in got]


def test_exact_tiny(tiny):
    assert report(E.exact_dedup(O.assign_windows(tiny, 4))) == [(8, 5), (8, 4)]


def test_near_exact_by_version(tiny):
    rows, loads, state = N.near_exact_dedup(tiny, TINY)
    assert report(rows, loads) == [(8, 8, 0), (8, 5, 1)]
    cost = {r.version: r.locations for r in M.restore_cost(rows).collect()}
    assert cost == {0: 4, 1: 4}
    assert sorted(r[0] for r in state.hooks.select("chunk_id").distinct().collect()) == list("abcdeg")
    assert state.members.where("kind = 'container'").select("subset_id").distinct().count() == 5


def test_intra_exact_equals_exact_stored(tiny):
    rows, _, _ = N.near_exact_dedup(tiny, replace(TINY, intra="exact", io_cap=10, ratio=0))
    assert report(rows) == [(8, 5), (8, 4)]


def test_two_traces_do_not_mix(spark, tiny):
    both = tiny.unionByName(tiny.withColumn("trace", F.lit("u")))
    assert report(E.exact_dedup(O.assign_windows(both, 4))) == [(8, 5), (8, 4)] * 2
    rows, loads, _ = N.near_exact_dedup(both, TINY)
    assert report(rows, loads) == [(8, 8, 0), (8, 5, 1)] * 2


@pytest.mark.parametrize(("policy", "cap", "stored", "loads", "containers", "hooks"), [
    ("sort", 1, [1500, 300, 600, 900, 701], [0, 6, 6, 6, 6], 18, 444),
    ("fifo", 1, [1500, 300, 805, 925, 895], [0, 6, 6, 6, 6], 20, 485),
    ("sparse", 4, [1500, 300, 300, 300, 300], [0, 6, 12, 18, 24], 14, 300),
])
def test_snapshot_epochs(spark, sf, policy, cap, stored, loads, containers, hooks):
    cfg = N.Config(window_size=256, container_size=256, policy=policy, io_cap=cap)
    rows, io, state = N.near_exact_dedup(T.snapshot_trace(spark, sf), cfg)
    got = report(rows, io)
    assert [g[1] for g in got] == stored and [g[2] for g in got] == loads
    assert state.members.select("subset_id").distinct().count() == containers
    assert state.hooks.select("chunk_id").distinct().count() == hooks


def test_policies_on_one_window(spark):
    hooks = spark.createDataFrame([("t", c, "container", s, i) for i, (c, s) in enumerate([("a", 1), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("d", 3)])], "trace string, chunk_id string, kind string, subset_id long, ord long")
    window = spark.createDataFrame([("t", 9, p, c) for p, c in enumerate("abcd")], "trace string, seq long, win_pos int, chunk_id string")
    pairs = C.hook_pairs(C.hook_hits(window, hooks), hooks)
    cand = C.candidate_scores(pairs)
    meta = spark.createDataFrame([("t", "container", 1, 10), ("t", "container", 2, 20), ("t", "container", 3, 11)], "trace string, kind string, subset_id long, seq long")
    order = lambda df: [r.subset_id for r in df.orderBy("load_rank").collect()]
    assert order(C.select_sort(cand, 9)) == [1, 2, 3]
    assert order(C.select_sparse(pairs, 9)) == [1, 3]
    assert order(C.select_fifo(cand, 2)) == [1, 2]
    assert order(C.select_level(cand, meta, 9, 4, 4)) == [1, 3]
    assert order(C.select_all(cand)) == [1, 2, 3]
    assert order(C.select_sort(cand, 0)) == [1]  # at least one load


def test_greedy_cover_by_density():
    hook, subset = np.array(list("abcad")), np.array([1, 1, 1, 2, 2])
    assert C.greedy_cover(hook, subset, 5) == [1, 2]
    assert C.greedy_cover(hook, subset, 5, {1: 100, 2: 1}) == [2, 1]
    assert C.greedy_cover(hook[:0], subset[:0], 5) == []


def test_hybrid_excludes_overlapped_containers(spark):
    rows = [("t", 1, c, "recipe_hook", 7) for c in "abc"] + [("t", 1, c, "cnr_hook", 0) for c in "abc"] + [("t", 1, c, "cnr_hook", 1) for c in "xyz"] + [("t", 1, "a", "cnr_ptr", 0), ("t", 1, "x", "cnr_ptr", 1), ("t", 1, "y", "cnr_ptr", 1)]
    pairs = spark.createDataFrame(rows, "trace string, seq long, chunk_id string, role string, subset_id long")
    got = [(r.kind, r.subset_id) for r in C.select_hybrid(pairs, 2, 0.5).orderBy("load_rank").collect()]
    assert got == [("recipe", 7), ("container", 1)]
    got = [(r.kind, r.subset_id) for r in C.select_hybrid(pairs, 2, 0.0).orderBy("load_rank").collect()]
    assert got == [("container", 1), ("container", 0)]


def test_adaptive_cap_spends_saved_loads(spark):
    per = spark.createDataFrame([("t", 1, 1, 4), ("t", 2, 5, 9), ("t", 3, 5, 1)], "trace string, seq long, n_selected long, n_candidates long")
    got = [(r.cap, r.loads) for r in C.adaptive_io_cap(per, 2, 10).orderBy("seq").collect()]
    assert got == [(2, 1), (3, 3), (2, 2)]


def test_sampling_scalars(spark):
    row = spark.range(1).select(I.content_id(F.lit("abc")).alias("c")).select("c", I.fingerprint_number(F.col("c")).alias("fp")).first()
    assert (row.c, row.fp) == ("90:01:50:98:3c:d2", 158335321521362)
    picked = spark.range(30).where(I.sample_position(F.col("id"), 8)).collect()
    assert [r.id for r in picked] == [8, 17, 26]
    ids = spark.createDataFrame([("00:00:00:00:00:ff",), ("00:00:00:00:00:07",), (None,)], "c string")
    assert ids.where(I.sample_chunk_id(F.col("c"), 256)).count() == 1
    assert ids.where(I.sample_chunk_id(F.col("c"), 8)).count() == 2
    assert ids.where(I.sample_low_ones(F.col("c"), 0)).count() == 0
    with pytest.raises(ValueError):
        I.sampler("other", F.col("c"), F.col("c"), 8)


@pytest.mark.parametrize("n", [0, 1, 4, 5, 3, 9])
def test_window_edges(spark, n):
    got = O.assign_windows(chunks(spark, " ".join("abcdefghi"[:n]), "a b"), 4)
    assert got.where("version = 0").select("seq").distinct().count() == -(-n // 4)
    assert got.where("version = 1").first().seq == -(-n // 4) + 1


def test_legacy_windows(spark):
    got = O.assign_windows(chunks(spark, " ".join(map(str, range(12)))), 4, legacy_skip=True)
    assert sorted(r.pos for r in got.collect()) == [1, 2, 3, 4, 7, 8, 9, 10]


def test_all_equal_ids_and_partition_invariance(spark, sf):
    hot = chunks(spark, "a " * 50, "a " * 50)
    assert report(E.exact_dedup(O.assign_windows(hot, 8))) == [(50, 1), (50, 0)]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    one = E.with_locations(O.assign_windows(T.snapshot_trace(spark, sf), 256), 256).agg(F.sum(F.xxhash64("version", "pos", "location").cast("decimal(38,0)"))).first()[0]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == E.with_locations(O.assign_windows(T.snapshot_trace(spark, sf), 256), 256).agg(F.sum(F.xxhash64("version", "pos", "location").cast("decimal(38,0)"))).first()[0]


def test_hashes_and_filters(spark):
    assert int(B.fnv1a(np.array(["a:b"], dtype=object))[0]) == 16600709238102167904
    assert B.bloom_size(1024, 0.001) == (9, 13295) and B.bloom_size(64, 0.001) == (9, 830)

    def slow(data, seed):  # one id at a time
        m, mask = 0xC6A4A793, 0xFFFFFFFF
        h = (seed ^ (len(data) * m)) & mask
        while len(data) >= 4:
            h = (h + int.from_bytes(data[:4], "little")) * m & mask
            h ^= h >> 16
            data = data[4:]
        if data:
            h = (h + int.from_bytes(data, "little")) * m & mask
            h ^= h >> 24
        return h

    names = ["90:01:50:98:3c:d2", "ab", "abcd", "abcdefg"]
    for name, bits in zip(names, B.bloom_bits(np.array(names, dtype=object), 3, 997), strict=True):
        seed, want = 0xBC9F1D34, []
        for _ in range(3):
            seed = slow(name.encode(), seed)
            want.append(seed % 997)
        assert bits.tolist() == want


def test_bloom_loads_equal_a_replay(spark):
    rng = np.random.default_rng(5)
    trace = chunks(spark, " ".join(f"id{x:03d}" for x in rng.integers(0, 40, 120)), " ".join(f"id{x:03d}" for x in rng.integers(0, 60, 120)))
    rows = [(r.version, r.pos, r.chunk_id) for r in trace.orderBy("version", "pos").collect()]
    part = {r.chunk_id: r.part for r in B.hash_partition(trace.select("chunk_id").distinct(), 3).collect()}
    k, m = B.bloom_size(8, 0.001)
    for cache in (1, 2):
        loads = 0
        state = {}
        for _, _, c in rows:
            s = state.setdefault(part[c], {"filters": [set()], "sizes": [0], "seen": set(), "recent": []})
            bits = set(B.bloom_bits(np.array([c], dtype=object), k, m)[0].tolist())
            for i, f in enumerate(s["filters"]):
                if bits <= f:
                    if i not in s["recent"]:
                        loads += 1
                    else:
                        s["recent"].remove(i)
                    s["recent"] = [i, *s["recent"]][:cache]
            if c not in s["seen"]:
                if s["sizes"][-1] == 8:
                    s["filters"].append(set())
                    s["sizes"].append(0)
                s["filters"][-1] |= bits
                s["sizes"][-1] += 1
                s["seen"].add(c)
        store = B.partitioned_store(trace, 3, 8)
        assert B.bloom_loads(trace, store, 8, cache).where("load").count() == loads
    assert B.bloom_probe(store, B.bloom_build(store, 8), 8).join(store, ["trace", "part", "chunk_id", "bf_no"]).count() == store.count()


def test_ingest_is_idempotent_and_equals_epochs(spark, tiny, tmp_path):
    store = f"file://{tmp_path}/store"
    for v in (0, 1, 1):
        out = G.ingest_version(spark, store, tiny.where(F.col("version") == v), v, TINY)
    rows, _, _ = N.near_exact_dedup(tiny, TINY)
    want = sorted((r.pos, r.is_dup, r.location) for r in rows.where("version = 1").collect())
    assert sorted((r.pos, r.is_dup, r.location) for r in out.collect()) == want


def test_text_sources(spark, tmp_path):
    folder = tmp_path / "traces"
    folder.mkdir()
    (folder / "v0.txt").write_text("a1:00:00:00:00:7f 4096 0\n\na2:00:00:00:00:ff 4096 0\n")
    (folder / "v1.txt").write_text("a2:00:00:00:00:ff 4096 0\n")
    (tmp_path / "manifest").write_text("v0.txt 8\nv1.txt 8\n")
    versions = T.read_manifest(spark, f"file://{tmp_path}/manifest")
    assert [(r.version, r.name) for r in versions.orderBy("version").collect()] == [(0, "v0.txt"), (1, "v1.txt")]
    got = T.read_trace(spark, f"file://{folder}", versions).orderBy("version", "pos").collect()
    assert [(r.version, r.pos, r.chunk_id[:2]) for r in got] == [(0, 0, "a1"), (0, 1, "a2"), (1, 0, "a2")]


def test_invariants_of_a_near_exact_run(spark, sf):
    cfg = N.Config(window_size=128, container_size=128, policy="level", io_cap=2, method="chunkID", ratio=8)
    rows, loads, state = N.near_exact_dedup(T.snapshot_trace(spark, sf).where("version < 3"), cfg)
    rows.cache()
    assert rows.where("location is null").count() == 0
    assert rows.where(~F.col("is_dup")).count() == state.members.count()
    assert loads.groupBy("trace", "seq").count().agg(F.max("count")).first()[0] <= 2
    held = rows.join(state.members.select("trace", F.col("subset_id").alias("location"), "chunk_id").distinct(), ["trace", "location", "chunk_id"])
    assert held.count() == rows.count()


@pytest.mark.parametrize("kind", ["recipe", "hybrid"])
def test_recipe_and_hybrid_runs(spark, tiny, kind):
    cfg = replace(TINY, kind=kind, hook_bits=(1, 1), segment_size=2, hybrid_ratio=0.5, io_cap=2, cap_adaptive=kind == "hybrid")
    trace = tiny.withColumn("chunk_id", I.content_id(F.col("chunk_id")))
    rows, loads, _ = N.near_exact_dedup(trace, cfg)
    got = report(rows, loads)
    assert got[0] == (8, 8, 0) and got[1][1] < 8 and got[1][2] > 0


def test_empty_trace(spark, tiny):
    none = tiny.where("false")
    assert E.exact_dedup(O.assign_windows(none, 4)).count() == 0
    assert B.hash_partition(none, 4).count() == 0


def test_index_ratios(spark, tiny):
    hooks = spark.createDataFrame([("t", "a", "container", 0), ("t", "b", "container", 0), ("t", "a", "recipe", 0), ("t", "c", "recipe", 1), ("t", "d", "recipe", 1)], "trace string, chunk_id string, kind string, subset_id long")
    assert [tuple(r) for r in H.index_stats(hooks, tiny).collect()] == [("t", 4, 5, 4, 16 / 3, 9 / 2)]
    assert H.index_stats(hooks, tiny, tiny.where("version = 0")).first().container_ratio == 8 / 2
    assert [tuple(r) for r in H.index_stats(hooks.where("false"), tiny).collect()] == [("t", 0, 0, None, 0.0, 0.0)]


def test_cap_goes_on_across_epochs(spark):
    rows = [("t", i, 1 if i < 3 else 5, 9) for i in range(1, 7)] + [("u", i, 1, 2) for i in range(1, 4)]
    per = spark.createDataFrame(rows, "trace string, seq long, n_selected long, n_candidates long")
    whole = {(r.trace, r.seq): (r.cap, r.loads) for r in C.adaptive_io_cap(per, 2, 10).collect()}
    first = C.adaptive_io_cap(per.where("seq <= 2"), 2, 10).collect()
    carried = {t: (2, sum(r.loads for r in first if r.trace == t), 2 * n) for t, n in (("t", 9), ("u", 2))}
    rest = C.adaptive_io_cap(per.where("seq > 2"), 2, 10, carried).collect()
    assert {(r.trace, r.seq): (r.cap, r.loads) for r in [*first, *rest]} == whole
    alone = {(r.trace, r.seq): (r.cap, r.loads) for r in C.adaptive_io_cap(per.where("seq > 2"), 2, 10).collect()}
    assert alone != {k: v for k, v in whole.items() if k[1] > 2}


def test_no_flush_keeps_loads_of_earlier_epochs(spark):
    trace = chunks(spark, "a b c d", "a x", "b c y")
    for flush, stored_last in ((True, 3), (False, 1)):  # v1 loads the container of a b c; v2 has no hook of it
        cfg = replace(TINY, flush=flush, container_size=4, method="position", ratio=3)
        rows, _, state = N.near_exact_dedup(trace, replace(cfg, ratio=0))
        assert report(rows)[0] == (4, 4)
        hooks = state.hooks.where("chunk_id = 'a' and version = 0")
        first = N.State(state.members.where("version = 0"), hooks, state.firsts.where("false"), {"t": N.Counters(container=1, ord=4)})
        windowed = O.assign_windows(trace, 4)
        made = N.run_epoch(windowed.where("version = 1"), first, cfg)
        then = N.State(first.members.unionByName(ranged(made.members)), hooks, first.firsts if flush else made.firsts, made.counters)
        last = N.run_epoch(windowed.where("version = 2"), then, cfg)
        assert last.rows.where(~F.col("is_dup")).count() == stored_last


def test_chunks_without_id_are_new(spark):
    trace = spark.createDataFrame([("t", 0, 0, None), ("t", 0, 1, "a"), ("t", 1, 0, None), ("t", 1, 1, "a")], "trace string, version int, pos long, chunk_id string")
    rows = E.with_locations(O.assign_windows(trace, 4), 2)
    assert report(rows) == [(2, 2), (2, 1)] and rows.where("location is null").count() == 0


def test_sums_before_on_three_levels(spark, monkeypatch):
    monkeypatch.setattr(O, "SPAN", 3)
    rows = [("t", b, i) for b in range(20) for i in range(b % 4)] + [("u", 5, 0)]
    got = O.block_ordinal(spark.createDataFrame(rows, "trace string, block long, i int"), ["trace"], ["block"], ["i"], "k").orderBy("trace", "block", "i").collect()
    assert [r.k for r in got] == [*range(len(rows) - 1), 0]


def test_recipe_files_of_the_original_form(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "7").write_text("a1:00 3 a2:00 4 ")
    (tmp_path / "r" / "12").write_text("a1:00 3")
    got = T.read_recipe_files(spark, f"file://{tmp_path}/r", "t").orderBy("recipe_id", "slot").collect()
    assert [tuple(r) for r in got] == [("t", 7, 0, "a1:00", 3), ("t", 7, 1, "a2:00", 4), ("t", 12, 0, "a1:00", 3)]


def test_partitions_grow_with_the_data(spark, tiny):
    assert B.partitions_for(tiny, 4) == 1 and B.partitions_for(chunks(spark, " ".join(f"i{n}" for n in range(600))), 4) == 3
    assert B.partitions_for(tiny.where("false"), 4) == 1


def test_reports_have_all_columns(spark, tiny):
    trace = tiny.withColumn("chunk_id", I.content_id(F.col("chunk_id")))
    for kind, n in (("container", 22), ("recipe", 22), ("hybrid", 28)):
        cfg = replace(TINY, kind=kind, hook_bits=(1, 1), segment_size=2, hybrid_ratio=0.5, io_cap=2)
        rows, loads, state = N.near_exact_dedup(trace, cfg)
        assert len(M.engine_report(rows, loads, state.hooks, cfg).columns) == n + 2


def test_ingest_equals_epochs(spark, sf):
    whole = M.version_report(N.near_exact_dedup(T.snapshot_trace(spark, sf), Q.CFG)[0])
    cols = ["trace", "version", "total", "stored", "windows"]
    ingested = [tuple(r) for r in Q.incremental_ingest(spark, sf).orderBy("version").collect()]
    assert ingested == [tuple(r) for r in whole.select(cols).orderBy("version").collect()] and len(ingested) == 5


def walked_caps(rows, cap, cache, start=(0, 0, 0)):
    """Caps and loads window by window."""
    (i, spent, met), out = start, []
    for selected, candidates in rows:
        i, met = i + 1, met + candidates
        value = cap if selected <= cap or candidates * i < met else min(cache, i * cap - spent)
        out.append((value, min(selected, max(value, 1))))
        spent += out[-1][1]
    return out


@pytest.mark.parametrize("span", [1, 3, 1024])
def test_cap_as_a_scan_equals_the_walk(spark, span):
    r = np.random.default_rng(span)
    traces = {f"{i}|t": [(int(s), int(c)) for s, c in zip(r.integers(0, 12, n), r.integers(0, 9, n), strict=True)] for i, n in enumerate((1, 7, 40, 200))}
    rows = [(t, 5 + i, s, c) for t, windows in traces.items() for i, (s, c) in enumerate(windows)]
    per = spark.createDataFrame(rows, "trace string, seq long, n_selected long, n_candidates long")
    caps, before = {"0|t": 0, "1|t": 1, "2|t": 3, "3|t": 4}, {"2|t": (6, 11, 20), "3|t": (2, 8, 3)}
    by_trace = F.when(F.col("trace") == "0|t", 0).when(F.col("trace") == "1|t", 1).when(F.col("trace") == "2|t", 3).otherwise(4)
    got = C.adaptive_io_cap(per, by_trace, 7, before, span=span).orderBy("trace", "seq").collect()
    for t, windows in traces.items():
        assert [(x.cap, x.loads) for x in got if x.trace == t] == walked_caps(windows, caps[t], 7, before.get(t, (0, 0, 0)))
    assert C.adaptive_io_cap(per.where("false"), 2, 7).count() == 0


def test_strict_sealing_on_the_tiny_trace(spark, tiny):
    """FIXTURES 3.1: three sealed containers, z stays open and has no hook."""
    rows, loads, hooks = K.strict_dedup(tiny, TINY)
    assert report(rows, loads) == [(8, 5, 1), (8, 5, 1)]
    assert sorted(h.chunk_id for h in hooks.collect()) == ["b", "d", "f", "x"]
    assert sorted(r.n for r in M.restore_cost(rows).selectExpr("locations as n").collect()) == [4, 4]
    assert rows.where(~F.col("is_dup")).agg(F.max("ord")).first()[0] == 9


@pytest.mark.parametrize("policy", ["sparse", "level", "all"])
def test_strict_sealing_equals_a_walk(spark, policy):
    """Every window against what the windows before it sealed, one epoch a window."""
    r = np.random.default_rng(4)
    versions = []
    for v in range(3):
        words = [f"c{int(x)}" for x in (np.arange(40) if not v else np.where(r.random(40) < 0.25, 100 * v + np.arange(40), np.arange(40)))]
        versions.append(" ".join(words))
    trace = chunks(spark, *versions)
    cfg = replace(TINY, policy=policy, window_size=8, container_size=5, io_cap=2)
    rows, loads, _ = K.strict_dedup(trace, cfg)
    stored, seq_loads, ends = [], {}, {}
    windowed = O.assign_windows(trace, 8).orderBy("seq", "win_pos").collect()
    for seq in range(1, max(x.seq for x in windowed) + 1):
        own = [x.chunk_id for x in windowed if x.seq == seq]
        last = (len(stored) - 1) // 5
        seen = [(c, k, k // 5) for k, c in enumerate(stored) if k // 5 < last]
        points: dict = {}
        for c, k, s in seen:
            if (k + 1) % 2 == 0:
                points.setdefault(c, set()).add(s)
        pairs = [(c, s) for c in dict.fromkeys(own) for s in points.get(c, ())]
        if policy == "sparse":
            picked = C.greedy_cover(np.array([c for c, _ in pairs]), np.array([s for _, s in pairs]), 2) if pairs else []
        elif policy == "all":
            picked = sorted({s for _, s in pairs})[:2]
        else:
            score = {s: sum(own.count(c) for c, t in pairs if t == s) for _, s in pairs}
            made = {s: max(ends[k] for _, k, t in seen if t == s) for s in score}
            picked = C.level_clusters([(s, score[s], made[s]) for s in sorted(score, key=lambda s: (-score[s], s))], 2 * 8 / 5)[:2]
        seq_loads[seq] = picked
        found = {c for c, _, s in seen if s in picked}
        for c in own:
            if c not in found:
                ends[len(stored)] = seq
                stored.append(c)
    got = rows.where(~F.col("is_dup")).orderBy("ord").collect()
    assert [x.chunk_id for x in got] == stored
    by_seq: dict = {}
    for x in loads.orderBy("seq", "load_rank").collect():
        by_seq.setdefault(x.seq, []).append(x.subset_id)
    assert by_seq == {k: v for k, v in seq_loads.items() if v}


def test_strict_sealing_packs_settled_versions_once(spark, monkeypatch):
    """What earlier versions stored is not packed again, and what is not stored never."""
    packed, real = [], K.stored

    def spy(df, name="t", *by):
        out = real(df, name, *by)
        packed.extend([out.count()] * (name == "packed"))
        return out

    monkeypatch.setattr(K, "stored", spy)
    rows, _, _ = K.strict_dedup(chunks(spark, *[" ".join(f"c{v if i % 4 == v else 0}_{i}" for i in range(24)) for v in range(3)]), replace(TINY, window_size=8, io_cap=4))
    assert sum(packed) < 2 * rows.where(~F.col("is_dup")).count()


def test_strict_sealing_edges(spark, tiny):
    rows, loads, hooks = K.strict_dedup(tiny.where("false"), TINY)
    assert (rows.count(), loads.count(), hooks.count()) == (0, 0, 0)
    none = spark.createDataFrame([("t", v, p, None) for v in range(2) for p in range(5)], "trace string, version int, pos long, chunk_id string")
    assert report(K.strict_dedup(none, TINY)[0]) == [(5, 5), (5, 5)]
    with pytest.raises(ValueError, match="containers"):
        K.strict_dedup(tiny, replace(TINY, kind="recipe"))


@pytest.mark.parametrize("how", [{"kind": "container", "policy": "sparse"}, {"kind": "recipe", "flush": False}, {"kind": "hybrid", "cap_adaptive": True, "segment_size": 2}])
def test_a_grid_equals_its_runs(spark, how):
    trace = chunks(spark, "a b c d e a b c d", "a b c x e f g z a b", "x e f a b c d q r").withColumn("chunk_id", I.content_id(F.col("chunk_id")))
    trace = trace.unionByName(trace.where("version < 2").withColumn("trace", F.lit("u")))
    base = replace(TINY, hook_bits=(1, 1), hybrid_ratio=0.5, **how)
    grid = ({"io_cap": 3, "ratio": 2}, {"io_cap": 2, "hook_bits": (2, 1), "version_bound": 0, "hybrid_ratio": 1.0})
    rows, loads, _ = N.near_exact_dedup(trace, replace(base, grid=grid))
    key = ["trace", "version", "pos", "is_dup", "location"]
    for i, change in enumerate(grid):
        alone, own_loads, _ = N.near_exact_dedup(trace, replace(base, **change))
        same = lambda df, cols: sorted(tuple(r) for r in df.select(cols).collect())
        part = rows.where(F.col("trace").startswith(f"{i}|")).withColumn("trace", F.split("trace", r"\|")[1])
        assert same(part, key) == same(alone, key)
        own = loads.where(F.col("trace").startswith(f"{i}|")).withColumn("trace", F.split("trace", r"\|")[1])
        assert same(own, own_loads.columns) == same(own_loads, own_loads.columns)
    with pytest.raises(ValueError, match="vary"):
        N.near_exact_dedup(trace, replace(base, grid=({"window_size": 8},)))


def test_only_ranges_of_loaded_subsets_are_read(spark, monkeypatch):
    members = Growing(spark, N.MEMBERS, by_range=True)
    rows = spark.range(64 * 20).selectExpr("'t' as trace", "'container' as kind", "id as subset_id", "concat('c', id) as chunk_id", "id as location", "1L as seq", "0 as version")
    members.add(rows, 0)
    chosen = stored(spark.createDataFrame([("t", 9, "container", 70, 1), ("t", 9, "container", 1200, 2)], C.SELECTED))
    windowed = spark.createDataFrame([("t", 9, "c70"), ("t", 9, "c71"), ("t", 9, "c1200")], "trace string, seq long, chunk_id string")
    got = N.load_subsets(windowed, chosen, members.read())
    assert sorted((r.chunk_id, r.location) for r in got.collect()) == [("c1200", 1200), ("c70", 70)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_two_traces_are_ingested_as_they_run(spark, tmp_path):
    """Windows count apart for each trace, and recipe hooks expire, as in a run by epochs."""
    trace = chunks(spark, "a b", "a b c d e", "a c d e f").unionByName(chunks(spark, "k l m n o p q r s t", "k l x n o p", "k l m n y", trace="u"))
    trace = trace.withColumn("chunk_id", I.content_id(F.col("chunk_id")))
    for change in ({"kind": "hybrid", "version_bound": 0, "hook_bits": (1, 1), "segment_size": 2, "hybrid_ratio": 0.5}, {"flush": False, "ratio": 0}):
        cfg = replace(TINY, io_cap=2, **change)
        store = f"file://{tmp_path}/{cfg.kind}"
        for v in (0, 1, 2, 2):  # the last one again: the same
            G.ingest_version(spark, store, trace.where(F.col("version") == v), v, cfg)
        columns = ["trace", "version", "pos", "seq", "is_dup", "location"]
        want, _, _ = N.near_exact_dedup(trace, cfg)
        got = spark.read.schema(G.DEDUP).parquet(f"{store}/rows")
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_hot_hooks_cost_their_subsets_once(spark):
    """One hook in 200 windows points to 300 subsets: 60,000 pairs; those that lead give the same choices."""
    hits = [("t", w, "hot", 1, 0) for w in range(1, 201)] + [("t", w, "warm", 2, 1) for w in range(1, 201, 2)] + [("t", w, f"c{w % 7}", 1, 2) for w in range(1, 201, 3)]
    hooks = [("t", "hot", s, s) for s in range(300)] + [("t", "warm", s, s) for s in range(100, 200)] + [("t", f"c{k}", s, s) for k in range(7) for s in (290 - k, 150 + k, 305)]
    hits = spark.createDataFrame(hits, "trace string, seq long, chunk_id string, cnt long, first_pos int")
    hooks = spark.createDataFrame(hooks, "trace string, chunk_id string, subset_id long, ord long").withColumn("kind", F.lit("container"))
    for cap in (1, 4):
        few, every = C.leading_pairs(hits, hooks, cap).cache(), C.hook_pairs(hits, hooks)
        assert every.count() > 60_000 and few.count() < 200 * (2 * cap + 8) * 2
        rows = lambda df: sorted(tuple(r) for r in df.collect())
        assert rows(C.select_sort(C.candidate_scores(few), cap)) == rows(C.select_sort(C.candidate_scores(every), cap))
        assert rows(C.select_sparse(few, cap)) == rows(C.select_sparse(every, cap))


def test_leading_pairs_choose_as_all_pairs_do(spark):
    r = np.random.default_rng(6)
    hooks = [("t", f"h{h}", int(s), int(s)) for h in range(12) for s in sorted(r.choice(40, r.integers(1, 25), replace=False))]
    hits = [("t", w, f"h{h}", int(r.integers(1, 4)), i) for w in range(1, 60) for i, h in enumerate(r.choice(12, r.integers(1, 6), replace=False))]
    hits = spark.createDataFrame(hits, "trace string, seq long, chunk_id string, cnt long, first_pos int")
    hooks = spark.createDataFrame(hooks, "trace string, chunk_id string, subset_id long, ord long").withColumn("kind", F.lit("container"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    every = C.hook_pairs(hits, hooks)
    for cap, heavy in ((1, 3), (3, 8), (3, 0)):
        few = C.leading_pairs(hits, hooks, cap, heavy)
        assert few.count() <= every.count()
        assert rows(C.select_sort(C.candidate_scores(few), cap)) == rows(C.select_sort(C.candidate_scores(every), cap))
        assert rows(C.select_sparse(few, cap)) == rows(C.select_sparse(every, cap))


@pytest.mark.parametrize("cache", [1, 2, 3])
def test_filter_loads_by_blocks_equal_the_walk(spark, cache):
    r = np.random.default_rng(cache)
    names = [f"{int(x):02x}:00:00:00:00:00" for x in range(60)]
    rows = [("t", v, p, names[0] if r.random() < 0.3 else names[int(r.integers(0, 60))]) for v in range(3) for p in range(120)]
    trace = spark.createDataFrame(rows, "trace string, version int, pos long, chunk_id string")
    store = stored(B.partitioned_store(trace, 2, 4), "store")
    columns, seen = ["trace", "part", "version", "pos", "bf_no", "load"], {}
    for span in (1, 7, 1024):
        seen[span] = sorted(tuple(x) for x in B.bloom_loads(trace, store, 4, cache, span=span).select(columns).collect())
    assert seen[1] == seen[7] == seen[1024] and len(seen[1]) > 100
    recent, here = [], None
    for t, part, _, _, bf, load in seen[7]:
        if (t, part) != here:
            here, recent = (t, part), []
        assert load == (bf not in recent[:cache])
        recent = [bf, *(x for x in recent if x != bf)]


SPILLED = """
import sys
import threading
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.shuffle.spill.numElementsForceSpillThreshold", "100").getOrCreate())
from fathomline.sources import traces as T
base, trace = sys.argv[1], T.snapshot_trace(spark, sys.argv[2]).select("trace", "version", "pos", "chunk_id")
T.write_trace(trace, f"{base}/trace")
assert trace.exceptAll(T.read_written_trace(spark, f"{base}/trace", "snapshot")).isEmpty()
"""


def test_a_written_trace_keeps_its_order_when_sorts_spill(tmp_path, sf):
    """In a session of its own, as the limit beyond which a sort spills is fixed at its start."""
    subprocess.run([sys.executable, "-c", SPILLED, str(tmp_path), sf], cwd=Path(__file__).resolve().parents[1], check=True, timeout=300)


def test_compared_runs_go_on_side_by_side(spark, tiny, monkeypatch):
    """Each of two runs waits until the other has begun."""
    both = threading.Barrier(2, timeout=60)
    rows = spark.createDataFrame([("t", 0, 1, False, 0), ("t", 0, 1, True, 0)], "trace string, version int, seq long, is_dup boolean, location long")
    loads = spark.createDataFrame([("t", 0, 1, "container")], "trace string, version int, seq long, kind string")

    def run(*_):
        both.wait()
        return rows, loads, None

    monkeypatch.setattr(X, "near_exact_dedup", run)
    got = X.compare_strategies(tiny, TINY, {"a": {}, "b": {"policy": "fifo"}}, exact=False).orderBy("strategy").collect()
    assert [(r.strategy, r.total, r.stored, r.loads) for r in got] == [("a", 2, 1, 1), ("b", 2, 1, 1)]


def test_a_stored_table_is_read_by_the_folders_it_needs(spark, tiny):
    table = stored(tiny, "t", "version")
    assert table.where("version = 1").select("trace", "pos", "chunk_id").exceptAll(tiny.where("version = 1").select("trace", "pos", "chunk_id")).isEmpty()
    assert all("version=1" in f for f in table.where("version = 1").select(F.input_file_name()).distinct().toPandas().iloc[:, 0])


@pytest.mark.parametrize("kind", ["container", "recipe", "hybrid"])
def test_an_epoch_writes_its_rows_once_beside_its_result(spark, tiny, monkeypatch, kind):
    """Steps of an epoch that are written hold a row for each hit or window, but for one that holds all rows."""
    sizes, write = [], N.stored

    def noted(df, name="t", *by):
        out = write(df, name, *by)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(N, "stored", noted)
    cfg = replace(TINY, kind=kind, window_size=8, segment_size=4, hook_bits=(1, 1))
    rows, _, _ = N.near_exact_dedup(tiny.where("version = 0"), cfg)
    assert rows.count() == 8 and [n for n, size in sizes if size >= 8] == ["windowed", "flagged"]


def test_firsts_from_windows_equal_exact_deduplication(spark, tiny):
    """Also for chunks without an id. Firsts are found by hash aggregates, and gapless positions number recipes where rows lie."""
    odd = tiny.withColumn("chunk_id", F.when(F.col("chunk_id") != "b", F.col("chunk_id"))).unionByName(chunks(spark, "a a b", "b a c", trace="u"))
    rows = lambda df, *cols: sorted((tuple(r) for r in df.select("trace", "version", "pos", *cols).collect()), key=repr)
    windowed = stored(O.assign_windows(odd, 4))
    packed = E.pack_firsts(windowed, 4, 3)
    assert rows(E.locate_firsts(windowed, stored(packed)), "is_dup", "location") == rows(E.with_locations(windowed, 3), "is_dup", "location")
    assert "SortAggregate" not in packed._jdf.queryExecution().executedPlan().toString()
    for some in (windowed, windowed.where("pos <> 2")):
        assert rows(E.number_recipes(some, 3), "recipe_id", "slot") == rows(E.build_recipes(some, 3), "recipe_id", "slot")
    assert "hashpartitioning(seq" not in E.number_recipes(windowed, 3)._jdf.queryExecution().executedPlan().toString()


def test_firsts_are_found_once(spark, tiny):
    """Neither the counts before a block nor the rows look for first occurrences again."""
    packed = E.pack_firsts(stored(O.assign_windows(tiny, 4)), 4, 3)
    assert packed._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(chunk_id") == 0
    assert sorted(r.ord for r in packed.collect()) == list(range(packed.count()))


def test_segment_recipes_are_numbered_where_rows_lie(spark, tiny):
    """Also beside gaps, where windows are counted."""
    more = stored(O.assign_windows(tiny.unionByName(chunks(spark, "a a b", "b a c d e f g", trace="u")), 4))
    rows = lambda df: sorted(tuple(r) for r in df.select("trace", "version", "pos", "recipe_id").collect())
    for some in (more, more.where("pos <> 2"), more.where("pos > 1")):
        for size in (3, 2):
            assert rows(E.number_segment_recipes(some, 4, size)(some)) == rows(E.build_segment_recipes(O.segment_fixed(some, size)))
    assert "hashpartitioning(seq" not in E.number_segment_recipes(more, 4, 3)(more)._jdf.queryExecution().executedPlan().toString()


def test_ratio_sweep_writes_no_rows_for_each_ratio(spark, tiny, monkeypatch):
    sizes, real = {}, X.stored

    def spy(df, name="t", *by):
        out = real(df, name, *by)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(X, "stored", spy)
    windowed = stored(O.assign_windows(tiny, 4))
    packed = E.pack_firsts(windowed, 4, 3).where("version = 0")
    members = packed.select("trace", F.lit("container").alias("kind"), F.col("container_id").alias("subset_id"), "chunk_id", F.col("container_id").alias("location"), "seq", "version")
    got = X.ratio_sweep(windowed.where("version = 1"), packed, members, [0, 1, 3], 4).collect()
    assert [r.total for r in got] == [8] * 3 and all(n < 24 for n in sizes.values())


def test_exported_recipes_share_files(spark, tmp_path):
    """Files do not grow with the recipes; every recipe is read back."""
    recipes = spark.range(400).selectExpr("id div 2 as recipe_id", "cast(id % 2 as int) as slot", "concat('a', id) as chunk_id", "id % 7 as location")
    T.export_recipe_files(recipes, f"file://{tmp_path}/r")
    assert len(list((tmp_path / "r").rglob("*.txt"))) <= 8
    got = T.read_recipe_files(spark, f"file://{tmp_path}/r", "t").select("recipe_id", "slot", "chunk_id", "location")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, recipes.collect()))

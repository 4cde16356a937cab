"""Windows that meet the pieces of their loads in one task, and ids as numbers in whole runs."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.functions import ids as I
from fathomline.operators import near_exact as N
from fathomline.operators import select as C
from fathomline.operators import strict as K

CFG = N.Config(window_size=4, container_size=3, ratio=1, io_cap=2, policy="sort")


def trace(spark):
    rows = [("t", v, p, c) for v, text in enumerate(("a b c d e a b c d", "a b c x e f g z a", "x e f a b c d q")) for p, c in enumerate(text.split())]
    return spark.createDataFrame(rows, "trace string, version int, pos long, c string")


@pytest.mark.parametrize("batch", [1, 3, 1000])
@pytest.mark.parametrize("text", [True, False])
def test_windows_find_their_chunks_as_one_by_one(monkeypatch, batch, text):
    monkeypatch.setattr(N, "SEARCHED", 2)
    r, rows, want = np.random.default_rng(3), [], []
    name = (lambda c: f"c{c}") if text else int
    for seq in range(1, 12):
        ids = [None if c == 7 else name(c) for c in r.integers(0, 20, r.integers(1, 6)).tolist()]
        rows.append({"seq": seq, "ids": ids, "load_rank": 0, "places": None, "home": None})
        first = {}
        for rank in range(1, int(r.integers(0, 4)) + 1):
            home, held = int(r.integers(0, 50)), [None if c == 7 else name(c) for c in r.integers(0, 20, 4).tolist()]
            places = None if rank % 2 else r.integers(0, 50, 4).tolist()
            rows.append({"seq": seq, "ids": held, "load_rank": rank, "places": places, "home": home})
            for c, p in zip(held, places or [home] * 4, strict=True):
                if c is not None:
                    first[c] = min(first.get(c, (rank, p)), (rank, p))
        found = [first[c][1] if c in first else None for c in ids]
        want.append((seq, ids, found, [c for c, f in zip(ids, found, strict=True) if f is None]))
    schema = pa.schema([("seq", pa.int64()), ("ids", pa.list_(pa.string() if text else pa.int64())), ("load_rank", pa.int32()), ("places", pa.list_(pa.int64())), ("home", pa.int64())])
    table = pa.Table.from_pylist(rows, schema=schema)
    got = [x for b in N.searched(table.to_batches(max_chunksize=batch)) for x in b.to_pylist()]
    assert [(x["seq"], x["ids"], x["found"], x["news"]) for x in got] == want
    for x in got:
        assert [n for n, f in zip(x["nth"], x["found"], strict=True) if f is None] == list(range(len(x["news"])))


@pytest.mark.parametrize("kind", ["container", "hybrid"])
def test_ids_as_numbers_give_the_same_run(spark, kind):
    """also for positions with gaps, which leave a segment's chunks apart."""
    cfg = replace(CFG, kind=kind, hook_bits=(1, 1), segment_size=2, hybrid_ratio=0.5, method="chunkID" if kind == "container" else "position", ratio=2)
    some = trace(spark).where("pos <> 2")
    runs = []
    for make in (I.content_id, I.content_number):
        rows, loads, state = N.near_exact_dedup(some.withColumn("chunk_id", make(F.col("c"))).drop("c"), cfg)
        members = state.members.groupBy("kind", "subset_id").agg(F.sort_array(F.collect_list("location")).alias("l"))
        runs.append([sorted(map(tuple, df.collect()), key=repr) for df in (rows.drop("chunk_id"), loads, members)])
    assert runs[0] == runs[1]


def test_no_chunk_is_shuffled_to_be_found(spark):
    """windows and pieces are, by window."""
    pieces = spark.createDataFrame([], N.PIECES)
    blocks = spark.createDataFrame([("t", 1, 0, ["a"], [0])], "trace string, seq long, version int, ids array<string>, win_pos array<int>")
    plan = N.find(blocks, spark.createDataFrame([], C.SELECTED), pieces)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "chunk_id" not in plan


def test_chunks_meet_the_hooks_of_all_variants_once(spark):
    """what is joined with the hooks are a trace's chunks, not those of each variant."""
    windowed = spark.createDataFrame([("t", 0, 1, 0, "a"), ("t", 0, 1, 1, "b")], "trace string, version int, seq long, win_pos int, chunk_id string")
    hooks = spark.createDataFrame([("0|t", "a"), ("1|t", "a"), ("1|t", "x")], "trace string, chunk_id string")
    hits = N.hits_of(windowed, hooks, replace(CFG, grid=({"io_cap": 1}, {"io_cap": 2})))
    assert sorted((h.trace, h.chunk_id, h.cnt) for h in hits.collect()) == [("0|t", "a", 1), ("1|t", "a", 1)]


def test_policies_take_many_windows_at_once(spark):
    """no Python call for each window; the choices are those of each window alone."""
    r = np.random.default_rng(5)
    rows = [("t", int(s), f"c{c}", "container", int(k)) for s, c, k in r.integers(0, 9, (200, 3))]
    pairs = spark.createDataFrame(rows, "trace string, seq long, chunk_id string, kind string, subset_id long").distinct()
    sparse = C.select_sparse(pairs, 3)
    scores = [("t", int(s), "container", int(k), int(n)) for s in range(5) for k, n in enumerate(r.integers(1, 9, 8))]
    candidates = spark.createDataFrame(scores, "trace string, seq long, kind string, subset_id long, score long")
    meta = spark.createDataFrame([("t", "container", k, 3 * k) for k in range(8)], "trace string, kind string, subset_id long, seq long")
    level = C.select_level(candidates, meta, 2, 4, 2)
    assert all("FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString() for df in (sparse, level))
    by = {}
    for x in sparse.orderBy("seq", "load_rank").collect():
        by.setdefault(x.seq, []).append(x.subset_id)
    for seq in {x[1] for x in rows}:
        own = [(x[2], x[4]) for x in rows if x[1] == seq]
        assert by[seq] == C.greedy_cover(np.array([c for c, _ in own]), np.array([k for _, k in own]), 3)
    for seq in range(5):
        own = sorted(((x[3], x[4], 3 * x[3]) for x in scores if x[1] == seq), key=lambda c: (-c[1], c[0]))
        assert [x.subset_id for x in level.where(F.col("seq") == seq).orderBy("load_rank").collect()] == C.level_clusters(own, 4)[:2]


def test_strict_runs_meet_pieces_and_take_numbers(spark):
    """chunks that come back inside their version are searched again, with ids as text and as numbers; members are kept in pieces."""
    cfg, runs = replace(CFG, grid=({"io_cap": 1}, {"io_cap": 3})), []
    for make in (I.content_id, I.content_number):
        rows, loads, hooks = K.strict_dedup(trace(spark).withColumn("chunk_id", make(F.col("c"))).drop("c"), cfg)
        runs.append([sorted(map(tuple, df.collect()), key=repr) for df in (rows.drop("chunk_id"), loads, hooks.drop("chunk_id"))])
    assert runs[0] == runs[1] and any(r[-2] is not None for r in runs[0][0])
    pieces = K._pieces(spark.createDataFrame([("t", 0, 1, "a", 0, 0), ("t", 0, 1, "b", 1, 0)], "trace string, version int, seq long, chunk_id string, ord long, container_id long"))
    assert [sorted(r.ids) for r in pieces.collect()] == [["a", "b"]]

"""Hybrid hooks and selections: ids as numbers, stored chunks apart, many windows at once."""

import contextlib
import hashlib
import io

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.functions import ids as I
from fathomline.operators import index as H
from fathomline.operators import select as C
from fathomline.plans import queries as Q
from fathomline.sources import traces as T


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def joins_by_id(df):
    return sum("chunk_id" in line for line in plan(df).splitlines() if line.startswith(("Left keys", "Right keys"))) // 2


def windows(seed, n=40):
    rng = np.random.default_rng(seed)
    parts = [pd.DataFrame({"w": w, "hook": [f"h{h}" for h in rng.integers(0, 12, k)], "subset": rng.integers(0, 9, k)}) for w in range(n) for k in [int(rng.integers(1, 60))]]
    return pd.concat(parts, ignore_index=True).sample(frac=1, random_state=seed).reset_index(drop=True)


@pytest.mark.parametrize("sized", [False, True])
@pytest.mark.parametrize("limit", [1, 3, 20])
def test_covers_of_many_windows_equal_those_of_one(limit, sized):
    rows = windows(limit)
    size = rows["subset"] % 4 + 1
    rows["place"] = C.greedy_covers(rows["w"].to_numpy(), rows["hook"].to_numpy(), rows["subset"].to_numpy(), limit, size.to_numpy() if sized else None)
    for _, own in rows.groupby("w"):
        weight = {s: s % 4 + 1 for s in own["subset"]} if sized else None
        want = C.greedy_cover(own["hook"].to_numpy(), own["subset"].to_numpy(), limit, weight)
        got = own[own["place"] > 0].drop_duplicates(["subset", "place"]).sort_values("place")
        assert got["subset"].tolist() == want and got["place"].tolist() == list(range(1, len(want) + 1))
    assert len(C.greedy_covers(np.array([], int), np.array([], int), np.array([], int), 3)) == 0


@pytest.mark.parametrize("batch", [1, 2, 3, 7, 100])
def test_windows_stay_whole_whatever_the_batches(batch):
    rows = pd.DataFrame({"seq": [1] * 5 + [2] + [3] * 9 + [3] * 2 + [4], "trace": ["a"] * 15 + ["b"] * 2 + ["a"], "x": range(18)})
    parts = list(C.whole_windows(rows.iloc[i : i + batch] for i in range(0, 20, batch)))  # the last may be empty
    keys = [set(map(tuple, p[["seq", "trace"]].to_numpy())) for p in parts]
    assert sum(map(len, keys)) == len(set().union(*keys)) == 5  # no window in two parts
    assert pd.concat(parts)["x"].tolist() == list(range(18))


def test_numbers_stand_for_ids(spark):
    df = spark.createDataFrame([(c,) for c in ["", "abc", "0:1", "7:0", None, *map(str, range(200))]], "c string")
    both = df.select(I.content_id(F.col("c")).alias("text"), I.content_number(F.col("c")).alias("n"))
    rows = both.select("text", I.number_id(F.col("n")).alias("back"), I.is_hook(F.col("text"), 3, 3).alias("h"), I.is_hook_number(F.col("n"), 3, 3).alias("hn"), I.is_hook(F.col("text"), 0, 2).alias("z"), I.is_hook_number(F.col("n"), 0, 2).alias("zn")).collect()
    assert all(r.text == r.back and r.h == r.hn and r.z == r.zn for r in rows) and sum(r.h for r in rows) > 9
    assert spark.range(1).select(I.number_id(F.lit(10)).alias("x")).first().x == "00:00:00:00:00:0a"


@pytest.mark.parametrize("spread", [False, True])
def test_snapshot_ids_of_any_key(spark, tmp_path, spread):
    keys = [*range(-9, 12), None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.version, r.pos): r.chunk_id for r in T.snapshot_trace(spark, str(tmp_path), 7, spread=spread).collect()}
    assert len(got) == 7 * len(keys) and all(got.pop((v, None)) is None for v in range(7))
    for (v, k), text in got.items():
        state = (v + (k % 5 if k >= 0 else -(-k % 5))) // 5
        assert text.replace(":", "") == hashlib.md5(f"{k}:{state}".encode()).hexdigest()[:12]


def test_stored_chunks_apart_give_the_same_hooks(spark):
    rows = spark.range(400).select(
        F.lit("t").alias("trace"), F.floor(F.col("id") / 100).cast("int").alias("version"), I.content_id((F.col("id") % 150).cast("string")).alias("chunk_id"), (F.col("id") >= 150).alias("is_dup"),
        F.floor(F.col("id") % 150 / 16).alias("location"), F.floor(F.col("id") / 8).alias("recipe_id"), F.when(F.col("id") < 150, F.col("id")).alias("ord"))
    want = H.build_hybrid_hooks(rows, 2, 2, ratio=3)
    got = H.split_hybrid_hooks(rows.drop("location", "ord", "is_dup"), rows.where("not is_dup"), I.is_hook(F.col("chunk_id"), 2, 2), I.sample_position(F.col("ord"), 3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 200


def test_hybrid_hooks_look_up_no_container(spark, sf):
    assert joins_by_id(Q.hybrid_hooks(spark, sf)) == 0


def test_hits_meet_each_indexed_id_once(spark, sf):
    assert joins_by_id(Q.hook_hits_distinct(spark, sf)) == 1


@pytest.mark.parametrize("name", ["select_hybrid_basic", "select_hybrid_dense"])
def test_hybrid_selections_take_many_windows_at_once(spark, sf, name):
    text = plan(getattr(Q, name)(spark, sf))
    assert "MapInPandas" in text and "FlatMapGroupsInPandas" not in text and joins_by_id(getattr(Q, name)(spark, sf)) == 1

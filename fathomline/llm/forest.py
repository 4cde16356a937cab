"""Operator 5, embedding near-duplicates by a forest of random-projection trees.

Each tree splits recursively at the median of a random projection; vectors within the spill margin of a split go to
both sides. Trees are fitted on a sample that grows with the data up to ``MAX_FIT`` vectors (``fit_rows`` sets it), but
every vector is routed to leaves. Vectors that share a leaf and a label are compared by their exact cosine, and a pair
is counted only in the first leaf that both reach, so the counts are those of the union over all trees. Equal vectors
of a label are collapsed first and counted by their number.

Dense groups, which no projection splits, are not compared pair by pair: every leaf of more than ``BLOCK`` vectors names
a representative, and vectors within half the threshold's angle of it are its members. Any two members of a
representative link for sure, so they are counted by their number and joined by one edge each. What is left in a large
leaf is cut into blocks; pairs of blocks are separate tasks, and two blocks of the same members are never one. A leaf
returns a row per linked vector (its count and the smallest id of its linked group in the leaf), never the pairs.

A pair at cosine ``threshold`` differs along a random direction by ``sqrt(2 - 2 * threshold) / sqrt(dims)`` on
average; the margin is ``spill`` times that. Vectors link with nothing if they, their label or a component are null, a
component is not finite, or they are zero; they stay as rows of their own. Vectors are scaled by their largest component
before norms are taken, so none over- or underflows. Vectors of different lengths never link. Repeated rows are vectors
of their own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.common import linked_components, materialize, table

TREES, LEAF, SPILL, BLOCK = 6, 256, 0.75, 2048
#: The sample has at least the first number of vectors (all, if fewer), one in 64 of them, and at most the second number.
LEAST_FIT, MAX_FIT, LEAST_IN_LEAF = 20_000, 200_000, 4
#: Projections tried for a split, and the largest share of vectors (counted on both sides) with which a split pays.
TRIES, MAX_SPILL = 4, 1.4


class Tree:
    """Flat arrays of one tree's inner nodes: direction, split, and the nodes on both sides (negative: leaf -1 - n)."""

    def __init__(self, sample: np.ndarray, leaf: int, margin: float, rng: np.random.Generator):
        self.direction, self.split, self.sides, self.margin, self.leaves = [], [], [], margin, 0
        self.root = self._grow(sample, leaf, rng, 0)

    def _grow(self, rows: np.ndarray, leaf: int, rng: np.random.Generator, depth: int) -> int:
        best = None
        for _ in range(TRIES if len(rows) > leaf and depth < 40 else 0):
            direction = rng.standard_normal(rows.shape[1])
            direction /= np.linalg.norm(direction)
            p = rows @ direction
            cut = float(np.median(p))
            left, right = p < cut + self.margin, p >= cut - self.margin
            spilled = (int(left.sum()) + int(right.sum())) / len(rows)
            if best is None or spilled < best[0]:
                best = spilled, direction, cut, left, right
            if spilled < 1.25:
                break
        if best is None or best[0] > MAX_SPILL:  # small enough, or a dense group that no projection splits
            self.leaves += 1
            return -self.leaves
        _, direction, cut, left, right = best
        me = len(self.split)
        self.direction.append(direction), self.split.append(cut), self.sides.append([0, 0])
        self.sides[me] = [self._grow(rows[left], leaf, rng, depth + 1), self._grow(rows[right], leaf, rng, depth + 1)]
        return me

    def route(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf for every leaf that a row reaches."""
        out, todo = [], [(self.root, np.arange(len(rows)))]
        while todo:
            node, mine = todo.pop()
            if node < 0:
                out.append((mine, np.full(len(mine), -1 - node)))
            elif len(mine):
                p = rows[mine] @ self.direction[node]
                todo += [(self.sides[node][0], mine[p < self.split[node] + self.margin]), (self.sides[node][1], mine[p >= self.split[node] - self.margin])]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def grow_forest(sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, threshold: float = 0.98, spill: float = SPILL, seed: int = 7) -> list[Tree]:
    """Trees whose leaves hold about ``leaf`` of ``total`` vectors."""
    margin = spill * np.sqrt((2 - 2 * threshold) / sample.shape[1])
    size = max(LEAST_IN_LEAF, int(leaf * len(sample) / max(total, 1)))
    return [Tree(sample, size, margin, np.random.default_rng([seed, t])) for t in range(trees)]


def _units(column: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length one; their largest component is made 1 first."""
    x = column.flatten().to_numpy().reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _earlier(leaves: pa.ListArray, here: int) -> np.ndarray:
    """For each row, the leaves before this one as packed bits."""
    spots, row = leaves.flatten().to_numpy(), np.repeat(np.arange(len(leaves)), leaves.value_lengths().to_numpy())
    early, at = np.unique(spots[spots < here], return_inverse=True)
    member = np.zeros((len(leaves), len(early)), dtype=bool)
    member[row[spots < here], at] = True
    return np.packbits(member, axis=1)


def leaf_links(ids: np.ndarray, copies: np.ndarray, rows: np.ndarray, leaves: pa.ListArray, here: int, side: np.ndarray | None, group: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors with a link in this leaf, how many vectors they meet here first, and the smallest id of their linked group.

    ``rows`` have length one. ``side`` splits the rows of two blocks, of which only mixed pairs count; None compares all
    rows. Rows of one ``group`` (-1: none) are known to link and are left out.
    """
    n, member = len(ids), None
    found, count, label = [], np.zeros(n, dtype=np.int64), np.arange(n)
    for a in range(0, n, 256):
        b = min(a + 256, n)
        i, j = np.nonzero(rows[a:b] @ rows.T >= threshold)
        i = i + a
        ok = (i < j if side is None else side[i] < side[j]) & ((group[i] != group[j]) | (group[i] < 0))
        i, j = i[ok].astype(np.int32), j[ok].astype(np.int32)
        if not len(i):
            continue
        found.append((i, j))
        member = _earlier(leaves, here) if member is None else member
        first = ~(member[i] & member[j]).any(1)
        count += np.bincount(i[first], copies[j[first]], n).astype(np.int64) + np.bincount(j[first], copies[i[first]], n).astype(np.int64)
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(np.argsort(ids, kind="stable"))  # labels in order of ids
    label = order.copy()
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            break
    touched = np.unique(np.concatenate([i, j]))
    return ids[touched], count[touched], np.sort(ids)[label[touched]]


def _members(placed: DataFrame, nodes: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """``id, ball``: vectors within half the threshold's angle of the representative of a large leaf, each with the smallest such one."""
    half = float(np.cos(np.arccos(threshold) / 2)) + 1e-9  # of two members, each may err by rounding
    sizes = placed.groupBy(*key).agg(F.count("*").alias("count"), F.min_by("id", F.xxhash64("id")).alias("ball")).where(F.col("count") > BLOCK)
    centres = sizes.join(nodes.select(F.col("id").alias("ball"), F.col("x").alias("centre")), "ball").select(*key, "ball", "centre")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                dims = np.array([len(v) for v in batch.column("x")])
                for d in np.unique(dims):
                    part = batch.take(pa.array(np.flatnonzero(dims == d)))
                    close = (_units(part.column("x")) * _units(part.column("centre"))).sum(1) >= half
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(close)) for c in (part.column("id"), part.column("ball"))], names=["id", "ball"])

    found = placed.join(centres, key).select("id", "ball", "x", "centre").mapInArrow(near, "id long, ball long")
    return found.groupBy("id").agg(F.min("ball").alias("ball"))


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows cut into their groups of equal ``key``; at most one group is held over from batch to batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        whole = pa.concat_batches([held[-1].slice(len(held[-1]) - 1), batch]) if held else batch
        columns = [whole.column(c) for c in key]
        change = np.zeros(len(whole) - 1, dtype=bool)
        for c in columns:
            change |= pc.not_equal(c.slice(1), c.slice(0, len(whole) - 1)).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(change) + 1 - (1 if held else 0)  # positions in ``batch`` where a group starts
        at = 0
        for end in ends.tolist():
            held.append(batch.slice(at, end - at))
            yield pa.concat_batches(held)
            held, at = [], end
        held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)


def _compare(batches: Iterator[pa.RecordBatch], key: list[str], threshold: float) -> Iterator[pa.RecordBatch]:
    """``id, links, root`` of the linked vectors of each group of ``key``; small leaves are far too many for a call each."""
    for group in _runs(batches, key):
        if len(group) < 2:
            continue
        lo, hi, here = (group.column(c)[0].as_py() for c in ("lo", "hi", "leaf"))
        k, inner = group.column("k").to_numpy(), group.column("is_inner").to_numpy(zero_copy_only=False)
        side = None if lo == hi else inner if hi < 0 else k == hi
        ids, copies, ball = (group.column(c).to_numpy() for c in ("id", "copies", "ball_id"))
        found = leaf_links(ids, copies, _units(group.column("x")), group.column("leaves"), here, side, ball, threshold)
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["id", "links", "root"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, trees: int = TREES, leaf: int = LEAF, fit_rows: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors (vec_id, embedding, label)``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    usable = F.coalesce(finite & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = rows.withColumn("x", F.when(usable, F.col("x")))
    nodes = rows.where("x is not null").groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")  # written once, so ids stay; one vec_id may have several vectors
    sizes = {r[0]: r[1] for r in nodes.groupBy(F.size("x")).count().collect()}  # one row for each length of vectors
    forests = {}
    for dims, total in sizes.items():
        wanted = fit_rows or min(MAX_FIT, max(LEAST_FIT, total // 64))
        share = min(1.0, wanted / total)
        chosen = nodes.where(F.size("x") == dims).where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("x").orderBy(F.xxhash64("x")).limit(wanted)
        forests[dims] = grow_forest(_units(chosen.toArrow().column("x").combine_chunks()), total, trees, leaf, threshold)  # at most ``wanted`` vectors
    sent = spark.sparkContext.broadcast(forests)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(v) for v in batch.column("x")])
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = _units(part.column("x"))
                reached, base = [], 0
                for tree in sent.value[int(d)]:
                    who, leaf_no = tree.route(x)
                    reached.append((who, leaf_no + base))
                    base += tree.leaves
                who, spot = (np.concatenate(c) for c in zip(*reached, strict=True))
                order = np.lexsort((spot, who))
                who, spot = who[order], spot[order]
                ends = np.searchsorted(who, np.arange(len(part)), side="right")
                leaves = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(spot, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, leaves], names=[*part.schema.names, "leaves"])

    with_leaves = T.StructType(list(nodes.schema.fields)).add("leaves", T.ArrayType(T.IntegerType()))
    routed = materialize(nodes.mapInArrow(route, with_leaves).withColumn("dims", F.size("x")), "routed")
    placed = routed.withColumn("leaf", F.explode("leaves"))
    key = ["label", "dims", "leaf"]
    members = materialize(_members(placed, nodes, key, threshold), "members")
    grouped = routed.join(members, "id", "left").withColumn("leaf", F.explode("leaves"))
    # In a large leaf the commonest group is the inner side, all other rows the outer one; inner blocks only meet outer ones.
    parts = grouped.groupBy(*key, "ball").agg(F.count("*").alias("n"))
    sizes = parts.groupBy(*key).agg(F.sum("n").alias("n"), F.max(F.when(F.col("ball").isNotNull(), F.struct("n", "ball"))).alias("inner")).where(F.col("n") > BLOCK)
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    inner_n = F.coalesce("inner.n", F.lit(0))
    large = materialize(sizes.select(*key, F.col("inner.ball").alias("inner"), blocks(inner_n).alias("bi"), blocks(F.col("n") - inner_n).alias("bo")), "large_leaves")
    cut = grouped.join(large, key, "left").withColumn("is_inner", F.coalesce(F.col("ball") == F.col("inner"), F.lit(False)))
    own = F.when(F.col("is_inner"), F.col("bi")).otherwise(F.coalesce("bo", F.lit(1)))
    cut = cut.withColumn("k", F.pmod(F.xxhash64("id"), F.greatest(own, F.lit(1)).cast("long")).cast("int"))
    outer = F.sequence(F.lit(0), F.greatest(F.coalesce("bo", F.lit(1)) - 1, F.lit(0)))
    with_outer = F.when(F.coalesce("bo", F.lit(1)) > 0, F.transform(outer, lambda j: F.struct(F.least(F.col("k"), j).alias("lo"), F.greatest(F.col("k"), j).alias("hi"))))
    with_inner = F.when(F.coalesce("bi", F.lit(0)) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("bi") - 1, F.lit(0))), lambda j: F.struct(F.col("k").alias("lo"), (-1 - j).alias("hi"))))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    inner_pairs = F.when(F.col("bo") > 0, F.transform(outer, lambda j: F.struct(j.alias("lo"), (F.lit(-1) - F.col("k")).alias("hi"))))
    pair = F.when(F.col("is_inner"), F.coalesce(inner_pairs, none)).otherwise(F.concat(F.coalesce(with_outer, none), F.coalesce(with_inner, none)))
    tasks = cut.withColumn("pair", F.explode(pair)).select(F.col("label").cast("string").alias("label"), "dims", "leaf", "pair.lo", "pair.hi", "k", "is_inner", "id", "copies", "x", "leaves", F.coalesce("ball", F.lit(-1)).alias("ball_id"))

    task = [*key, "lo", "hi"]
    sorted_tasks = tasks.repartition(*task).sortWithinPartitions(*task)
    linked = materialize(sorted_tasks.mapInArrow(lambda batches: _compare(batches, task, threshold), "id long, links long, root long"), "links")
    sizes = members.join(nodes.select("id", "copies"), "id").groupBy("ball").agg(F.sum("copies").alias("held"))
    balls = members.join(sizes, "ball").select("id", "ball", "held")
    comps = linked_components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(members.select(F.col("id").alias("a"), F.col("ball").alias("b"))))
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    others = F.coalesce("links", F.lit(0)) + F.coalesce("held", "copies") - 1
    facts = nodes.join(counts, "id", "left").join(balls, "id", "left").join(comps, "id", "left").select("label", "x", "least", others.alias("n_links"), F.coalesce("component_id", "id").alias("root"))
    facts = materialize(facts, "facts")
    smallest = facts.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = facts.join(smallest, "root").select("label", "x", "n_links", "component_id")
    out = rows.join(facts, ["label", "x"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

"""Partitioned exact store with Bloom filters: routing, filters, probes and filter loads.

Hashes wrap at 64 and 32 bits, which SQL arithmetic refuses, so they are numpy over whole columns. Each partition is
a unit of work: ``partitions_for`` gives more partitions, not larger ones, as the data grow, so that a partition holds
about ``FILTERS`` filters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from fathomline.functions.storage import stored
from fathomline.functions.workers import workers_import_package
from fathomline.operators.exact import pack_partitioned, unique_chunks
from fathomline.operators.ordinals import SPAN

# 64-bit FNV-1a, and seed and constants of the chained 32-bit Bloom hash.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
BLOOM_SEED, BLOOM_MUL, BLOOM_SHIFT = 0xBC9F1D34, 0xC6A4A793, 24


FILTERS = 64


def partitions_for(chunks: DataFrame, container_size: int) -> int:
    """Hash partitions for the stored chunks of the largest trace."""
    most = chunks.groupBy("trace").agg(F.countDistinct("chunk_id").alias("n")).agg(F.max("n")).first()[0] or 0
    return most // (container_size * FILTERS) + 1


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """Number of hashes and of bits for ``n`` ids at false-positive share ``p``."""
    k = int(-math.log(p) / math.log(2))
    return k, int(k * n / math.log(2))


def _bytes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as a zero-padded byte matrix, and their lengths."""
    raw = np.array([i.encode() for i in ids], dtype=bytes)
    width = max(raw.dtype.itemsize, 1)
    return raw.view(np.uint8).reshape(len(raw), width), np.char.str_len(raw)


def fnv1a(ids: np.ndarray) -> np.ndarray:
    matrix, size = _bytes(ids)
    h = np.full(len(ids), FNV_BASIS, dtype=np.uint64)
    for i in range(matrix.shape[1]):
        h = np.where(i < size, (h ^ matrix[:, i].astype(np.uint64)) * np.uint64(FNV_PRIME), h)
    return h


def bloom_bits(ids: np.ndarray, k: int, m: int) -> np.ndarray:
    """Bit positions of each id, one column per hash; every hash is seeded by the one before."""
    matrix, size = _bytes(ids)
    out, seed = np.empty((len(ids), k), dtype=np.int64), np.full(len(ids), BLOOM_SEED, dtype=np.uint32)
    mul, sizes = np.uint32(BLOOM_MUL), size.astype(np.uint32)
    for j in range(k):
        h = seed ^ (sizes * mul)
        for n in np.unique(size):
            mine = size == n
            own, bytes_ = h[mine], matrix[mine].astype(np.uint32)
            for at in range(0, n - n % 4, 4):
                word = bytes_[:, at] | bytes_[:, at + 1] << 8 | bytes_[:, at + 2] << 16 | bytes_[:, at + 3] << 24
                own = (own + word) * mul
                own ^= own >> np.uint32(16)
            if n % 4:
                for shift in range(n % 4):
                    own = own + (bytes_[:, n - n % 4 + shift] << np.uint32(8 * shift))
                own = own * mul
                own ^= own >> np.uint32(BLOOM_SHIFT)
            h[mine] = own
        seed = h
        out[:, j] = h % np.uint32(m)
    return out


def hash_partition(df: DataFrame, n: int, col: str = "chunk_id") -> DataFrame:
    """Add ``part``: the FNV-1a hash of the id modulo ``n``; a null id has a null partition."""
    workers_import_package(df.sparkSession)

    @pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = pd.Series(pd.NA, index=ids.index, dtype="Int32")
        if known.any():
            out[known] = (fnv1a(ids[known].to_numpy()) % np.uint64(n)).astype(np.int32)
        return out

    return df.withColumn("part", part(F.col(col)))


def partitioned_store(chunks: DataFrame, n_parts: int, container_size: int) -> DataFrame:
    """Stored chunks with their partition and the filter (one per container) that holds them: ``trace, part, bf_no, slot, chunk_id, version, pos``."""
    packed = pack_partitioned(hash_partition(unique_chunks(chunks), n_parts), container_size)
    return packed.select("trace", "part", F.col("container_id").alias("bf_no"), "slot", "chunk_id", "version", "pos")


def bloom_build(store: DataFrame, n: int, p: float = 0.001) -> DataFrame:
    """``trace, part, bf_no, members, bits``: the filter of every container."""
    k, m = bloom_size(n, p)

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros((m + 7) // 8 * 8, dtype=np.uint8)
        bits[bloom_bits(rows["chunk_id"].to_numpy(), k, m).ravel()] = 1
        return pd.DataFrame({"trace": [key[0]], "part": [key[1]], "bf_no": [key[2]], "members": [len(rows)], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    return store.select("trace", "part", "bf_no", "chunk_id").groupBy("trace", "part", "bf_no").applyInPandas(build, "trace string, part int, bf_no long, members long, bits binary")


def bloom_probe(ids: DataFrame, bloom: DataFrame, n: int, p: float = 0.001) -> DataFrame:
    """``trace, part, chunk_id, bf_no`` of every filter of an id's partition that may hold it; ``ids``: ``trace, part, chunk_id``."""
    k, m = bloom_size(n, p)
    workers_import_package(ids.sparkSession)

    def probe(key: tuple, asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        names, found = asked["chunk_id"].to_numpy(), [pd.DataFrame({"chunk_id": [], "bf_no": []})]
        if len(asked) and len(filters):
            at = bloom_bits(names, k, m)
            for bf, raw in zip(filters["bf_no"], filters["bits"], strict=True):
                flat = np.frombuffer(raw, dtype=np.uint8)
                hit = (flat[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)
                found.append(pd.DataFrame({"chunk_id": names[hit], "bf_no": bf}))
        out = pd.concat(found)
        return out.assign(trace=key[0], part=key[1])[["trace", "part", "chunk_id", "bf_no"]].astype({"bf_no": "int64", "part": "int32"})

    asked = ids.select("trace", "part", "chunk_id").distinct().groupBy("trace", "part")
    return asked.cogroup(bloom.select("trace", "part", "bf_no", "bits").groupBy("trace", "part")).applyInPandas(probe, "trace string, part int, chunk_id string, bf_no long")


def bloom_matches(store: DataFrame, n: int, p: float = 0.001) -> DataFrame:
    """``trace, part, chunk_id, bf_no, since``: from which insertion (its place in the partition) a filter matches an id.

    For every filter, the time at which each bit is first set; an id matches after the latest of its bits. Only true
    members and false positives are returned.
    """
    k, m = bloom_size(n, p)

    def match(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["version", "pos"])
        bits, never = bloom_bits(rows["chunk_id"].to_numpy(), k, m), len(rows)
        found = []
        for bf in np.unique(rows["bf_no"]):
            mine = np.flatnonzero(rows["bf_no"].to_numpy() == bf)
            first = np.full(m, never, dtype=np.int64)
            np.minimum.at(first, bits[mine].ravel(), np.repeat(mine, k))
            for at in range(0, len(rows), 65536):  # bounds the gathered matrix
                since = first[bits[at : at + 65536]].max(axis=1)
                hit = np.flatnonzero(since < never)
                found.append(pd.DataFrame({"i": hit + at, "bf_no": bf, "since": since[hit]}))
        out = pd.concat(found)
        ids, versions, places = rows["chunk_id"].to_numpy(), rows["version"].to_numpy(), rows["pos"].to_numpy()
        return pd.DataFrame({"trace": key[0], "part": key[1], "chunk_id": ids[out["i"]], "bf_no": out["bf_no"].to_numpy(), "since_version": versions[out["since"]], "since_pos": places[out["since"]]})

    schema = "trace string, part int, chunk_id string, bf_no long, since_version int, since_pos long"
    return store.select("trace", "part", "bf_no", "chunk_id", F.col("version").cast("int").alias("version"), F.col("pos").cast("long").alias("pos")).groupBy("trace", "part").applyInPandas(match, schema)


def bloom_loads(chunks: DataFrame, store: DataFrame, n: int, cache: int = 1, p: float = 0.001, span: int = SPAN) -> DataFrame:
    """``trace, part, version, pos, bf_no, load``: filters that match each arriving chunk, and whether one had to be loaded.

    A chunk probes all filters of its partition in their order before it is stored. With a cache of one filter a
    match loads unless it repeats the one before; with more, unless it is among the last ``cache`` different ones.

    A partition is cut into blocks of ``span`` places in the trace. What is cached behind a block follows from the last ``cache`` different
    filters in it and before it, a short row for each block, so the blocks themselves are walked apart and a hot id's repeats are dealt
    over all of them.
    """
    homes = store.select("trace", "chunk_id", "part")
    matches = bloom_matches(store, n, p).drop("part")
    probes = chunks.join(homes, ["trace", "chunk_id"]).join(matches, ["trace", "chunk_id"])
    after = (F.col("since_version") < F.col("version")) | ((F.col("since_version") == F.col("version")) & (F.col("since_pos") < F.col("pos")))
    of, columns = ["trace", "part", "version", "block"], ["trace", "part", "version", "pos", "bf_no"]
    hits = stored(probes.where(after).select(*columns, F.floor(F.col("pos") / span).alias("block")), "filter_hits")
    if cache == 1:
        last = hits.groupBy(*of).agg(F.max_by("bf_no", F.struct("pos", "bf_no")).alias("last"))
        before = last.withColumn("before", F.lag("last").over(Window.partitionBy("trace", "part").orderBy("version", "block"))).drop("last")
        own = Window.partitionBy(*of).orderBy("pos", "bf_no")
        prior = F.when(F.row_number().over(own) == 1, F.col("before")).otherwise(F.lag("bf_no").over(own))
        return hits.join(before, of).select(*columns, (~F.col("bf_no").eqNullSafe(prior)).alias("load"))
    touched = hits.groupBy(*of, "bf_no").agg(F.max("pos").alias("at"))
    latest = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("at"), F.desc("bf_no")))
    ends = touched.withColumn("nth", latest).where(F.col("nth") <= cache).groupBy(*of).agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "bf_no"))), lambda r: r["bf_no"]).alias("recent"))

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, cached = None, []
        for rows in batches:
            before = []
            for at, recent in zip(zip(rows["trace"], rows["part"], strict=True), rows["recent"], strict=True):
                if at != here:
                    here, cached = at, []
                before.append(cached)
                own = [int(x) for x in recent]
                cached = [*own, *(x for x in cached if x not in own)][:cache]
            yield rows[of].assign(before=before)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, recent = None, {}
        for rows in batches:
            load = []
            for at, bf, before in zip(zip(*(rows[c] for c in of), strict=True), rows["bf_no"].tolist(), rows["before"], strict=True):
                if at != here:
                    here, recent = at, dict.fromkeys(int(x) for x in reversed(before))
                load.append(bf not in recent)
                recent.pop(bf, None)
                recent[bf] = None
                if len(recent) > cache:
                    del recent[next(iter(recent))]
            yield rows[columns].assign(load=load)

    states = ends.repartition("trace", "part").sortWithinPartitions("trace", "part", "version", "block").mapInPandas(carry, "trace string, part int, version int, block long, before array<long>")
    dealt = hits.join(states, of).repartition(*of).sortWithinPartitions(*of, "pos", "bf_no")
    return dealt.mapInPandas(walk, "trace string, part int, version int, pos long, bf_no long, load boolean")


def bloom_report(chunks: DataFrame, store: DataFrame, loads: DataFrame, n: int, p: float = 0.001, partitions: int = 0, cache: int = 1) -> DataFrame:
    """Partitions and cached filters; per version and so far: stored chunks, kilobytes of filters (bits / 8, per filter in use), loads, rate."""
    _, m = bloom_size(n, p)
    totals = chunks.groupBy("trace", "version").agg(F.count("*").alias("total"))
    new = store.groupBy("trace", "version").agg(F.count("*").alias("stored"), F.count_if(F.col("slot") == 0).alias("new_filters"))
    io = loads.groupBy("trace", "version").agg(F.count_if("load").alias("loads"))
    per = totals.join(new, ["trace", "version"], "left").join(io, ["trace", "version"], "left").fillna(0)
    so_far = Window.partitionBy("trace").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    for c in ("total", "stored", "new_filters", "loads"):
        per = per.withColumn(f"all_{c}", F.sum(c).over(so_far))
    size = (m + 7) // 8 / 8.0
    return per.select(
        "trace", "version", F.lit(partitions).alias("partitions"), F.lit(cache).alias("bf_cache"), "total", "stored", (F.col("new_filters") * size).alias("filter_size"), "loads", "all_total", "all_stored",
        (F.col("all_new_filters") * size).alias("all_filter_size"), "all_loads",
        F.round(F.try_divide(F.col("total").cast("double"), F.col("stored").cast("double")), 6).alias("dedup_rate"),
        F.round(F.try_divide(F.col("all_total").cast("double"), F.col("all_stored").cast("double")), 6).alias("all_dedup_rate"),
    )


def bloom_fpp(store: DataFrame, bloom: DataFrame, n: int, p: float = 0.001) -> DataFrame:
    """``trace, probes, false_matches, share``: stored ids against the filters of other containers of their partition."""
    hits = bloom_probe(store, bloom, n, p).join(store.select("trace", "chunk_id", F.col("bf_no").alias("own")), ["trace", "chunk_id"])
    false = hits.where("bf_no <> own").groupBy("trace").agg(F.count("*").alias("false_matches"))
    filters = bloom.groupBy("trace", "part").agg(F.count("*").alias("f"), F.sum("members").alias("s"))
    probes = filters.groupBy("trace").agg(F.sum((F.col("f") - 1) * F.col("s")).alias("probes"))
    return probes.join(false, "trace", "left").fillna(0, ["false_matches"]).withColumn("share", F.try_divide(F.col("false_matches").cast("double"), F.col("probes").cast("double")))

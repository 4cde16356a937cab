"""Operator 11, periodic run detection by scale-tiled distribution.

A run of period ``q`` is at least four periods long, so at the scale of its octave (``P <= q < 2P``, ``P`` a power of two)
every multiple of ``P`` inside it is a boundary with room on a side. A document is exploded into overlapping tiles for
each octave: two scales before a boundary, four behind it. A tile is solved by itself: for each period of the octave, how
far do the words on both sides of the boundary equal those a period further? Most comparisons fail at the first words and are
made for all tiles at once; a tile where one does not fail within ``REACH`` words gets Z-functions from its boundary, forwards
and backwards, in time linear in the tile. What a tile has found is a fragment of an interval. Fragments are shuffled by
document and period and stitched; an interval that a smaller period also fills belongs to that one.

Tiles of a text up to ``LONG`` bytes are solved where the text is read; those of a longer one are dealt over all tasks, with
the ids of their words. Words that equal each other in a document share an id, whatever their number.

Nulls and edges: a null or empty text has no words and no runs. A null ``doc_id`` is kept, and its words are not altered.
Repeated rows give equal rows, an empty table none; other columns are ignored, whatever their names. Of runs with the same
exponent the smaller start comes first, then the smaller period.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.llm.common import materialize, table, text_or_empty

#: Runs are at least so many words and so many periods long.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words compared for all tiles at once before a tile gets its Z-functions.
REACH = 32
#: Words whose tiles are solved together.
GROUP = 1 << 16
#: Texts of more bytes have their tiles dealt over all tasks.
LONG = 4 << 20
#: Words of a document for each row of dealt tiles; octaves above a sixteenth of it have rows of their own.
SPREAD = 1 << 18
#: Up to this number of runs they are sent to the documents (40 bytes each); beyond it both are shuffled.
MAX_SENT_RUNS = 500_000

FRAGMENT = "doc_id long, key long, period long, start long, end long"
Alteration = Callable[[int, int], tuple[int, int] | None]


def periodic_tail(doc_id: int, n: int) -> tuple[int, int] | None:
    """Where the words of every tenth document begin to repeat, and with what period."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def altered_order(doc_id: int | None, n: int, alter: Alteration | None) -> np.ndarray | None:
    """Which word stands at each place, if not its own."""
    change = alter(doc_id, n) if alter and doc_id is not None else None
    if change is None:
        return None
    a, p = change
    order = np.arange(n)
    order[a:] = a + np.arange(n - a) % p
    return order


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers below their count."""
    last = dict(zip(words, range(len(words)), strict=True))
    return np.fromiter(map(last.__getitem__, words), np.int32, len(words))


def z_function(s: list[int]) -> list[int]:
    """For each place, how long what begins there equals the beginning."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _tile(ids: np.ndarray, b: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periods of the octave, and how far each holds before and behind the boundary ``b``, at most two scales, by Z-functions."""
    n, before = len(ids), max(0, b - 2 * scale)
    q = np.arange(scale, min(2 * scale, n - b))
    ahead = np.array(z_function(ids[b : b + 4 * scale].tolist()), dtype=np.int64)[q]
    end = min(n, b + 2 * scale - 1)
    back, over = ids[before:b][::-1].tolist(), ids[before:end][::-1].tolist()
    behind = np.array(z_function([*back, -1, *over]), dtype=np.int64)[len(back) + 1 + end - b - q]
    return q, np.minimum(behind, 2 * scale), np.minimum(ahead, 2 * scale)


def _filled(known: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the words of each tile lie inside one of the known fragments, which are in order of their start."""
    if not len(known):
        return np.zeros(len(begin), dtype=bool)
    furthest = np.maximum.accumulate(known[:, 1] + known[:, 2])
    at = np.searchsorted(known[:, 0], begin, "right") - 1
    return (at >= 0) & (furthest[at] >= end)


def _octave(ids: np.ndarray, scale: int, first: int, last: int, known: np.ndarray) -> np.ndarray:
    """Fragments ``start, end, period`` (columns): words from start to end equal those a period further. Boundaries are the multiples of ``scale`` in ``first..last``.

    ``known``: all those of smaller octaves, or none. A tile inside one of them repeats with a smaller period, so it has no run of its own.
    """
    n, far = len(ids), 2 * scale
    b = np.arange(-(-first // scale) * scale, min(last, n - scale), scale)
    if not len(b):
        return np.empty((0, 3), dtype=np.int64)
    w = np.concatenate([[-1], ids, np.full(3 * scale, -2)])  # w[i + 1] is word i; either end differs from every word
    size = len(b) * scale
    ahead = w[b[0] + scale + 1 :][:size].reshape(-1, scale) == w[b + 1][:, None]
    behind = w[b[0] + scale :][:size].reshape(-1, scale) == w[b][:, None]
    open_ = ~_filled(known, np.maximum(b - far, 0), np.minimum(b + 2 * far, n))
    at = np.flatnonzero((ahead | behind) & open_[:, None])
    tile, q = at // scale, at % scale + scale
    reach, limit = {}, min(REACH, far)
    for name, hit, step in (("ahead", ahead, 1), ("behind", behind, -1)):
        held = np.zeros(len(at), dtype=np.int64)
        live = np.flatnonzero(hit.ravel()[at])
        here, t = b[tile] + (step > 0), 1
        held[live] = 1
        while t < limit and len(live):
            live = live[w[here[live] + step * t] == w[here[live] + q[live] + step * t]]
            held[live] += 1
            t += 1
        reach[name] = held
    if limit == far:
        near, on = reach["behind"], reach["ahead"]
        keep = near + on >= far
        start, end, q = (b[tile] - near)[keep], (b[tile] + on)[keep], q[keep]
        return np.stack([start, end, q], axis=1)
    found = [np.empty((0, 3), dtype=np.int64)]
    for k in np.unique(tile[(reach["ahead"] == limit) | (reach["behind"] == limit)]):
        q, near, on = _tile(ids, int(b[k]), scale)
        keep = near + on >= far
        found.append(np.stack([b[k] - near[keep], b[k] + on[keep], q[keep]], axis=1))
    return np.concatenate(found)


def stitch(fragments: np.ndarray, whole: bool = True) -> np.ndarray:
    """Fragments of a period that meet or overlap become one; in a whole document, of those that fill the same words the smallest period stays."""
    if not len(fragments):
        return fragments
    f = fragments[np.lexsort((fragments[:, 0], fragments[:, 2]))]
    end = f[:, 1] + f[:, 2] * (1 << 40)  # the running end restarts with each period
    before = np.concatenate([[-1], np.maximum.accumulate(end)[:-1]])
    first = np.flatnonzero(f[:, 0] + f[:, 2] * (1 << 40) > before)
    joined = np.stack([f[first, 0], np.maximum.reduceat(f[:, 1], first), f[first, 2]], axis=1)
    if not whole:
        return joined
    joined = joined[np.lexsort((joined[:, 2], joined[:, 1] + joined[:, 2], joined[:, 0]))]
    stretch = joined[:, 1] + joined[:, 2]
    return joined[np.concatenate([[True], (joined[1:, 0] != joined[:-1, 0]) | (stretch[1:] != stretch[:-1])])]


def solve(ids: np.ndarray, longest: int, first: int = 0, last: int | None = None, octaves: tuple[int, int] = (0, 63)) -> np.ndarray:
    """Stitched fragments of the tiles whose boundaries are in ``first..last``, of all octaves that a document of ``longest`` words can hold.

    Whole documents (no ``last``) spare what a smaller period fills; in a part of one, its extent is not known.
    """
    none = found = np.empty((0, 3), dtype=np.int64)
    k, whole = octaves[0], last is None
    while k <= octaves[1] and LEAST_PERIODS << k <= longest:
        more = _octave(ids, 1 << k, first, len(ids) if whole else last, found if whole else none)
        if whole:
            more = more[~_filled(found, more[:, 0], more[:, 1] + more[:, 2])]
        found = stitch(np.concatenate([found, more]), whole) if len(more) else found
        k += 1
    return found


def _documents(batches: Iterator[pa.RecordBatch], alter: Alteration | None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    for batch in batches:
        for doc_id, key, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            doc_id, words = doc_id.as_py(), text.as_py().split()  # bytes split at \x20 and \x09-\x0d only
            ids, order = word_ids(words), altered_order(doc_id, len(words), alter)
            yield doc_id, key.as_py(), ids if order is None else ids[order]


def _fragment_batch(doc_id: list, key: list, found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id, pa.int64()), pa.array(key, pa.int64()), *(pa.array(found[:, i], pa.int64()) for i in (2, 0, 1))], names=["doc_id", "key", "period", "start", "end"])


def _solved(group: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
    """Fragments of whole documents, whose words stand in one array: words of different documents get different numbers."""
    sizes = np.array([len(ids) for _, _, ids in group])
    base = np.concatenate([[0], np.cumsum(sizes)])
    found = solve(np.concatenate([ids + at for (_, _, ids), at in zip(group, base.tolist(), strict=False)]), int(sizes.max()))
    own = np.searchsorted(base, found[:, 0], "right") - 1
    found = found - base[own][:, None] * np.array([1, 1, 0])
    return _fragment_batch([group[i][0] for i in own], [group[i][1] for i in own], found)


def _dealt(rows: DataFrame, alter: Alteration | None) -> DataFrame:
    """Fragments of long documents, by rows of tiles that are dealt over all tasks."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, key, ids in _documents(batches, alter):
            low = (SPREAD >> 4).bit_length() - 1
            plans, k = [((0, low), SPREAD, SPREAD >> 2)], low + 1
            while LEAST_PERIODS << k <= len(ids):
                plans.append(((k, k), 16 << k, 4 << k))
                k += 1
            for (lowest, highest), width, margin in plans:
                for at in range(0, len(ids), width):
                    begin, end = max(0, at - margin), min(len(ids), at + width + margin)
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "key": key, "n": len(ids), "begin": begin, "first": at, "last": at + width, "lowest": lowest, "highest": highest, "ids": ids[begin:end].tobytes()}], schema=tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in map(lambda i: batch.slice(i, 1).to_pylist()[0], range(len(batch))):
                # begin is a multiple of the scales of the row, as first is
                found = solve(np.frombuffer(r["ids"], np.int32).astype(np.int64), r["n"], r["first"] - r["begin"], r["last"] - r["begin"], (r["lowest"], r["highest"]))
                yield _fragment_batch([r["doc_id"]] * len(found), [r["key"]] * len(found), found + np.array([r["begin"], r["begin"], 0]))

    names = "doc_id long, key long, n long, begin long, first long, last long, lowest int, highest int, ids binary"
    tiles = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for c in names.split(", ")])
    return rows.mapInArrow(explode, names).repartition("doc_id", "key", "lowest", "begin").mapInArrow(run, FRAGMENT)


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, key, text``: id and key, a hash of the text, stand for a row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), text_or_empty(F.col("text")).cast("binary").alias("text"))


def fragments(docs: DataFrame, alter: Alteration | None = None) -> DataFrame:
    """``doc_id, key, period, start, end`` of what the tiles of every text have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for doc in _documents(batches, alter):
            if len(doc[2]) >= LEAST_WORDS:
                group.append(doc)
                size += len(doc[2])
            if size >= GROUP:
                yield _solved(group)
                group, size = [], 0
        if group:
            yield _solved(group)

    rows = _keyed(docs)
    return rows.where(F.octet_length("text") <= LONG).mapInArrow(run, FRAGMENT).unionByName(_dealt(rows.where(F.octet_length("text") > LONG), alter))


def find_runs(docs: DataFrame, alter: Alteration | None = None) -> DataFrame:
    """``doc_id, key, runs`` of every text that has runs; ``runs``: ``start, period, length`` by start, then period."""
    of = ["doc_id", "key", "period"]
    before = Window.partitionBy(*of).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*of).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    marked = fragments(docs, alter).withColumn("apart", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    whole = marked.withColumn("island", F.sum("apart").over(so_far)).groupBy(*of, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    long = whole.withColumn("length", F.col("end") - F.col("start") + F.col("period")).where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), F.col("period") * LEAST_PERIODS))
    least = long.groupBy("doc_id", "key", "start", "length").agg(F.min("period").alias("period"))
    return least.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))  # no more runs than words


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when each of ``runs (start, period, length)`` keeps its first period."""
    step = np.zeros(n + 1, dtype=np.int64)
    for start, period, length in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step)[:n] == 0


def collapse_runs(docs: DataFrame, alter: Alteration | None = None) -> DataFrame:
    """``doc_id, runs, text`` of every row: its runs (maybe none), and its words with every run cut to its first period, one space between them."""
    runs = materialize(find_runs(docs, alter), "runs")
    few = (runs.agg(F.sum(F.size("runs"))).first()[0] or 0) <= MAX_SENT_RUNS
    runs = runs.withColumnsRenamed({"doc_id": "run_doc", "key": "run_key"})
    rows = _keyed(docs)
    joined = rows.join(F.broadcast(runs) if few else runs, F.expr("doc_id <=> run_doc and key = run_key"), "left").select("doc_id", F.coalesce("runs", F.array()).alias("runs"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, found, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                words, found = text.as_py().split(), found.as_py()
                order = altered_order(doc_id.as_py(), len(words), alter)
                if order is not None or found:
                    order = np.arange(len(words)) if order is None else order
                    words = [words[i] for i in order[kept_words(len(words), [(r["start"], r["period"], r["length"]) for r in found])].tolist()]
                out.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()).cast(pa.string(), safe=False)], names=["doc_id", "runs", "text"])

    return joined.mapInArrow(run, "doc_id long, runs array<struct<start: long, period: long, length: long>>, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, where each tenth document's words are made to repeat from a place on."""
    done = collapse_runs(table(spark, sf_dir, "documents"), periodic_tail)
    none = F.struct(F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("period"), F.lit(0).cast("long").alias("length"))
    best = F.aggregate("runs", none, lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    of = lambda c: F.when(F.size("runs") > 0, F.col(f"best.{c}"))
    return done.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), of("start").alias("start"), of("length").alias("length"), of("period").alias("period"),
        F.expr("CASE WHEN size(runs) > 0 THEN best.length * 1000 div best.period END").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))

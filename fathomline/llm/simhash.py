"""Operator 9, SimHash near-duplicates by anchor-point covering.

Anchors are the words of a product of two perfect binary Golay codes on 46 of the 64 fingerprint bits: each 23-bit
half lies within 3 bits (the covering radius) of exactly one codeword, so every fingerprint has one home anchor. A
fingerprint also visits every anchor whose halves lie within 3 + e and 3 + f bits with e + f <= 2, the covering radius
plus the threshold. Of two fingerprints at 2 or fewer differing bits, each visits the other's home, so one equi-join
on the anchor finds every link; the distance is then checked on all 64 bits. About 70 of 16.8 million anchors are
visited, whatever the data. Equal fingerprints are collapsed before and share their class.

Nulls: a null text counts as empty (fingerprint zero); rows with a null ``doc_id`` keep their fingerprint, and get
the class of the other documents with that fingerprint, or null. Ties have no order here: equal fingerprints are one
node. Very long texts are hashed in blocks. Repeated rows are kept; an empty table gives no rows. Other columns are ignored
by ``simhash_classes`` and kept by ``keep_one_per_class``.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import free_name, linked_components, materialize, table, text_or_empty, without

#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011
HALF, RADIUS, THRESHOLD = 23, 3, 2


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator."""
    out = word.copy()
    for bit in range(HALF - 1, 10, -1):
        out ^= np.where(out >> bit & 1, GOLAY << (bit - 11), 0)
    return out


def _visit_table() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: what to xor onto a half to reach each anchor it visits, and the excess over the covering radius (9: no anchor)."""
    errors = np.array([sum(1 << b for b in c) for k in range(RADIUS + 1) for c in itertools.combinations(range(HALF), k)], dtype=np.int64)
    leader = np.empty(1 << 11, dtype=np.int64)
    leader[_syndrome(errors)] = errors
    best: list[dict[int, int]] = [{} for _ in leader]
    for k in range(THRESHOLD + 1):
        flips = np.array([sum(1 << b for b in c) for c in itertools.combinations(range(HALF), k)], dtype=np.int64)
        for f, s in zip(flips.tolist(), _syndrome(flips).tolist(), strict=True):
            for syndrome, offset in enumerate((f ^ leader[np.arange(1 << 11) ^ s]).tolist()):
                best[syndrome].setdefault(offset, k)
    width = max(map(len, best))
    offsets, excess = np.zeros((1 << 11, width), dtype=np.int64), np.full((1 << 11, width), 9, dtype=np.int8)
    for s, found in enumerate(best):
        offsets[s, : len(found)], excess[s, : len(found)] = list(found), list(found.values())
    return offsets, excess


class Anchors:
    """Home and visited anchors of fingerprints."""

    def __init__(self):
        self.offsets, self.excess = _visit_table()

    def halves(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = (1 << HALF) - 1
        return fp & mask, fp >> HALF & mask

    def home(self, fp: np.ndarray) -> np.ndarray:
        a, b = (h ^ self.offsets[_syndrome(h), 0] for h in self.halves(fp))
        return a << HALF | b

    def visits(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the fingerprint and anchor, for every visit."""
        (a, b) = self.halves(fp)
        sa, sb = _syndrome(a), _syndrome(b)
        near = self.excess[sa][:, :, None] + self.excess[sb][:, None, :] <= THRESHOLD
        row, i, j = np.nonzero(near)
        return row, (a[row] ^ self.offsets[sa[row], i]) << HALF | (b[row] ^ self.offsets[sb[row], j])


_BLOCK, _SPACE = 1 << 20, re.compile(rb"[\x20\x09-\x0d]")


def _word_blocks(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text in blocks of about ``_BLOCK`` bytes; each block after the first starts with the last two words before it."""
    at, before = 0, []
    while at < len(raw):
        cut = _SPACE.search(raw, at + _BLOCK) if len(raw) - at > _BLOCK else None
        end = cut.start() if cut else len(raw)
        words = before + raw[at:end].split()
        yield words
        at, before = end, words[-2:]


def _ones(shingles: list[bytes]) -> np.ndarray:
    """How many of the hashes have each bit set, highest bit first."""
    bits = np.unpackbits(np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles]), dtype=np.uint8)).reshape(-1, 64)
    whole = len(bits) // 255 * 255
    ones = bits[whole:].sum(0, dtype=np.int64)
    if whole:  # sums of 255 bits fit a byte
        ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return ones


def fingerprint(text: str) -> int:
    """SimHash of the 3-word shingles of a text, as a signed 64-bit number; a text of any length is hashed in blocks."""
    ones, n, words = np.zeros(64, dtype=np.int64), 0, []
    for words in _word_blocks(text.encode("utf-8", "surrogatepass").lower()):  # on bytes: A-Z and ASCII white space only
        for at in range(0, len(words) - 2, 16_384):
            part = words[at : at + 16_386]
            ones += _ones(list(map(b" ".join, zip(part, part[1:], part[2:]))))
            n += len(part) - 2
    if not n:
        if not words:
            return 0
        ones, n = _ones([b" ".join(words)]), 1
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def _row_key():
    return F.xxhash64("doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, key, fp`` of every row; ``key`` stands for the row's id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("key"), text_or_empty(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Links ``a, b`` of ``nodes (fp, id)``, whose fingerprints differ, at 2 or fewer differing bits."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(anchors.home(batch.column(0).to_numpy())), *batch.columns], names=["anchor", "fp", "id"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                row, anchor = anchors.visits(part.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(anchor), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], names=["anchor", "vfp", "vid"])

    at_home = nodes.mapInArrow(homes, "anchor long, fp long, id long")
    visiting = nodes.mapInArrow(visits, "anchor long, vfp long, vid long")
    return (
        visiting.join(at_home, "anchor")
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("vfp"))) <= THRESHOLD)
        .where("id < vid")  # each link is found from both ends
        .select(F.col("id").alias("a"), F.col("vid").alias("b"))
    )


def simhash_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, key, fp, component_id`` of every row of ``docs``."""
    fps = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    # a fingerprint is its node: one doc_id may have several
    comps = linked_components(fingerprint_links(nodes.where("id is not null").select("fp", F.col("fp").alias("id")))).select(F.col("id").alias("fp"), F.col("component_id").alias("root"))
    rooted = materialize(nodes.join(comps, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root")), "rooted")
    classes = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", "key", "fp", "component_id")


def keep_one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the smallest ``doc_id`` stays.

    Of rows that repeat a kept ``doc_id`` one stays; rows without a ``doc_id`` all stay. All columns are kept.
    """
    key = free_name(docs, "key")
    classes = materialize(simhash_classes(docs.select("doc_id", "text")).where("doc_id is not null"), "classes")
    again = classes.where("doc_id = component_id").groupBy("doc_id").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = materialize(again, "repeated_ids")
    gone = classes.where("doc_id <> component_id").select(F.col("key").alias(key))
    repeated = again.limit(1).count() > 0
    if repeated:
        others = classes.where("doc_id = component_id").join(again, "doc_id").where(F.col("key") != F.col("first"))
        gone = gone.union(others.select(F.col("key").alias(key)))
    left = without(docs.withColumn(key, _row_key()), gone, key)
    if repeated:
        firsts = again.select(F.col("first").alias(key))
        once, more = left.join(firsts, key, "left_anti"), left.join(firsts, key, "left_semi")
        left = once.unionByName(more.dropDuplicates([key]))
    return left.select(docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

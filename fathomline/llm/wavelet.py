"""Operator 7, token-id output: one wavelet matrix per shard, with access, counting and occurrence lookup.

``write_token_shards`` encodes documents in ascending ``doc_id`` order into a Parquet table with one row per shard:
``part, shard, start, n_tokens, doc_ids, lengths, matrix``. ``matrix`` is a self-contained succinct file: a header, the
places of its frames, bit-planes from the highest bit down, and the number of ones before every 512th bit. Planes are
compressed in frames of ``_FRAME`` bytes, so that access, counting and lookup inflate a frame or two of each plane, not
the shard. Documents are never split, so a shard holds at least ``shard_tokens`` ids unless it is a partition's last, and
a very long document is a shard of its own size.

Nulls: a null text counts as empty, a null ``doc_id`` sorts first. Rows with equal ids are kept, ordered by the hash
of their text. An empty table writes no shards. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.byte_tokens import byte_tokens, default_tokenizer
from fathomline.llm.common import materialize, table, text_or_empty

_HEAD = struct.Struct("<4sQB")
_BLOCK = 512  # bits between two entries of the rank directory
_FRAME = 8192  # bytes of a plane that are compressed together


class Plane:
    """A bit-plane: as an array while it is built, else as compressed frames of which the ones in use stay inflated."""

    def __init__(self, frames: list[bytes] | None, size: int, raw: np.ndarray | None = None):
        self.frames, self.size, self.raw, self.open = frames, size, raw, {}

    def frame(self, k: int) -> np.ndarray:
        if k not in self.open:
            self.open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[k]), dtype=np.uint8)
        return self.open[k]

    def cut(self, start: int, end: int) -> np.ndarray:
        """Bytes ``start`` to ``end``, which lie in one frame."""
        if self.raw is not None:
            return self.raw[start:end]
        return self.frame(start // _FRAME)[start % _FRAME : start % _FRAME + end - start]

    def whole(self) -> np.ndarray:
        return self.raw if self.raw is not None else np.concatenate([np.zeros(0, dtype=np.uint8), *(np.frombuffer(zstandard.ZstdDecompressor().decompress(f), dtype=np.uint8) for f in self.frames)])


class WaveletMatrix:
    """Bit-planes of ids, highest bit first; each plane sorts the ids stably by its bit for the next one."""

    def __init__(self, n: int, zeros: list[int], planes: list[Plane], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n, zeros, planes, ranks = len(ids), [], [], []
        a, spare = ids.copy(), np.empty_like(ids)
        for b in range(bits - 1, -1, -1):
            one = (a & a.dtype.type(1 << b)) != 0
            plane = np.packbits(one, bitorder="little")
            ups, downs = np.flatnonzero(one), np.flatnonzero(~one)
            z = len(downs)
            a.take(downs, out=spare[:z])
            a.take(ups, out=spare[z:])
            a, spare = spare, a
            counts = np.searchsorted(ups, np.arange(0, n + _BLOCK, _BLOCK)).astype("<u4")
            zeros.append(z), planes.append(Plane(None, len(plane), plane)), ranks.append(counts)
        return cls(n, zeros, planes, ranks)

    def to_bytes(self) -> bytes:
        """Header, frame sizes, then the frames: ranks and zeros first, then plane after plane."""
        small = np.array(self.zeros, dtype="<u8").tobytes() + b"".join(r.tobytes() for r in self.ranks)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        frames = [squeeze(small)] + [squeeze(p.whole()[at : at + _FRAME].tobytes()) for p in self.planes for at in range(0, p.size, _FRAME)]
        return _HEAD.pack(b"WVM2", self.n, len(self.zeros)) + np.array(list(map(len, frames)), dtype="<u4").tobytes() + b"".join(frames)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        magic, n, bits = _HEAD.unpack_from(blob)
        if magic != b"WVM2":
            raise ValueError("not a wavelet matrix")
        size, steps = (n + 7) // 8, len(range(0, n + _BLOCK, _BLOCK))
        each = len(range(0, size, _FRAME))
        sizes = np.frombuffer(blob, dtype="<u4", count=1 + bits * each, offset=_HEAD.size).astype(np.int64)
        ends = _HEAD.size + 4 * len(sizes) + np.cumsum(sizes)
        frames = [memoryview(blob)[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
        body = zstandard.ZstdDecompressor().decompress(frames[0])
        zeros = np.frombuffer(body, dtype="<u8", count=bits).tolist()
        ranks = [np.frombuffer(body, dtype="<u4", count=steps, offset=8 * bits + 4 * k * steps) for k in range(bits)]
        return cls(n, zeros, [Plane(frames[1 + k * each : 1 + (k + 1) * each], size) for k in range(bits)], ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // _BLOCK
        start, end = block * _BLOCK // 8, (i + 7) // 8
        bits = np.unpackbits(self.planes[level].cut(start, end), bitorder="little") if end > start else np.zeros(0, dtype=np.uint8)
        return int(self.ranks[level][block]) + int(bits[: i - block * _BLOCK].sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level].cut(i >> 3, (i >> 3) + 1)[0]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, z in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out = out << 1 | bit
            i = z + ones if bit else i - ones
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi, bits = 0, end, len(self.zeros)
        if token >> bits:
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (z + a, z + b) if token >> (bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of an id before position ``end`` (the whole shard by default)."""
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence (from 0) of an id, or -1."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i, bits = lo + k, len(self.zeros)
        for level in range(bits - 1, -1, -1):
            bit = token >> (bits - 1 - level) & 1
            want = i - self.zeros[level] if bit else i  # the want-th bit of this kind
            kind = self.ranks[level] if bit else np.arange(len(self.ranks[level]), dtype=np.int64) * _BLOCK - self.ranks[level]
            block = int(np.searchsorted(kind, want, side="right")) - 1
            inside = np.unpackbits(self.planes[level].cut(block * _BLOCK // 8, (block + 1) * _BLOCK // 8), bitorder="little")
            i = block * _BLOCK + int(np.flatnonzero(inside == bit)[want - int(kind[block])])
        return i

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the lowest bit up."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        a = np.zeros(self.n, dtype=kind)
        for b, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bits = np.unpackbits(plane.whole(), count=self.n, bitorder="little")
            one = bits.view(bool)
            up = np.empty_like(a)
            up[~one] = a[:z]
            up[one] = a[z:] | kind(1 << b)
            a = up
        return a


_SHARD_SCHEMA = "part int, shard int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, matrix binary"


def write_token_shards(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, shard_tokens: int = 1 << 16) -> DataFrame:
    """Encode ``docs (doc_id, text)`` in order of ``doc_id`` and write the shards; returns the written table."""
    path = tokenizer_path or default_tokenizer()

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), byte_tokens(path)
        tail = np.array([end_id], dtype=encoder.dtype)
        bits = max(1, (max(encoder.library.get_vocab_size(), end_id + 1) - 1).bit_length())
        shard = start = size = 0
        ids, lengths, pieces = [], [], []

        def flush() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.concatenate(pieces), bits).to_bytes()
            row = [[part], [shard], [start], [size], [ids], [lengths], [matrix]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "shard", "start", "n_tokens", "doc_ids", "lengths", "matrix"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                got = np.concatenate([encoder.ids(text.as_py()), tail])
                ids.append(doc_id.as_py()), lengths.append(len(got)), pieces.append(got)
                size += len(got)
                if size >= shard_tokens:
                    yield flush()
                    shard, start, size = shard + 1, start + size, 0
                    ids, lengths, pieces = [], [], []
        if ids:
            yield flush()

    rows = docs.select("doc_id", text_or_empty(F.col("text")).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return materialize(ordered.mapInArrow(to_shards, _SHARD_SCHEMA), "token_shards")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """One row per document from the written shards: doc_id, start, n_tokens, ids_crc32 (little-endian unsigned 32-bit)."""
    base, total = {}, 0
    for part, n in sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("n_tokens")).collect()):  # one row per partition
        base[part], total = total, total + n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, ids, lengths, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "doc_ids", "lengths", "matrix")), strict=True):
                raw = WaveletMatrix.from_bytes(blob).decode().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(base[part] + start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "start", "doc_ids", "lengths", "matrix").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_occurrences(shards: DataFrame, token: int) -> DataFrame:
    """How often an id occurs in each shard and where it first does, from the planes alone: part, shard, n, first (-1: nowhere)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [WaveletMatrix.from_bytes(b.as_py()) for b in batch.column("matrix")]
            cols = [batch.column("part"), batch.column("shard"), pa.array([m.rank(token) for m in found], pa.int64()), pa.array([m.select(token, 0) for m in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "shard", "n", "first"])

    return shards.select("part", "shard", "matrix").mapInArrow(look, "part int, shard int, n long, first long")


def token_occurrences_of_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents end in each shard and where the first does, by rank and select on the end id."""
    return token_occurrences(write_token_shards(table(spark, sf_dir, "documents")), 2)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_shards(write_token_shards(table(spark, sf_dir, "documents")))

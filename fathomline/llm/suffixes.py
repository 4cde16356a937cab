"""Operator 13, duplicate passages by a distributed difference-cover suffix sort.

A document loses every byte that a 50-byte string covers which also starts in a document with a smaller ``doc_id``.

Suffixes are sorted in shards that share no 50-byte string. Every such string has an anchor, the 16 bytes in it with the
smallest hash; neighbouring strings with the same anchor are one context of at most 84 bytes. Strings that are equal have equal
anchors, so a shard of the anchors' hashes has all that can match, and only anchors seen in two documents go on:

1. every block of documents sends its anchors' hashes to the shards, which answer with those that occur again elsewhere;
2. blocks send the different contexts of these, each with the smallest ``doc_id`` that has it;
3. a shard writes the contexts of its anchors one after another (where an anchor has but one context, all its strings are
   equal) and sorts their suffixes by the difference cover {1, 2} modulo 3: triples at these places are sorted and named, the
   names are sorted by recursion (four levels decide 81 bytes), the remaining suffixes are merged in; suffixes next to each
   other that agree in 50 bytes are one group with one smallest ``doc_id``;
4. a block's answer says which strings of which contexts stand in a smaller document, and the block cuts its documents.

Blocks are documents by a hash of their id, so the texts are shuffled once for all steps. A block combines equal hashes
and contexts before it sends them. Exact copies of a text in a smaller document lose all and are taken out before. The contexts of an anchor that over ``HOT`` documents have are sent string by string, dealt by the
string's hash, so no shard gets all of them. Answers name a context by its 64-bit hash, within a block and an anchor.

Nulls and edges: a null text counts as empty; texts under 50 bytes stay as they are. A row without a ``doc_id`` keeps
all its bytes and takes none from others. Rows with the same ``doc_id`` take nothing from each other, be they equal or not; each gets a row.
Other columns are ignored, whatever their names; an empty table gives no rows. A very long text is cut in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import materialize, table, text_or_empty, without

#: Length of the strings, and of their anchors.
LENGTH, ANCHOR = 50, 16
#: Bytes whose anchors are searched at once.
PIECE = 1 << 18
#: Documents of an anchor beyond which its contexts are dealt string by string.
HOT = 20_000
#: A block has about so many bytes of text, more where there are over ``MANY`` blocks, up to 32 times as many.
BLOCK, MANY = 2 << 20, 50_000
#: Bytes of contexts whose suffixes are sorted together; those of one anchor are never parted.
SORTED = 1 << 19
#: Marks the length of a context that was dealt string by string.
_DEALT = np.uint32(1 << 31)

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
SENT = "shard long, block long, hashes binary, counts binary, lengths binary, texts binary"
ANSWER = "block long, hashes binary, hot binary"
FOUND = "block long, anchors binary, contexts binary, ranges binary"
CUT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """For every suffix of ``s`` (whole numbers from 1), how many are smaller; those that agree in ``depth`` places may count as equal."""
    n = len(s)
    if n < 3:
        order = sorted(range(n), key=lambda i: s[i:].tolist())
        out = np.empty(n, dtype=np.int64)
        out[order] = np.arange(n)
        return out
    t = np.concatenate([s, np.zeros(4, dtype=np.int64)]).astype(np.int64)
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)  # a triple of zeros ends the first part
    cover = np.concatenate([one, two])
    width = int(t.max()) + 1
    if width < 1 << 21:
        _, names = np.unique((t[cover] * width + t[cover + 1]) * width + t[cover + 2], return_inverse=True)
    else:
        _, pairs = np.unique(t[cover] * width + t[cover + 1], return_inverse=True)
        _, names = np.unique(pairs * width + t[cover + 2], return_inverse=True)
    if depth <= 3 or names.max() + 1 == len(names):
        smaller = np.bincount(names + 1, minlength=len(names) + 1).cumsum()[names]
    else:
        smaller = suffix_order(names + 1, -(-depth // 3))
    ended = int(n % 3 == 1)
    rank = np.zeros(n + 4, dtype=np.int64)  # 0: after the end
    rank[cover] = smaller - ended + 1
    rank[n:] = 0
    own = np.zeros(n, dtype=np.int64)
    one = one[: len(one) - ended]
    own[one], own[two] = rank[one] - 1, rank[two] - 1

    def merged(rows: np.ndarray, zeros: int, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ``rows``, whose first ``zeros`` are the remaining suffixes: how many rows, remaining suffixes and others are smaller, by symbol and what follows."""
        key = t[rows] * (n + 2) + after[rows + 1]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
        low = np.concatenate([[0], np.cumsum(order < zeros)])[first]
        out = np.empty((3, len(rows)), dtype=np.int64)
        out[:, order] = first, low, first - low
        return out[0], out[1], out[2]

    both, low, _ = merged(np.concatenate([zero, one]), len(zero), rank)
    own[one] += low[len(zero) :]
    follows = np.zeros(n + 4, dtype=np.int64)
    follows[np.concatenate([zero, one])] = both + 1
    own[zero] = both[: len(zero)]
    _, low, high = merged(np.concatenate([zero, two]), len(zero), follows)
    own[two] += low[len(zero) :]
    own[zero] += high[: len(zero)]
    return own


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number."""
    return np.ndarray(max(0, len(data) - 7), dtype="<u8", buffer=data.tobytes(), strides=(1,)).copy()


def repeated(texts: bytes, starts: np.ndarray) -> np.ndarray:
    """For strings of 50 bytes that begin at ``starts``: a number for each, equal where the strings are."""
    data = np.frombuffer(texts, dtype=np.uint8)
    order = suffix_order(data.astype(np.int64) + 1, LENGTH)
    at = starts[np.argsort(order[starts], kind="stable")]
    words = _words_at(data)
    same = np.ones(max(0, len(at) - 1), dtype=bool)
    for off in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        w = words[at + off]
        same &= w[1:] == w[:-1]
    group = np.concatenate([[0], np.cumsum(~same)])[: len(at)]
    by_place = np.zeros(len(data), dtype=np.int64)
    by_place[at] = group
    return by_place[starts]


class Contexts:
    """The contexts of a block's documents: ``anchor`` (hash), ``doc`` (row), ``start`` (byte in ``data``) and ``count`` (strings)."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        self.ids, self.data = ids, b"".join(texts)
        self.bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        parts = [self._piece(at) for at in range(0, max(0, len(self.data) - LENGTH + 1), PIECE)]
        self.anchor, self.start, self.count = (np.concatenate([np.empty(0, d), *(p[i] for p in parts)]) for i, d in enumerate((np.uint64, np.int64, np.int64)))
        self.doc = np.searchsorted(self.bounds, self.start, "right") - 1

    def _piece(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(self.data, dtype=np.uint8)[at : at + PIECE + LENGTH - 1]
        words = _words_at(data)
        h = words[:-8] * _A
        h ^= words[8:] * _B
        h ^= h >> np.uint64(29)
        h *= _C
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << 19) - 1)
        best, span, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, LENGTH - ANCHOR + 1  # of equal hashes the first
        while span * 2 <= width:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
        where = (best & low).astype(np.int64)
        new = np.concatenate([[True], where[1:] != where[:-1]])
        inner = self.bounds[(self.bounds > at) & (self.bounds < at + len(where))] - at
        new[inner] = True  # a document begins
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(where))
        ends = self.bounds[np.searchsorted(self.bounds, first + at, "right")] - at - LENGTH + 1  # the last string of the document begins before
        count = np.minimum(end, ends) - first
        keep = count > 0
        return h[where[first[keep]]], first[keep] + at, count[keep]

    def take(self, keep: np.ndarray) -> Contexts:
        out = object.__new__(Contexts)
        out.ids, out.data, out.bounds = self.ids, self.data, self.bounds
        out.anchor, out.start, out.count, out.doc = (x[keep] for x in (self.anchor, self.start, self.count, self.doc))
        return out

    def split(self, hot: np.ndarray) -> Contexts:
        """The contexts of ``hot`` anchors (sorted) string by string."""
        times = np.where(_among(self.anchor, hot), self.count, 1)
        out = self.take(np.repeat(np.arange(len(times)), times))
        nth = np.arange(len(out.start)) - np.repeat(np.cumsum(times) - times, times)
        out.start, out.count = out.start + nth, np.where(np.repeat(times > 1, times), 1, out.count)
        return out

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """The different anchors, and in how many documents each is."""
        order = np.lexsort((self.ids[self.doc], self.anchor))
        a, d = self.anchor[order], self.ids[self.doc][order]
        new = np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]
        first = np.flatnonzero(new)
        more = new | np.concatenate([[True], d[1:] != d[:-1]])[: len(a)]
        return a[first], np.add.reduceat(more.astype(np.int64), first) if len(first) else first

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.start[i] + self.count[i] + LENGTH - 1]

    def least(self) -> dict[bytes, tuple[int, int]]:
        """The different contexts, each with its smallest document and one of its rows."""
        out: dict[bytes, tuple[int, int]] = {}
        for i, d in enumerate(self.ids[self.doc].tolist()):
            t = self.text(i)
            if (had := out.get(t)) is None or d < had[0]:
                out[t] = d, i
        return out


def _among(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _context_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _block(rows: pa.Table) -> Contexts:
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    rows = rows.take(pa.array(order))
    return Contexts(rows.column("doc_id").to_numpy(), rows.column("text").to_pylist())


def _joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(v for v in column.to_pylist() if v), dtype=dtype)


def _table(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)})


def _send_anchors(shards: int, block: int, c: Contexts) -> pa.Table:
    anchors, docs = c.documents()
    to = (anchors % np.uint64(shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    names, first = np.unique(to[order], return_index=True)
    cut = lambda x: [p.tobytes() for p in np.split(x[order], first[1:])] if len(first) else []
    none = [None] * len(names)
    return _table(SENT, [names.tolist(), [block] * len(names), cut(anchors), cut(docs.astype(np.uint32)), none, none])


def _answer_anchors(rows: pa.Table, most: int) -> pa.Table:
    """To each block its anchors that other documents have too, and which of these more than ``most`` have."""
    hashes, counts = ([np.frombuffer(v, d) for v in rows.column(c).to_pylist()] for c, d in (("hashes", np.uint64), ("counts", np.uint32)))
    every, at = np.unique(np.concatenate(hashes), return_inverse=True)
    docs = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
    again, hot = [], []
    for h, n in zip(hashes, np.split(docs[at], np.cumsum([len(h) for h in hashes])[:-1]), strict=True):
        again.append(h[n > 1].tobytes())
        hot.append(h[n > most].tobytes())
    return _table(ANSWER, [rows.column("block").to_pylist(), again, hot])


def _send_contexts(shards: int, block: int, c: Contexts, again: np.ndarray, hot: np.ndarray) -> pa.Table:
    c = c.take(_among(c.anchor, again)).split(hot)
    by_shard: dict[int, list[tuple[int, int, bytes, int]]] = {}
    dealt = _among(c.anchor, hot)
    for t, (doc, i) in c.least().items():
        shard = (_context_hash(t) if dealt[i] else int(c.anchor[i])) % shards
        by_shard.setdefault(shard, []).append((int(c.anchor[i]), doc, t, len(t) | int(_DEALT) * int(dealt[i])))
    for h in hot.tolist():  # the block has to know them again when it cuts
        by_shard.setdefault(h % shards, []).append((h, 0, b"", 0))
    pack = lambda k, d: [np.array([x[k] for x in v], dtype=d).tobytes() for v in by_shard.values()]
    press = zstandard.ZstdCompressor(1).compress
    return _table(SENT, [list(by_shard), [block] * len(by_shard), pack(0, np.uint64), pack(1, np.int64), pack(3, np.uint32), [press(b"".join(x[2] for x in v)) for v in by_shard.values()]])


def _least_of_strings(names: list[bytes], anchors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document of every string of every context, one context after another, and where each context's strings begin.

    ``anchors``: of the contexts, 0 for those dealt string by string; ``least``: the smallest document that has the context.
    """
    size = np.array([len(t) for t in names])
    count = size - LENGTH + 1
    first = np.cumsum(count) - count
    out = np.repeat(least, count)
    order = np.argsort(anchors, kind="stable")
    edge = np.concatenate([[True], anchors[order][1:] != anchors[order][:-1]])
    begin = np.flatnonzero(edge)
    several = np.repeat(np.diff(np.append(begin, len(order))) > 1, np.diff(np.append(begin, len(order)))) & (anchors[order] != 0)
    order, edge = order[several], edge[several]
    batch = np.cumsum(size[order]) // SORTED
    batch = np.maximum.accumulate(np.where(edge, batch, 0))  # an anchor stays in the batch of its first context
    for own in np.split(order, np.flatnonzero(np.diff(batch)) + 1) if len(order) else ():
        at = np.cumsum(size[own]) - size[own]
        n = count[own]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        group = repeated(b"".join([names[i] for i in own.tolist()]), np.repeat(at, n) + inside)
        smallest = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, np.repeat(least[own], n))
        out[np.repeat(first[own], n) + inside] = smallest[group]
    return out, first


def _match_contexts(rows: pa.Table) -> pa.Table:
    """To each block, of which of its contexts which strings stand in a document smaller than those the block has."""
    number: dict[bytes, int] = {}
    entries, hot, kind = [], [], []
    expand = zstandard.ZstdDecompressor().decompress
    for block, anchors, docs, lengths, texts in zip(*(rows.column(c).to_pylist() for c in ("block", "hashes", "counts", "lengths", "texts")), strict=True):
        at, lengths, texts = 0, np.frombuffer(lengths, np.uint32), expand(texts)
        for a, d, n, dealt in zip(np.frombuffer(anchors, np.uint64).tolist(), np.frombuffer(docs, np.int64).tolist(), (lengths & ~_DEALT).tolist(), (lengths >= _DEALT).tolist(), strict=True):
            if n:
                k = number.setdefault(texts[at : at + n], len(number))
                if k == len(kind):
                    kind.append(0 if dealt else a)
                entries.append((block, a, d, k))
            else:
                hot.append((block, a))
            at += n
    out: dict[int, tuple[list, list, list]] = {}
    for block, a in hot:
        for part, v in zip(out.setdefault(block, ([], [], [])), (a, 0, 0), strict=True):
            part.append(v)
    if entries:
        names = list(number)
        docs, own = np.array([e[2] for e in entries]), np.array([e[3] for e in entries])
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, own, docs)
        smallest, first = _least_of_strings(names, np.array(kind, dtype=np.uint64), least)
        bound = np.minimum.reduceat(smallest, first)  # the smallest document of any string of a context
        for e in np.flatnonzero(bound[own] < docs).tolist():
            block, anchor, doc, k = entries[e]
            less = smallest[first[k] : first[k] + len(names[k]) - LENGTH + 1] < doc
            edges = np.flatnonzero(np.diff(np.concatenate([[0], less.astype(np.int8), [0]])))
            name = _context_hash(names[k])
            anchors, contexts, ranges = out.setdefault(block, ([], [], []))
            for a, b in edges.reshape(-1, 2).tolist():
                anchors.append(anchor)
                contexts.append(name)
                ranges.append(a << 16 | b)
    pack = lambda k, d: [np.array(v[k], dtype=d).tobytes() for v in out.values()]
    return _table(FOUND, [list(out), pack(0, np.uint64), pack(1, np.uint64), pack(2, np.int64)])


def _covered(c: Contexts, anchors: np.ndarray, contexts: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """How many removed strings begin (1) and end (-1) at each byte of the block."""
    step = np.zeros(len(c.data) + 1, dtype=np.int32)
    mine, docs = c.documents()
    wanted = np.union1d(mine[docs > 1], anchors)
    c = c.take(_among(c.anchor, wanted)).split(np.unique(anchors[ranges == 0]))
    found: dict[tuple[int, int], list[int]] = {}
    for a, t, r in zip(anchors.tolist(), contexts.tolist(), ranges.tolist(), strict=True):
        if r:
            found.setdefault((a, t), []).append(r)
    least = c.least()
    for i, d in enumerate(c.ids[c.doc].tolist()):
        t, start = c.text(i), int(c.start[i])
        parts = [(0, int(c.count[i]))] if d > least[t][0] else [(r >> 16, r & 0xFFFF) for r in found.get((int(c.anchor[i]), _context_hash(t)), ())]
        for a, b in parts:
            step[start + a] += 1
            step[start + b + LENGTH - 1] -= 1
    return step


def _cut(c: Contexts, step: np.ndarray) -> pa.Table:
    gone = np.cumsum(step, dtype=np.int32)[:-1] > 0
    data, spans, kept = np.frombuffer(c.data, dtype=np.uint8), [], []
    for a, b in zip(c.bounds[:-1].tolist(), c.bounds[1:].tolist(), strict=True):
        own = gone[a:b]
        edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        spans.append([{"start": s, "end": e} for s, e in edges.tolist()])
        kept.append(data[a:b][~own].tobytes() if len(edges) else c.data[a:b])
    return pa.table({"doc_id": pa.array(c.ids, pa.int64()), "n_bytes": pa.array(np.diff(c.bounds), pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary())})


def _copies(rows: DataFrame) -> DataFrame:
    """``doc_id, key, n_bytes`` of the rows whose whole text stands in a document with a smaller id: a row for each of them."""
    facts = rows.select("doc_id", "key", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").cast("long").alias("n_bytes"))
    facts = materialize(facts.where(F.col("n_bytes") >= LENGTH), "texts")
    firsts = facts.groupBy("h1", "h2", "n_bytes").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    firsts = materialize(firsts, "copied_texts")  # so that the join has shuffles of its own, which adaptive execution can split where a text has very many copies
    return facts.join(firsts, ["h1", "h2", "n_bytes"]).where("doc_id > first").select("doc_id", "key", "n_bytes")


def cut_repeats(docs: DataFrame, most: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row of ``docs``: the removed spans of bytes, and the bytes that stay.

    ``most``: documents of an anchor beyond which its contexts are dealt string by string.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // max(BLOCK, min(total // MANY, 32 * BLOCK))))
    shards = max(16, blocks // 4)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).cast("binary").alias("text"))
    known = plain.where("doc_id is not null").withColumn("key", F.xxhash64("doc_id", "text"))
    copies = materialize(_copies(known), "copies")
    rows = without(known, copies, "key").select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id", "text")
    number = lambda key: key[0].as_py()

    def anchors(key: tuple, own: pa.Table) -> pa.Table:
        return _send_anchors(shards, number(key), _block(own))

    def contexts(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _table(SENT, [[]] * 6)
        again, hot = (np.unique(_joined(answers.column(c), np.uint64)) for c in ("hashes", "hot"))
        return _send_contexts(shards, number(key), _block(own), again, hot)

    def cut(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        c = _block(own)
        return _cut(c, _covered(c, *(_joined(answers.column(n), d) for n, d in (("anchors", np.uint64), ("contexts", np.uint64), ("ranges", np.int64)))))

    by_block = rows.groupBy("block")
    again = by_block.applyInArrow(anchors, SENT).groupBy("shard").applyInArrow(lambda own: _answer_anchors(own, most), ANSWER)
    sent = by_block.cogroup(again.groupBy("block")).applyInArrow(contexts, SENT)
    found = sent.groupBy("shard").applyInArrow(_match_contexts, FOUND)
    done = by_block.cogroup(found.groupBy("block")).applyInArrow(cut, CUT)
    whole = plain.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr("array()").cast("array<struct<start: long, end: long>>").alias("spans"), F.col("text").alias("kept"))
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    gone = copies.select("doc_id", "n_bytes", span.alias("spans"), F.lit(b"").alias("kept"))
    return done.unionByName(whole).unionByName(gone)


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

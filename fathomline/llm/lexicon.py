"""Operator 6, BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words of the corpus are counted over all rows; the most frequent, at most ``lexicon_words`` (a fixed bound), are encoded
once and compiled into a minimal acyclic automaton. States with equal futures are shared, each transition carries
the number of lexicon words that sort before it, and the sum along a path is the word's index into the id sequences.
The automaton is written to one file of flat arrays, sent to the executors by Spark's file distribution and
memory-mapped there. Words that it does not hold are merged exactly by rank. Ids equal those of the tokenizers
library without added special tokens; decoding joins the tokens by one space, as the library does without a decoder.

Texts of any length are encoded in blocks of about ``BLOCK_CHARS`` characters, cut after white space; blocks are held until
they have ``HELD_CHARS``, so that many new words are merged at once. A worker remembers the ids of at most two generations of ``MEMO_CHUNKS`` chunks, so its memory does not grow with the data. Among
equally frequent words at the edge of the bound the hash decides which are taken; that changes speed, never ids.

Nulls: a null or empty text has no ids and decodes to an empty text. Repeated rows are kept. Other columns are ignored.
An empty table gives an empty lexicon and no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.byte_tokens import default_tokenizer
from fathomline.llm.common import materialize, table, text_or_empty
from fathomline.llm.merges import MergeTable

LEXICON_WORDS = 50_000
MEMO_CHUNKS, MEMO_CHARS, COUNT_FLUSH, BLOCK_CHARS, HELD_CHARS = 200_000, 48, 150_000, 1 << 19, 1 << 21
_CUT = re.compile("[ \n\t]")
#: Control characters that only Python counts as white space.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: The characters of Unicode's White_Space property, for use inside a class.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class WordTokenizer:
    """What the JSON file of a lower-casing word tokenizer says: special tokens, splitting and merging."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in splits] != ["Split", "ByteLevel"] or spec.get("decoder"):
            raise ValueError(f"not a tokenizer of the expected kind: {path}")
        model = spec["model"]
        self.table = MergeTable(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")
        pattern = splits[0]["pattern"]["Regex"].replace(r"\s", _WHITE)
        self.find_words = regex.compile(pattern).findall
        self.find_ascii = re.compile(pattern.replace(r"[\p{L}]", "[a-zA-Z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", "a-zA-Z0-9")).findall
        self.white = regex.compile(f"[{_WHITE}]+")
        self.divisible = not any(c.isspace() for content in self.specials for c in content)
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.specials.items()}

    def words(self, chunk: str) -> list[str]:
        return (self.find_ascii if chunk.isascii() else self.find_words)(chunk)

    def blocks(self, text: str) -> Iterator[str]:
        """The text in blocks that are encoded alone: cut after a space, line break or tab, which no merge crosses."""
        at = 0
        while self.divisible and len(text) - at > BLOCK_CHARS:
            end = at + BLOCK_CHARS
            cut = max(text.rfind(c, at, end) for c in " \n\t") + 1 or next((m.end() for m in _CUT.finditer(text, end)), len(text))
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def pieces(self, text: str) -> list[tuple[str | None, list[str]]]:
        """Chunks between white space, in runs: each run ends with a special token or, the last, with None."""
        out, at = [], 0
        if "<|" in text or not all(s.startswith("<|") for s in self.specials):
            for m in self.special.finditer(text):
                out.append((m.group(), self._chunks(text[at : m.start()])))
                at = m.end()
        out.append((None, self._chunks(text[at:] if at else text)))
        return out

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case is taken without context
        text = text.lower()
        if _SEPARATORS.search(text):
            return [c for c in self.white.split(text) if c]
        return text.split()


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Lexicon:
    """Minimal acyclic automaton over the UTF-8 bytes of words, with their id sequences, as flat arrays."""

    _HEAD = struct.Struct("<4sQQQ")

    def __init__(self, keys, target, skip, accept, starts, ids):
        self.keys, self.target, self.skip, self.accept, self.starts, self.ids = keys, target, skip, accept, starts, ids

    @classmethod
    def build(cls, words: list[bytes], sequences: list[bytes], dtype: np.dtype) -> Lexicon:
        """``words`` in ascending order without repeats or empty ones."""
        register: dict[tuple, int] = {}
        frozen: list[tuple[bool, tuple]] = []
        path: list[list] = [[False, []]]  # accepting, [(byte, state or None for the open one)]

        def freeze(depth: int) -> int:
            while len(path) > depth:
                final, edges = path.pop()
                state = (final, tuple(edges))
                if state not in register:
                    register[state] = len(frozen)
                    frozen.append(state)
                if path:
                    byte = path[-1][1][-1][0]
                    path[-1][1][-1] = (byte, register[state])
            return register[state] if depth == 0 else -1

        last = b""
        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            if same + 1 < len(path):
                freeze(same + 1)
            for byte in word[same:]:
                path[-1][1].append((byte, None))
                path.append([False, []])
            path[-1][0] = True
            last = word
        root = freeze(0)
        count = [0] * len(frozen)  # accepted words below; children are frozen before parents
        for s, (final, edges) in enumerate(frozen):
            count[s] = final + sum(count[t] for _, t in edges)
        number = {root: 0} | {s: k + 1 for k, s in enumerate(x for x in range(len(frozen)) if x != root)}
        rows, accept = [], np.zeros(len(frozen), dtype=np.uint8)
        for s, (final, edges) in enumerate(frozen):
            accept[number[s]], before = final, int(final)
            for byte, t in edges:
                rows.append((number[s] << 8 | byte, number[t], before))
                before += count[t]
        rows.sort()
        keys, target, skip = (np.array(c, dtype=k) for c, k in zip(zip(*rows, strict=True) if rows else ([], [], []), ("<i8", "<u4", "<u4"), strict=True))
        starts = np.concatenate([[0], np.cumsum([len(s) // dtype.itemsize for s in sequences])]).astype("<u4")
        return cls(keys, target, skip, accept, starts, np.frombuffer(b"".join(sequences), dtype=dtype).astype("<u4"))

    def to_bytes(self) -> bytes:
        head = self._HEAD.pack(b"LEX1", len(self.keys), len(self.accept), len(self.ids)) + struct.pack("<Q", len(self.starts))
        return head + b"".join(a.tobytes() for a in (self.keys, self.target, self.skip, self.starts, self.ids, self.accept))

    @classmethod
    def open(cls, path: str) -> Lexicon:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        magic, edges, states, n_ids = cls._HEAD.unpack_from(raw[: cls._HEAD.size].tobytes())
        if magic != b"LEX1":
            raise ValueError("not a lexicon file")
        at = cls._HEAD.size
        (n_starts,) = struct.unpack("<Q", raw[at : at + 8].tobytes())
        at, parts = at + 8, []
        for n, kind in ((edges, "<i8"), (edges, "<u4"), (edges, "<u4"), (n_starts, "<u4"), (n_ids, "<u4"), (states, "u1")):
            size = n * np.dtype(kind).itemsize
            parts.append(np.frombuffer(raw, dtype=kind, count=n, offset=at) if n else np.zeros(0, dtype=kind))
            at += size
        keys, target, skip, starts, ids, accept = parts
        return cls(keys, target, skip, accept, starts, ids)

    def index(self, words: list[bytes]) -> np.ndarray:
        """Each word's index, or -1 for words that are not in the lexicon; all words walk together, a byte at a time."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.keys) or not words:
            return out
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat, begin = np.frombuffer(b"".join(words), dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        who, state, total = np.flatnonzero(sizes > 0), None, None
        state, total = np.zeros(len(who), dtype=np.int64), np.zeros(len(who), dtype=np.int64)
        depth = 0
        while len(who):
            key = state << 8 | flat[begin[who] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            who, at = who[ok], at[ok]
            state, total = self.target[at].astype(np.int64), total[ok] + self.skip[at]
            depth += 1
            ended = sizes[who] == depth
            hit = ended & (self.accept[state] > 0)
            out[who[hit]] = total[hit]
            who, state, total = who[~ended], state[~ended], total[~ended]
        return out

    def sequence(self, index: int) -> np.ndarray:
        return self.ids[self.starts[index] : self.starts[index + 1]]


def word_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``word, n`` over whole texts and all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen = word_tokenizer(tokenizer_path), Counter()

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for chunk, n in seen.items():
                for w in tokenizer.words(chunk):
                    words[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                for block in tokenizer.blocks(text.as_py()):
                    for _, chunks in tokenizer.pieces(block):
                        seen.update(chunks)
                    if len(seen) > COUNT_FLUSH:
                        yield flush()
        yield flush()

    return docs.select(text_or_empty(F.col("text")).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words and hand the file to Spark; returns the name by which executors find it."""
    path = tokenizer_path or default_tokenizer("word_bpe_49k.json")
    counts = materialize(word_counts(docs, path), "word_counts")
    level, slot = F.floor(F.log2("n") * 16), F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    room, chosen = lexicon_words, F.lit(False)
    for at, n in counts.where("word <> ''").groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred rows
        if n > room:  # of the last level, the share that fits
            chosen = chosen | (level > at) | ((level == at) & (slot < int(room / n * (1 << 30))))
            break
        room, chosen = room - n, level >= at
    words = sorted({r.word.encode() for r in counts.where("word <> ''").where(chosen).select("word").collect()})
    merges = word_tokenizer(path).table
    return _send(Lexicon.build(words, merges.encode(words), merges.dtype), docs.sparkSession)


def _send(lexicon: Lexicon, spark: SparkSession) -> str:
    """Hand the lexicon's file to Spark's file distribution; equal lexicons are one file."""
    content = lexicon.to_bytes()
    name = f"lexicon-{hashlib.sha256(content).hexdigest()[:32]}.bin"
    local = os.path.join(SparkFiles.getRootDirectory(), "build", name)  # the driver's folder for files that Spark hands out
    if not os.path.exists(local):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as f:
            f.write(content)
        spark.sparkContext.addFile(local)
    return name


@functools.lru_cache(maxsize=2)
def _open_lexicon(name: str) -> Lexicon:
    return Lexicon.open(SparkFiles.get(name))


class Encoder:
    """Whole texts to ids: chunks that this worker remembers, then the lexicon, then exact merging."""

    def __init__(self, tokenizer: WordTokenizer, lexicon: Lexicon):
        self.tokenizer, self.lexicon, self.memo, self.older = tokenizer, lexicon, {}, {}

    def _learn(self, chunks: list[str]) -> None:
        words = [self.tokenizer.words(c) for c in chunks]
        distinct = list(set().union(*words)) if words else []
        raw = [w.encode("utf-8", "surrogatepass") for w in distinct]
        index = self.lexicon.index(raw)
        unseen = np.flatnonzero(index < 0).tolist()
        at = np.flatnonzero(index >= 0)
        starts, ends = (self.lexicon.starts[index[at] + k].tolist() for k in (0, 1))
        known = {distinct[i]: self.lexicon.ids[a:b].tobytes() for i, a, b in zip(at.tolist(), starts, ends, strict=True)}
        known.update(zip([distinct[i] for i in unseen], self.tokenizer.table.encode([raw[i] for i in unseen]), strict=True))
        self.memo.update((c, known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])) for c, ws in zip(chunks, words, strict=True))

    def _encode(self, blocks: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO_CHUNKS:  # chunks in use move from the older generation to the new one
            self.memo, self.older = {}, self.memo
        memo, older, parts = self.memo, self.older, [self.tokenizer.pieces(b) for b in blocks]
        new = set().union(*(chunks for p in parts for _, chunks in p)).difference(memo)
        memo.update([(c, older[c]) for c in new if c in older])
        self._learn([c for c in new if c not in older])
        out = [b"".join([b"".join(map(memo.__getitem__, chunks)) + (b"" if special is None else struct.pack("<I", self.tokenizer.specials[special])) for special, chunks in p]) for p in parts]
        for c in new:
            if len(c) > MEMO_CHARS:
                memo.pop(c, None)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, owners, held, size = [[] for _ in texts], [], [], 0
        for i, text in enumerate(texts):
            for block in self.tokenizer.blocks(text):
                owners.append(i), held.append(block)
                size += len(block)
                if size >= HELD_CHARS:
                    for k, ids in zip(owners, self._encode(held), strict=True):
                        out[k].append(ids)
                    owners, held, size = [], [], 0
        for k, ids in zip(owners, self._encode(held), strict=True):
            out[k].append(ids)
        return [np.frombuffer(b"".join(ids), dtype="<u4") for ids in out]


class Decoder:
    """Ids to text; an id outside the vocabulary gives no token."""

    def __init__(self, tokenizer: WordTokenizer):
        self.tokens = np.array([tokenizer.tokens.get(i) for i in range(max(tokenizer.tokens) + 1)], dtype=object)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join([t for t in self.tokens[ids[(ids >= 0) & (ids < len(self.tokens))]] if t is not None])


_ENCODED = "doc_id long, ids array<int>"


def _parts(batch: pa.RecordBatch, column: int, room: int = HELD_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``room`` bytes of one text column, or of one row."""
    sizes = np.asarray(pc.binary_length(batch.column(column)))
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and held + n > room:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(batch):
        yield batch.slice(at)


def encode(docs: DataFrame, lexicon: str, tokenizer_path: str | None = None, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` of every row; with ``decoded`` also the ``text`` that these ids decode to, by the same worker."""
    path = tokenizer_path or default_tokenizer("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        encoder, decoder = Encoder(tokenizer, _open_lexicon(lexicon)), Decoder(tokenizer) if decoded else None
        for batch in batches:
            for part in _parts(batch, 1):
                ids = encoder.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate([*ids, np.zeros(0, dtype="<u4")]).view(np.int32)
                cols = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if decoder:
                    cols.append(pa.array([decoder.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "text"][: len(cols)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    return rows.mapInArrow(run, f"{_ENCODED}, text string" if decoded else _ENCODED)


def decode(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """``doc_id, ids`` with the decoded ``text``."""
    path = tokenizer_path or default_tokenizer("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(word_tokenizer(path))
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [decoder.decode(ids.values.to_numpy() if ids.is_valid else np.zeros(0, dtype=np.int32)) for ids in part.column(1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.mapInArrow(run, f"{_ENCODED}, text string")


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    both = encode(docs, build_lexicon(docs), decoded=True)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha(F.col("text")).alias("decoded_sha256"))

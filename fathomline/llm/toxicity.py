"""Operator 2, toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic score of its words (each different word adds
the weights of itself and of its first four, five and six letters); the document's is the noisy-or of its sentences'. The
weights are trained from document labels alone, so a positive document only says that some sentence is toxic, and
the trained sentence scores then locate the offending sentences.

Training reads at most ``per_class`` documents of each label (lowest hash of ``doc_id`` first) of at most
``max_chars`` characters, outside the held-out fold; that bound (80 million characters by default) does not grow with the
data. Scoring reads every whole text, cut into the same sentences and words as in training, a text of any length
sentence by sentence.

Nulls: a null or empty text, or one without a word, has no sentence and scores 0 (as the noisy-or of nothing). Null labels or ids are not
used; conflicting labels of one id count as toxic. Without both labels in the sample every score is the share of
toxic labels in it (0 without any). Repeated rows are scored each. Columns other than ``doc_id`` and ``text`` are
ignored by ``score_documents`` and kept by the pipeline stage.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import table, text_or_empty

PER_CLASS, MAX_CHARS = 2_000, 20_000
_BUCKETS = 1 << 18
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")
_MEMO_WORDS = 200_000


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its prefixes of 4, 5 and 6 letters."""
    keys = [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) % _BUCKETS for k in keys]


def sentence_words(sentence: str) -> dict[str, None]:
    """The different words of a lower-case sentence: a repeated word is no more evidence."""
    return dict.fromkeys(_WORD.findall(sentence))


class NoisyOr:
    """Trained weights; ``weights`` is None where there was nothing to learn from."""

    def __init__(self, weights: np.ndarray | None, bias: float, share: float):
        self.weights, self.bias, self.share = weights, bias, share

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], epochs: int = 120, rate: float = 0.1, significance: float = 5.0, sparsity: float = 1e-5) -> NoisyOr:
        y, n_docs = np.array(labels, dtype=np.float64), len(labels)
        if not len(y) or y.min() == y.max():
            return cls(None, 0.0, float(y.mean()) if len(y) else 0.0)
        vocab: dict[str, int] = {}
        word_of, sent_of, doc_of = [], [], []  # word and sentence of each occurrence; document of each sentence
        for d, text in enumerate(texts):
            for words in map(sentence_words, _SENTENCE.findall(text.lower())):
                if words:
                    word_of += [vocab.setdefault(w, len(vocab)) for w in words]
                    sent_of += [len(doc_of)] * len(words)
                    doc_of.append(d)
        if not vocab:
            return cls(None, 0.0, float(y.mean()))
        word, sent, doc = np.array(word_of), np.array(sent_of), np.array(doc_of)
        pairs = [(w, f) for word_, w in vocab.items() for f in features(word_)]
        pw, pf = (np.array(c) for c in zip(*pairs, strict=True))
        owner, at = np.divmod(np.unique(doc[sent] * np.int64(len(vocab)) + word), len(vocab))  # distinct words of documents
        df = [np.bincount(pf, np.bincount(at[y[owner] == k], minlength=len(vocab))[pw], _BUCKETS) for k in (0, 1)]
        n0, n1 = n_docs - y.sum(), y.sum()
        share = (df[0] + df[1] + 1) / (n_docs + 2)
        z_score = (df[1] / n1 - df[0] / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-6) * (1 / n0 + 1 / n1))
        telling = np.abs(z_score)[pf] >= significance  # only features whose document frequencies differ by label
        pw, pf = pw[telling], pf[telling]
        weights, bias = np.zeros(_BUCKETS), -5.0
        balance = np.where(y > 0, 1.0, y.sum() / (n_docs - y.sum()))
        state = [np.zeros(_BUCKETS + 1), np.zeros(_BUCKETS + 1)]
        for step in range(1, epochs + 1):
            by_word = np.bincount(pw, weights[pf], len(vocab))
            z = bias + np.bincount(sent, by_word[word], len(doc))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n_docs))
            push = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-6), 1.0) * balance / n_docs
            gz = push[doc] * p
            grad = np.append(np.bincount(pf, np.bincount(word, gz[sent], len(vocab))[pw], _BUCKETS) + sparsity * np.sign(weights), gz.sum())
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad**2
            move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            weights, bias = weights - move[:-1], bias - move[-1]
        return cls(weights.astype(np.float32), float(bias), float(y.mean()))


class Scorer:
    """Scores whole texts with a memo of words."""

    def __init__(self, model: NoisyOr, locate: float):
        self.model, self.locate, self.memo = model, locate, {}

    def _word(self, word: str) -> float:
        got = self.memo[word] = float(sum(self.model.weights[f] for f in features(word)))
        return got

    def score(self, text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
        """Score, number of sentences, and start, length and score of the offending ones."""
        if self.model.weights is None:
            return self.model.share, 0, []
        if len(self.memo) > _MEMO_WORDS:
            self.memo.clear()
        lower = text.lower()
        if len(lower) != len(text):  # keep offsets those of the text
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        memo, word, z, n, clean, found = self.memo, self._word, array("d"), 0, 0.0, []
        starts = array("q")

        def settle() -> None:  # sentences are turned into probabilities in blocks
            nonlocal clean
            p = 1 / (1 + np.exp(-np.clip(np.frombuffer(z, dtype=np.float64), -30, 30)))
            clean += float(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
            found.extend((starts[2 * i], starts[2 * i + 1] - starts[2 * i], float(p[i])) for i in np.flatnonzero(p >= self.locate).tolist())

        for m in _SENTENCE.finditer(lower):
            words = sentence_words(m.group())
            if not words:
                continue
            n += 1
            starts.extend(m.span())
            z.append(sum([memo[w] if w in memo else word(w) for w in words], self.model.bias))
            if len(z) == 65_536:
                settle()
                z, starts = array("d"), array("q")
        if z:
            settle()
        return float(-np.expm1(clean)), n, found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> NoisyOr:
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    each = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    ids = each.where("toxic = 1").orderBy("h", "doc_id").limit(per_class).union(each.where("toxic = 0").orderBy("h", "doc_id").limit(per_class))
    rows = docs.select("doc_id", "text").where(f"length(text) between 1 and {max_chars}")
    sample = rows.join(F.broadcast(ids), "doc_id").orderBy("h", "doc_id", F.xxhash64("text")).limit(2 * per_class)  # ids: at most 2 * per_class rows
    got = sample.select("text", "toxic").collect()
    return NoisyOr.fit([r.text for r in got], [int(r.toxic) for r in got])


_SCHEMA = "doc_id long, score double, n_sentences int, offending array<struct<start:int,length:int,score:double>>"


def score_documents(docs: DataFrame, model: NoisyOr, locate: float = 0.5) -> DataFrame:
    """``doc_id, score, n_sentences, offending`` of every row; ``offending`` has the sentences scored ``locate`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, locate)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            got = [scorer.score(t.as_py()) for t in batch.column(1)]
            spans = pa.array([[{"start": a, "length": n, "score": s} for a, n, s in g[2]] for g in got], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int32()), spans], names=["doc_id", "score", "n_sentences", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).alias("text")).mapInArrow(run, _SCHEMA)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, 2.0)
        for batch in batches:
            scores = [scorer.score(t.as_py() or "")[0] for t in batch.column("text")]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", F.size("offending").alias("n_offending"), "offending")

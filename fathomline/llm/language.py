"""Operator 3, language identification by Bayesian evidence fusion.

Four kinds of evidence are combined for every record: the likelihood of its text (byte trigrams, one multinomial for
each language), the language that its markup declares, the suffix of its address, and its host. Hosts have a prior
that is smoothed towards their suffix's, and suffixes one that is smoothed towards the whole corpus's; both come from
grouped sums of text posteriors over all records. How far a declaration can be trusted comes from the same sums.

The trigram models are fitted on about ``fit_rows`` records of each declared language (chosen by hash, all where it has
fewer); everything else covers all records and whole texts. Every declared language is taken, however rare: codes of two
or three letters, so the table of models has a bound (64 KB for each language).

A record is rejected if its text has no letter or no language reaches ``min_confidence``. Nulls: a null text has no
letters; a null declaration, suffix or host is no evidence of its kind. Repeated rows are judged each. An empty table
gives no rows. Without any declared language nothing can be identified and every record is rejected. Of equally
probable languages the first by name is taken. Texts of any length are read whole, in blocks. Trigrams of one text depend
on each other; how much is fitted, not set: ``rho``, the correlation within a text of its trigrams' evidence, is estimated by
an analysis of variance over all records (``dispersion``), and n trigrams count as ``n / (1 + (n - 1) * rho)`` independent
ones. Columns of other names, the operator's own included, are ignored here and kept by
``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import free_name, materialize, table, text_or_empty, without

FIT_ROWS, BUCKETS = 4_000, 1 << 14
#: Pseudo-counts of the host, suffix and declaration levels.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 20.0, 50.0, 1.0
SALTS = 16


def _letters() -> np.ndarray:
    """Bytes to lower-case letters, other scripts' bytes to themselves, all else to a space."""
    out = np.full(256, 32, dtype=np.uint32)
    for b in range(256):
        if b >= 128 or chr(b).isalpha():
            out[b] = ord(chr(b).lower()) if b < 128 else b
    return out


_LETTER = _letters()


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text's byte trigrams, in blocks of bounded size."""
    raw, step = text.encode("utf-8", "surrogatepass"), 1 << 20
    for at in range(0, max(len(raw) - 2, 0), step):
        a = _LETTER[np.frombuffer(raw[at : at + step + 2], dtype=np.uint8)]
        key = (a[:-2] * np.uint32(961) + a[1:-1]) * np.uint32(961) + a[2:]
        yield ((key * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


@cache
def _alphabetic() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def count_letters(text: str) -> int:
    """Letters of the whole text."""
    step = 1 << 20
    return sum(int(_alphabetic()[np.frombuffer(text[at : at + step].encode("utf-32-le", "surrogatepass"), dtype="<u4")].sum()) for at in range(0, len(text), step))


def fit_text_models(evidence: DataFrame, declared: dict[str, int], fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Log-likelihood table, bucket by language; ``declared``: the languages in order, with their numbers of records."""
    languages = list(declared)
    limits = [(name, int(min(1.0, fit_rows / n) * (1 << 30)) + 1) for name, n in declared.items()]
    known = evidence.join(F.broadcast(evidence.sparkSession.createDataFrame(limits, "declared string, hash_limit long")), "declared")
    chosen = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.col("hash_limit"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        of = {name: k for k, name in enumerate(languages)}
        for batch in batches:
            for text, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for t in trigrams(text.as_py()):
                    sums[of[name]] += np.bincount(t, minlength=BUCKETS)
        k, b = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(sums[k, b], pa.int64())], names=["k", "b", "n"])

    counts = chosen.select(text_or_empty(F.col("text")).alias("text"), "declared").mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n"))
    model = np.full((BUCKETS, len(languages)), 0.05)
    k, b, n = (c.to_numpy() for c in counts.toArrow().columns)  # at most BUCKETS rows for each language
    model[b, k] += n
    return np.log(model / model.sum(0)).astype(np.float32)


def dispersion(scored: DataFrame) -> float:
    """Correlation of the trigrams of one text, from ``best, n, total, squares`` of every text: one-way analysis of variance.

    The observations are the log-likelihoods of a text's trigrams in the language that fits it best, less their mean over
    the languages; the groups are the texts, compared with texts of their own language. 0 to 1; without two texts of one
    language, or without variance, 0.
    """
    grams = F.col("n").cast("double")
    by = scored.where("n > 0").groupBy("best").agg(
        F.count("*").alias("texts"), F.sum(grams).alias("n"), F.sum(grams * grams).alias("nn"), F.sum("total").alias("total"),
        F.sum("squares").alias("squares"), F.sum(F.col("total") * F.col("total") / grams).alias("means"))
    rows = by.orderBy("best").collect()  # a row for each language
    between, within = sum(r.means - r.total**2 / r.n for r in rows), sum(r.squares - r.means for r in rows)
    groups, rest = sum(r.texts - 1 for r in rows), sum(r.n - r.texts for r in rows)
    if groups < 1 or rest < 1 or within <= 0:
        return 0.0
    size = sum(r.n - r.nn / r.n for r in rows) / groups
    noise = within / rest
    texts = max(between / groups - noise, 0.0) / size
    return texts / (texts + noise)


def _posterior(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _floats(a: np.ndarray) -> pa.Array:
    n, k = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k), pa.int32()), pa.array(a.ravel(), pa.float64()))


def _weighed(batch: pa.RecordBatch, languages: int, rho: float) -> np.ndarray:
    """Log-likelihoods of the texts' trigrams, counted as so many independent ones as ``rho`` leaves."""
    logs = batch.column("logs").flatten().to_numpy().reshape(len(batch), languages)
    return logs / (1 + np.maximum(batch.column("n").to_numpy() - 1, 0) * rho)[:, None]


def identify(evidence: DataFrame, min_confidence: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id, key, language, confidence, n_letters, rejected`` for ``evidence (id, text, declared, suffix, host)`` with an optional ``key``."""
    spark = evidence.sparkSession
    if "key" not in evidence.columns:
        evidence = evidence.withColumn("key", F.lit(0).cast("long"))
    evidence = evidence.withColumn("declared", F.lower(F.regexp_extract(F.trim(F.coalesce("declared", F.lit(""))), "^[A-Za-z]{2,3}", 0)))
    counts = evidence.where("declared <> ''").groupBy("declared").agg(F.count("*").alias("n")).collect()  # codes of two or three letters
    tops = sorted(((r.n, r.declared) for r in counts), key=lambda r: (-r[0], r[1]))
    taken = {name: n for n, name in tops}
    languages = sorted(taken)
    if not languages:
        return evidence.select("id", "key", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("n_letters"), F.lit(True).alias("rejected"))
    model = spark.sparkContext.broadcast(fit_text_models(evidence, {name: taken[name] for name in languages}, fit_rows))  # BUCKETS x languages

    made = pa.schema([*((c, pa.int64()) for c in ("id", "key")), *((c, pa.string()) for c in ("declared", "suffix", "host")), ("n_letters", pa.int64()), ("n", pa.int64()), ("best", pa.int32()), ("total", pa.float64()), ("squares", pa.float64()), ("logs", pa.list_(pa.float64()))])

    def likelihoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value
        beyond = np.ascontiguousarray((logs - logs.mean(1, keepdims=True)).T, dtype=np.float64)
        for batch in batches:
            sums, letters, seen, squares = np.zeros((len(batch), logs.shape[1])), [], [], []
            for i, text in enumerate(batch.column("text")):
                t = text.as_py()
                for grams in trigrams(t):
                    sums[i] += logs[grams].sum(0, dtype=np.float64)
                own, n, square = beyond[sums[i].argmax()], 0, 0.0
                for grams in trigrams(t):
                    x = own[grams]
                    n, square = n + len(grams), square + float(x @ x)
                seen.append(n), squares.append(square), letters.append(count_letters(t))
            best = sums.argmax(1)
            total = sums[np.arange(len(sums)), best] - sums.mean(1)
            rest = [batch.column(c) for c in ("id", "key", "declared", "suffix", "host")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(letters, pa.int64()), pa.array(seen, pa.int64()), pa.array(best, pa.int32()), pa.array(total), pa.array(squares, pa.float64()), _floats(sums)], schema=made)

    flat = evidence.select(F.col("id").cast("long").alias("id"), "key", text_or_empty(F.col("text")).alias("text"), "declared", text_or_empty(F.col("suffix")).alias("suffix"), text_or_empty(F.col("host")).alias("host"))
    kinds = "id long, key long, declared string, suffix string, host string, n_letters long, n long, best int, total double, squares double, logs array<double>"
    scored = materialize(flat.mapInArrow(likelihoods, kinds), "likelihoods")
    rho = dispersion(scored)

    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _floats(_posterior(_weighed(batch, len(languages), rho)))], names=["suffix", "host", "d", "post"])

    k = range(len(languages))
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in k]
    declared = F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared") != "", "?").otherwise("")
    lettered = scored.where("n_letters > 0").select("suffix", "host", declared.alias("d"), "n", "logs")
    post = lettered.mapInArrow(posteriors, "suffix string, host string, d string, post array<double>")
    cells = materialize(post.groupBy("suffix", "host", "d").agg(*[F.sum(F.col("post")[i]).alias(f"s{i}") for i in k]), "cells")
    hosts = cells.groupBy("suffix", "host").agg(*again)
    suffixes = hosts.groupBy("suffix").agg(*again)
    total = np.array([float(v or 0) for v in suffixes.agg(*again).first()]) + 0.5
    total /= total.sum()

    def smoothed(prefix: str, below: list, weight: float) -> list:
        return [(F.col(f"{prefix}{i}") + weight * below[i]) / (F.col("n") + weight) for i in k]

    number = F.aggregate(F.array(*[F.col(f"s{i}") for i in k]), F.lit(0.0), lambda a, b: a + b).alias("n")
    by_suffix = suffixes.select("*", number).select("suffix", *[p.alias(f"q{i}") for i, p in enumerate(smoothed("s", [F.lit(float(v)) for v in total], SUFFIX_WEIGHT))])
    prior = hosts.select("*", number).join(by_suffix, "suffix").select("suffix", "host", F.array(*smoothed("s", [F.col(f"q{i}") for i in k], HOST_WEIGHT)).alias("prior"))
    salted = prior.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))  # a host may hold a third of all records

    seen = {r[0]: np.array([float(v) for v in r[1:]]) for r in cells.where("d <> ''").groupBy("d").agg(*again).collect()}
    names = [*languages, "?"]
    trust = np.array([seen.get(d, np.zeros(len(languages))) for d in names]) + DECLARED_WEIGHT
    trust = np.log(trust / trust.sum(0))

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {d: i for i, d in enumerate(names)}
        for batch in batches:
            if not len(batch):
                continue
            shape = (len(batch), len(languages))
            logs = _weighed(batch, len(languages), rho) + np.log(
                np.array([p if p is not None else total for p in batch.column("prior").to_pylist()], dtype=np.float64).reshape(shape))
            for i, d in enumerate(batch.column("declared").to_pylist()):
                if d:
                    logs[i] += trust[of.get(d, len(languages))]
            post = _posterior(logs)
            best, letters = post.argmax(1), batch.column("n_letters").to_numpy()
            sure = post[np.arange(len(best)), best]
            bad = (letters == 0) | (sure < min_confidence)
            named = pa.array([None if n == 0 else languages[i] for i, n in zip(best, letters, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), named, pa.array(np.where(letters == 0, 0.0, sure)), batch.column("n_letters"), pa.array(bad)], names=["id", "key", "language", "confidence", "n_letters", "rejected"])

    joined = scored.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int")).join(salted, ["suffix", "host", "salt"], "left")
    return joined.select("id", "key", "declared", "n_letters", "n", "logs", "prior").mapInArrow(fuse, "id long, key long, language string, confidence double, n_letters long, rejected boolean")


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents: ``lang`` is the declaration, ``source`` the host; an address suffix where the source has one."""
    return docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text", "lang", "source").alias("key"), "text", F.col("lang").alias("declared"), F.regexp_extract(F.coalesce("source", F.lit("")), r"\.([A-Za-z]+)$", 1).alias("suffix"), F.col("source").alias("host"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages: the ``lang`` attribute of the html tag, the suffix of the address and its host; markup is taken out of the text."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    declared = F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), declared.alias("declared"), F.regexp_extract(host, r"\.([a-z]+)$", 1).alias("suffix"), host.alias("host"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with all their columns."""
    key = free_name(docs, "key")
    rejected = identify(document_evidence(docs)).where("rejected").select(F.col("key").alias(key))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text", "lang", "source"))
    return without(keyed, rejected, key).select(docs.columns)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(document_evidence(table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "language", "confidence", "n_letters", (~F.col("rejected")).alias("kept"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(page_evidence(table(spark, sf_dir, "pages")))
    return found.select(F.col("id").alias("page_id"), "language", "confidence", "n_letters", (~F.col("rejected")).alias("kept"))

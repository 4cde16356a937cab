"""Operator 11 against all periods of small texts, in one piece and dealt in tiles."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from fathomline.llm import periodic as M
from fathomline.llm import registry


def runs_by_all_periods(w):
    """``start, period, length`` of every run, by comparing all words at every distance."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
            i = max(i, s + 1)
    return sorted((s, q, length) for (s, length), q in out.items())


def altered(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = altered(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    runs = runs_by_all_periods(words)
    dropped = {i for s, q, length in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = None
    for s, q, length in runs:
        if best is None or length * best[1] > best[2] * q:
            best = s, q, length
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{length},{q}\n" for s, q, length in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def made_words(r, n, k):
    w = []
    while len(w) < n:
        unit = [str(r.randrange(k)) for _ in range(r.randint(1, 14))]
        w += (unit * 9)[: r.randint(1, 9 * len(unit))] if r.random() < 0.5 else unit
    return w[:n]


@pytest.mark.parametrize("reach", [1, 3, 32])
def test_tiles_find_every_run(monkeypatch, reach):
    monkeypatch.setattr(M, "REACH", reach)
    r = random.Random(reach)
    for _ in range(250):
        w = made_words(r, r.choice([0, 1, 5, 6, 7, 20, 60, 300]), r.choice([1, 2, 3, 5]))
        found = {}
        for s, e, q in M.solve(M.word_ids([x.encode() for x in w]), len(w)).tolist():
            if e - s + q >= max(6, 4 * q):
                found[s, e - s + q] = min(q, found.get((s, e - s + q), q))
        assert sorted((s, q, length) for (s, length), q in found.items()) == runs_by_all_periods(w)


def awkward():
    r = random.Random(5)
    texts = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "x\x0by\x0c" * 5, "é é " * 6, "  " * 7, "w " * 1500, " ".join(map(str, range(900)))]
    texts += [" ".join(made_words(r, n, k)) for n, k in ((40, 2), (200, 3), (500, 4), (1200, 6))]
    texts += ["one two three four five\n" * 40, ("a b c d e f g h i j " * 30 + "z ") * 5]
    return [(i + 20, t) for i, t in enumerate(texts)] + [(20 + 6, texts[6]), (20 + 6, "other text of the same id " * 9), (None, "b " * 9), (None, "b " * 9), (-7, "c d " * 9)]


@pytest.mark.parametrize(("long", "sent"), [(M.LONG, M.MAX_SENT_RUNS), (50, 0)])
def test_rows_equal_brute_force(spark, monkeypatch, tmp_path, long, sent):
    """Once with whole texts and sent runs, once with dealt tiles in many rows and shuffled runs."""
    monkeypatch.setattr(M, "LONG", long)
    monkeypatch.setattr(M, "MAX_SENT_RUNS", sent)
    if long == 50:
        monkeypatch.setattr(M, "SPREAD", 64)
    rows = awkward()
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as runs", "doc_id as key", "1 as start").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:2], r[6])
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((expected(i, t) for i, t in rows), key=key)


def test_no_rows(spark):
    assert M.collapse_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = registry.QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got) >= 10
    for r in got:
        assert tuple(r) == expected(r.doc_id, docs[r.doc_id])


def test_time_in_proportion_to_one_repeated_word():
    took = []
    for n in (100_000, 400_000):
        began = time.perf_counter()
        assert len(M.solve(np.zeros(n, np.int32), n)) == 1
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.05)

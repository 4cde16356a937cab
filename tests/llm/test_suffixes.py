"""Operator 13 against all 50-byte strings of small tables, and its suffix order against sorted suffixes."""

import hashlib
import random

import numpy as np
import pytest

from fathomline.llm import registry
from fathomline.llm import suffixes as M


def by_all_strings(rows):
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of ``(doc_id, text)`` by the definition."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - 49):
                least[t[i : i + 50]] = min(d, least.get(t[i : i + 50], d))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, dtype=np.int8)
        for i in range(len(t) - 49):
            if d is not None and least[t[i : i + 50]] < d:
                gone[i : i + 50] = 1
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("depth", [3, 9, 50])
def test_suffix_order(depth):
    r = random.Random(depth)
    for _ in range(400):
        n, k, s = r.choice([0, 1, 2, 3, 4, 5, 6, 7, 20, 300]), r.choice([1, 2, 3, 250]), []
        while len(s) < n:
            s += [r.randint(1, k) for _ in range(r.randint(1, 30))] * r.randint(1, 4)
        s = s[:n]
        smaller = M.suffix_order(np.array(s, dtype=np.int64), depth)
        prefixes = [s[i : i + depth] for i in np.argsort(smaller, kind="stable")]
        assert prefixes == sorted(prefixes)


def test_contexts_cover_every_string_once_and_equal_strings_have_equal_anchors(monkeypatch):
    monkeypatch.setattr(M, "PIECE", 70)
    r = random.Random(3)
    texts = ["".join(r.choice("ab ") for _ in range(n)).encode() for n in (0, 49, 50, 51, 400, 30, 700)]
    c = M.Contexts(np.arange(len(texts)), [*texts])
    seen, anchor_of = [], {}
    for a, start, count in zip(c.anchor.tolist(), c.start.tolist(), c.count.tolist(), strict=True):
        for i in range(start, start + count):
            seen.append(i)
            assert anchor_of.setdefault(c.data[i : i + 50], a) == a
    want = [int(c.bounds[k]) + i for k, t in enumerate(texts) for i in range(len(t) - 49)]
    assert sorted(seen) == want and c.count.max() <= 35


def awkward():
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passages = [word(n) for n in (49, 50, 51, 90, 300, 2000)]
    rows = [(i, word(r.randint(0, 80)) + r.choice(passages) + word(r.randint(0, 80)) + (r.choice(passages) if i % 3 else "")) for i in range(60)]
    rows += [(100 + i, passages[3] + f" copy {i % 3}") for i in range(40)] + [(200, "x" * 5000), (201, "x" * 49), (202, "x" * 51), (203, None), (204, ""), (205, "\n" * 120)]
    rows += [(-9, passages[5]), (300, passages[5]), (300, passages[5]), (300, "other " + passages[4]), (None, passages[5]), (None, None), (301, passages[4] * 30), (302, "x" * 200_000)]
    return rows


@pytest.mark.parametrize("most", [0, 2, 15])
def test_hot_anchors_in_many_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(M, "BLOCK", 4000)
    got = M.cut_repeats(spark.createDataFrame(awkward(), "doc_id long, text string"), most).collect()
    rows = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got]
    assert sorted(rows, key=repr) == by_all_strings(awkward())


@pytest.mark.parametrize("block", [M.BLOCK, 4000])
def test_rows_equal_brute_force(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = awkward()
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "text as kept", "2 as shard").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["op13_repeated_passages"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_all_strings(rows)


def test_no_rows(spark):
    assert M.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spans_and_kept_bytes(spark):
    passage = "".join(chr(97 + i * i % 26) for i in range(80))
    rows = {r.doc_id: r for r in M.cut_repeats(spark.createDataFrame([(1, "A" + passage), (2, f"<{passage}>"), (3, passage[:49])], "doc_id long, text string")).collect()}
    assert [tuple(s) for s in rows[2].spans] == [(1, 81)] and bytes(rows[2].kept) == b"<>"
    assert not rows[1].spans and not rows[3].spans


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op13_repeated_passages"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == by_all_strings(docs)
    assert sum(r.n_removed > 0 for r in got) > 10

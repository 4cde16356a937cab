"""Operators on vectors, linked components, and the pipeline against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_text_operators import slow_classes, slow_fingerprint, token_rows, check_packing

import corpus_pipeline
from fathomline.llm import forest, toxicity, vafile
from fathomline.llm.common import linked_components


def rows_of(x, labels=None):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], 0 if labels is None else labels[i]) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    near = base[:60] + 0.02 * rng.standard_normal((60, 32))
    dense = base[0] + 0.012 * rng.standard_normal((150, 32))
    x = np.concatenate([base, near, dense, base[5:8], base[5:8]])
    return x, rng.integers(0, 3, len(x))


def brute_links(x, labels, threshold=0.98):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = (u @ u.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(links, False)
    comp = np.arange(len(x))
    while True:
        new = np.where(links, comp[None, :], len(x)).min(1)
        new = np.minimum(comp, new)
        if (new == comp).all():
            return links.sum(1), comp
        comp = new


def test_forest_finds_links(spark, planted):
    x, labels = planted
    df = spark.createDataFrame(rows_of(x, labels.tolist()), "vec_id long, embedding array<double>, label int")
    degree, comp = brute_links(x, labels)
    got = {r.vec_id: r for r in forest.near_duplicates(df, leaf=40).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= degree).all() and found.sum() >= 0.9 * degree.sum() and found.sum() > 1000
    assert np.mean([got[i].component_id == comp[i] for i in range(len(x))]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_large_leaves_are_cut_into_blocks(spark, planted, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 16)
    x, labels = planted
    df = spark.createDataFrame(rows_of(x, labels.tolist()), "vec_id long, embedding array<double>, label int")
    degree, _ = brute_links(x, labels)
    found = {r.vec_id: r.n_links for r in forest.near_duplicates(df, leaf=40).collect()}
    assert sum(found.values()) >= 0.9 * degree.sum() and all(found[i] <= degree[i] for i in found)


@pytest.mark.parametrize("noise", [0.002, 0.012, 0.03])
def test_dense_groups_by_representatives(spark, monkeypatch, noise):
    """Two groups of near copies that no split divides, with vectors at their rims, against brute force."""
    monkeypatch.setattr(forest, "BLOCK", 24)
    rng = np.random.default_rng(13)
    base = rng.standard_normal((120, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    x = np.concatenate([base, base[0] + noise * rng.standard_normal((200, 24)), base[1] + noise * rng.standard_normal((90, 24)), base[0] + 0.03 * rng.standard_normal((60, 24)), base[:2], base[:2]])
    labels = np.zeros(len(x), dtype=np.int64)
    df = spark.createDataFrame(rows_of(x, labels.tolist()), "vec_id long, embedding array<double>, label int")
    degree, comp = brute_links(x, labels)
    got = {r.vec_id: r for r in forest.near_duplicates(df, leaf=40).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= degree).all() and found.sum() >= 0.98 * degree.sum()
    assert np.mean([got[i].component_id == comp[i] for i in range(len(x))]) > 0.97


def test_tiny_and_huge_components(spark):
    rows = [(1, [1e-200, 2e-200], 1), (2, [1e200, 2e200], 1), (3, [1.0, 2.0], 1), (4, [2e-310, 4e-310], 1), (5, [1.0, -2.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}


def test_forest_groups_run_over_batches():
    label, leaf = ["a"] * 3 + ["b"] * 9 + ["c"], [0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2]
    whole = pa.record_batch({"label": pa.array(label), "leaf": pa.array(leaf, pa.int32()), "id": pa.array(range(13), pa.int64())})
    want = [[0, 1], [2], list(range(3, 11)), [11], [12]]
    for size in range(1, 14):
        batches = [whole.slice(at, size) for at in range(0, 13, size)] + [whole.slice(0, 0)]
        assert [g.column("id").to_pylist() for g in forest._runs(iter(batches), ["label", "leaf"])] == want
    assert list(forest._runs(iter([]), ["label", "leaf"])) == []


def test_forest_edges(spark):
    v = [1.0, 0.0, 0.0]
    rows = [(1, v, 1), (2, [2.0, 0.0, 0.0], 1), (3, v, 2), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 0.0], 1), (7, [float("nan"), 0.0, 1.0], 1), (8, [float("inf"), 0.0, 0.0], 1), (9, v, None), (10, v, 1), (11, [1.0, 0.0], 1), (10, v, 1), (None, v, 1), (12, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("x", "id", "copies", "leaf")})
    got = forest.near_duplicates(df).collect()
    assert len(got) == len(rows)
    of = {r.vec_id: (r.n_links, r.component_id) for r in got}
    assert of[1] == (3, 1) and of[2] == (3, 1) and of[10] == (3, 1)
    assert all(of[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12)) and of[None] == (0, None)
    assert forest.near_duplicates(df.where("false")).count() == 0


def brute_top(ids, ints, k=5):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 50 == 0:
            score = ints @ ints[i]
            others = np.flatnonzero(ids != ids[i])
            best = others[np.lexsort((ids[others], -score[others]))[:k]]
            out[int(ids[i])] = [(int(ids[j]), int(score[j])) for j in best]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_top_k(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    assert answers(vafile.op10_top_k(spark, sf)) == brute_top(ids, np.floor(256 * x).astype(np.int64))


def test_top_k_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vafile, "QUERY_ROWS", 3)
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (400, 6)) / 2.0
    x[100:200] = x[50]  # a third are copies
    ints = vafile.scaled(spark.createDataFrame(rows_of(x), "vec_id long, embedding array<double>, label int"))
    got = answers(vafile.top_k(ints, ints.where("vec_id % 50 = 0"), block_rows=7))
    assert got == brute_top(np.arange(400), np.floor(256 * x).astype(np.int64))
    blocks = vafile.build_blocks(ints.withColumn("n", F.lit(1)), block_rows=7)
    assert sum(len(r.ids) // 16 for r in blocks.collect()) == 400


def test_top_k_of_integers_of_any_size(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 5)) * 10.0 ** rng.integers(-2, 8, (300, 1))
    x[7], x[50] = [2e6, 1.0, 0, 0, 0], [3e30, -1e30, 0, 1, 0]
    rows = [[int(np.floor(256 * v)) for v in r] for r in x.tolist()]
    want = {}
    for q in range(0, 300, 50):
        score = {j: sum(a * b for a, b in zip(rows[j], rows[q])) for j in range(300) if j != q}
        want[q] = [(j, max(-(1 << 63), min((1 << 63) - 1, score[j]))) for j in sorted(score, key=lambda j: (-score[j], j))[:5]]
    ints = vafile.scaled(spark.createDataFrame(rows_of(x), "vec_id long, embedding array<double>, label int"))
    assert answers(vafile.top_k(ints, ints.where("vec_id % 50 = 0"), block_rows=40)) == want
    assert any(abs(s) > 1 << 53 for r in want.values() for _, s in r)
    two = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [2000000.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert answers(vafile.top_k(vafile.scaled(two), vafile.scaled(two).where("vec_id = 0"))) == {0: [(1, 256 * 512_000_000 + 512 * 256)]}


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(9)
    ints = np.floor(rng.standard_normal((500, 16)) * 3000)
    queries = np.floor(rng.standard_normal((20, 16)) * 3000)
    low, high = ints.min(0), ints.max(0)
    width = np.floor((high - low) / vafile.CELLS) + 1
    down, up = vafile.bounds(np.floor((ints - low) / width).astype(np.uint8), low, width, queries)
    score = ints @ queries.T
    assert (down <= score).all() and (score <= up).all()
    assert np.mean(up >= np.sort(down, axis=0)[-5]) < 0.1  # few vectors are left to read


def test_top_k_edges(spark):
    rows = [(0, [0.5, -0.25], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [0.25, 0.25], 1), (5, [0.25, 0.25], 1), (None, [1.0, 1.0], 1), (50, [1.0, 2.0, 3.0], 1), (100, [], 1), (0, [0.5, -0.25], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("ints", "score", "rank", "n", "qid")})
    ints = vafile.scaled(df)
    assert answers(vafile.top_k(ints, ints.where("vec_id % 50 = 0"))) == {0: [(5, 4096), (5, 4096)]}
    none = ints.where("false")
    assert vafile.top_k(none, none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 33])
def test_components_of_chains(spark, n):
    order = np.random.default_rng(n).permutation(n + 1)
    edges = [(int(order[i]), int(order[i + 1])) for i in range(n)] + [(1000, 1001), (1001, 1000), (5000, 5000), (None, 3)]
    got = {r.id: r.component_id for r in linked_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[int(i)] == 0 for i in order) and got[1000] == got[1001] == 1000 and 5000 not in got


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept, stages = docs, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_dedup", "packing"]
    kept = stages["language_id"](spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    scorer = toxicity.Scorer(toxicity.train(docs, labels), 2.0)
    clean = {r.doc_id: r.text for r in docs.collect() if scorer.score(r.text or "")[0] < 0.5}
    classes = slow_classes([(d, slow_fingerprint(t or "")) for d, t in clean.items()])
    want = {d for d, c in classes.items() if d == c}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == want
    check_packing(rows, token_rows({d: clean[d] for d in want}, 0), 2048)
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(toxic & set(clean)) <= 0.2 * len(toxic)


def test_stages_on_odd_documents(spark, sf):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "good words in a text", "en", "s", 20), (3, "good words in a text", "en", "s", 20), (None, "good words in a text", "en", "s", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.where("false")):
            out = stage(spark, some, sf)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= len(rows)

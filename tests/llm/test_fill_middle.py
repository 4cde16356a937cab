"""Operator 12 against a plain implementation and DuckDB."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from fathomline.llm import fill_middle as M
from fathomline.llm import registry


def plain_form(doc_id, text, seed=7):
    """The result row by the definition, with strings."""
    text = text or ""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in range(0, 32, 8)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_scatter_and_gather_in_blocks(monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    r = random.Random(block)
    for _ in range(150):
        texts = ["".join(r.choice(["a", "\n", "é", "<", "P>", "S", "😀", "<M", " "]) for _ in range(r.choice([0, 1, 3, 60]))).encode() for _ in range(r.randint(0, 5))]
        k = len(texts)
        draws = np.array([[r.randrange(1 << 32), r.randrange(1 << 32)] for _ in texts], dtype=np.int64).reshape(k, 2)
        out, offsets, _, form, _, _ = M.transform(texts, draws, np.array([r.random() < 0.1 for _ in texts], bool), np.array([r.random() < 0.5 for _ in texts], bool))
        outputs = [out[offsets[i] : offsets[i + 1]].tobytes() for i in range(k)]
        back, to = M.restore(outputs, form == M.PLAIN)
        assert [back[to[i] : to[i + 1]].tobytes() for i in range(k)] == texts


def awkward():
    texts = [None, "", "\n", "\n\n\n", "one line", "one line\n", "a\nb", "a\r\nb\x00\n", "<P> in it\nb\n", "< P>\n<S\n>", "é\n😀\nß", "x" * 300_000 + "\n" + "y\n" * 50_000, "<<P\n>>\n<M"]
    rows = [(i, t, "zz") for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], (None, "no\nid\n", "zz"), (-5, "negative\nid\n", "zz"), (1 << 60, "a\nb\nc\nd\n" * 100, "zz")]


def test_awkward_rows_with_clashing_columns(spark):
    rows = awkward()
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").selectExpr("doc_id", "text", "output", "output as n", "output as form", "output as digest__")
    out = M.restore_texts(M.fill_in_middle(docs)).collect()
    order = lambda row: (row[0] is None, row[0] or 0)
    assert sorted((tuple(r)[:6] for r in out), key=order) == sorted((plain_form(i, t) for i, t, _ in rows), key=order)
    assert sorted((r.text for r in out)) == sorted((t or "") for _, t, _ in rows)
    assert M.restore_texts(M.fill_in_middle(docs.limit(0))).count() == 0


def test_rates(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(400)], "doc_id long, text string")
    forms = [r.form for r in M.fill_in_middle(docs, fim_rate=50, spm_rate=0).collect()]
    assert 120 < forms.count("psm") < 280 and not forms.count("spm") and len(forms) == 400


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = registry.QUERIES["op12_fill_in_middle"](spark, sf)
    want = con.execute(registry.ORACLE_SQL["op12_fill_in_middle"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(want.fetchall())


def test_sql_on_awkward_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, _ in awkward() if "\x00" not in (t or "")])
    want = con.execute(f"SELECT doc_id, n, form, prefix_chars, middle_chars, output_sha256 FROM ({M.SQL})").fetchall()
    rows = [plain_form(i, t) for i, t, _ in awkward() if "\x00" not in (t or "")]
    assert sorted(map(repr, want)) == sorted(repr((*r[:5], hashlib.sha256(r[5].encode()).hexdigest())) for r in rows)

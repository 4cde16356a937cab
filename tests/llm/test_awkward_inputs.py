"""Texts, pages, vectors and labels that once broke an operator or took it quadratic time."""

import json
import random
import time

import public_tokenizers
import pytest

from fathomline.llm import forest, language, licenses, merges, simhash, toxicity
from fathomline.llm.sitetree import _TOKEN, Page, _tokens


def test_blank_lines_and_dashed_tokens_do_not_overflow_the_stack(spark):
    texts = ["Released under the MIT License" + "\n" * 200_000 + "the end", "Released under the MIT License\n" + "# \n" * 100_000, "Released under the MIT License " + "a-" * 200_000 + "a", "Released under the MIT License\n\n" + "x.1-" * 100_000]
    files = spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(texts)], "file_id long, path string, text string")
    got = {r.file_id: r.license for r in licenses.scan(files).collect()}
    assert got[0] == got[1] == got[3] == "MIT" and len(got) == 4


def test_every_declared_language_can_be_returned(spark):
    """70 languages, each declared by five records only."""
    r = random.Random(1)
    rows = []
    for k in range(70):
        name = chr(97 + k // 26) + chr(97 + k % 26) + "q"
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(r.choice(words) for _ in range(60)), name, None, None) for i in range(5)]
    evidence = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")
    got = {x.id: x.language for x in language.identify(evidence).collect()}
    assert len(set(got.values())) == 70 and all(got[x[0]] == x[2] for x in rows)


@pytest.mark.parametrize("texts", [["!!!", "???"], ["", ""]])
def test_labels_without_any_word(texts):
    model = toxicity.NoisyOr.fit(texts, [0, 1])
    assert toxicity.Scorer(model, 0.5).score("some words")[0] == 0.5


def test_long_words_merge_as_short_ones_do(monkeypatch):
    spec = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))["model"]
    table = merges.MergeTable(spec["vocab"], spec["merges"], spec["end_of_word_suffix"] or "")
    r = random.Random(2)
    words = [bytes(r.choice(b"aabcdeinrst\xc3\xa9") for _ in range(r.randint(1, 500))) for _ in range(150)]
    monkeypatch.setattr(merges, "LONG", 1 << 30)
    want = table.encode(words)
    monkeypatch.setattr(merges, "LONG", 0)
    assert table.encode(words) == want
    took = []
    for n in (50_000, 200_000):
        began = time.perf_counter()
        table.encode([bytes(r.choice(b"acgt") for _ in range(n))])
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


@pytest.mark.parametrize("piece", ["<a ", '<p class="x', "<p class='", "<!-- x", "<script", "< ", '<x y="a>', "<![CDATA["])
def test_malformed_pages_take_linear_time(piece):
    took = []
    for n in (30_000, 120_000):
        began = time.perf_counter()
        Page(piece * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.02)


def test_tokens_are_those_of_one_pattern():
    r = random.Random(3)
    parts = ["<a ", ">", '"', "'", '<p class="x">', "</p>", "<!--", "-->", "<script>", "</script>", "<![CDATA[", "]]>", "text ", "<", "<!x", "&amp;", "/"]
    for _ in range(3000):
        page = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        both = [[tuple(m.group(i) for i in range(8)) for m in found] for found in (_TOKEN.finditer(page), _tokens(page))]
        assert both[0] == both[1]


def test_one_id_with_two_vectors_joins_nothing(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (1, [1.0, 0.01]), (7, [0.01, 1.0]), (9, [0.02, 1.0]), (-1, [-1.0, 0.0])]
    vectors = spark.createDataFrame([(i, x, "l") for i, x in rows], "vec_id long, embedding array<double>, label string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(vectors).collect())
    assert got == [(-1, 0, -1, True), (1, 1, 1, True), (5, 1, 1, False), (5, 2, 5, True), (7, 2, 5, False), (9, 2, 5, False)]


def test_one_id_with_two_texts_joins_nothing(spark):
    a, b, c = (" ".join(random.Random(k).choice("abcdefgh") * 3 for _ in range(300)) for k in (1, 2, 3))
    docs = spark.createDataFrame([(5, a), (5, b), (9, b), (3, a), (20, c)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in simhash.simhash_classes(docs).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (9, 5), (20, 20)]


def test_every_template_is_found_alone(spark):
    files = spark.createDataFrame([(i, f"d{i}/f", text) for i, (_, text) in enumerate(licenses.TEMPLATES)], "file_id long, path string, text string")
    got = {r.file_id: (r.license, r.cosine) for r in licenses.scan(files).collect()}
    by_text: dict = {}
    for name, text in licenses.TEMPLATES:
        by_text.setdefault(text, set()).add(name)
    assert all(got[i][0] in by_text[text] and got[i][1] > 0.99 for i, (_, text) in enumerate(licenses.TEMPLATES))


def test_whole_licence_files_license_their_folders(spark):
    warranty = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE\nWARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.\n'
    mit = """Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

"""
    isc = """Copyright (c) 2021, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

"""
    bsd = """Copyright (c) 2021, Some One

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

"""
    third = """* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

"""
    grant = """2. Grant of Copyright License. Subject to the terms and conditions of
   this License, each Contributor hereby grants to You a perpetual,
   worldwide, non-exclusive, no-charge, royalty-free, irrevocable
   copyright license to reproduce, prepare Derivative Works of,
   publicly display, publicly perform, sublicense, and distribute the
   Work and such Derivative Works in Source or Object form.
"""
    lesser = """This version of the GNU Lesser General Public License incorporates
the terms and conditions of version 3 of the GNU General Public
License, supplemented by the additional permissions listed below.
"""
    said = {"MIT": mit + warranty, "ISC": isc + warranty, "BSD-2-Clause": bsd + warranty, "BSD-3-Clause": bsd + third + warranty, "Apache-2.0": grant, "LGPL-3.0": lesser,
            "GPL-3.0": "The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n"}
    rows = [r for i, text in enumerate(said.values()) for r in ((2 * i, f"p{i}/LICENSE", text), (2 * i + 1, f"p{i}/src/deep/a.c", "int x;"))]
    rows += [(100, "q/notes", "We granted a license to the shop, and all rights are reserved."), (101, "q/b", "Copyright of the software is with the authors.")]
    got = {r.file_id: (r.license, r.how) for r in licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert [got[2 * i] for i in range(len(said))] == [(name, "own") for name in said]
    assert [got[2 * i + 1] for i in range(len(said))] == [(name, "inherited") for name in said]
    assert got[100] == got[101] == (None, "none")

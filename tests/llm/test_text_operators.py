"""Operators on texts: exact results against brute force, and the edge cases each docstring names."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from itertools import groupby
from urllib.parse import urlsplit

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fathomline.llm import language, lexicon, license_sql, licenses, packing, simhash, sitetree, toxicity, wavelet
from fathomline.llm.byte_tokens import ByteTokens, default_tokenizer
from fathomline.llm.merges import MergeTable

LONG = "word " * 30_000 + "end."
ODD = [(1, "a b c d", "x"), (2, None, "x"), (3, "", "x"), (4, LONG, "x"), (5, "a b c d", "x"), (5, "a b c d", "x"), (None, "a b c d", "x"), (7, "é <|endoftext|> \t\n  x\x1cy \U0001f600", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    clash = {c: F.lit(0) for c in ("fp", "key", "h", "part", "rank", "score", "length", "n", "label")}
    return spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumns(clash)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_byte_tokens_equal_the_library():
    library, own = Tokenizer.from_file(default_tokenizer()), ByteTokens(default_tokenizer())
    rng = np.random.default_rng(3)
    letters = list("abc déÉ'sT ll re.,!?12½ß漢 \n\t\U0001f600<>_|-\x1c\x85\xa0")
    for text in ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(1500)] + ["", "<|endoftext|>x", " a", "it's  we'll", "a" * 3000]:
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_merge_table_equals_the_library():
    tokenizer = lexicon.WordTokenizer(default_tokenizer("word_bpe_49k.json"))
    library = Tokenizer.from_file(default_tokenizer("word_bpe_49k.json"))
    words = ["a", "hello", "qzxv", "été", "antidisestablishmentarianism"]
    for word, ids in zip(words, tokenizer.table.encode([w.encode() for w in words]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    assert MergeTable.encode(tokenizer.table, [b""]) == [b""]


def token_rows(texts, end):
    library = Tokenizer.from_file(default_tokenizer())
    return {d: library.encode(t or "", add_special_tokens=False).ids + [end] for d, t in texts.items()}


def test_token_output(spark, sf, texts):
    want, start = {}, 0
    for d, ids in sorted(token_rows(texts, 2).items()):
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = wavelet.op7_token_output(spark, sf).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_token_output_edges(spark, odd):
    rows = wavelet.read_token_shards(wavelet.write_token_shards(odd, shard_tokens=1)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 7]
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()
    assert rows[2].n_tokens == rows[3].n_tokens == 1
    assert wavelet.read_token_shards(wavelet.write_token_shards(odd.where("false"))).count() == 0


@pytest.mark.parametrize(("n", "frame"), [(1, 8192), (7, 8192), (511, 64), (512, 64), (513, 64), (3000, 128), (3000, 8192)])
def test_wavelet_matrix_queries(n, frame, monkeypatch):
    monkeypatch.setattr(wavelet, "_FRAME", frame)
    ids = np.random.default_rng(n).integers(0, 40, n).astype("<u2")
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 6).to_bytes())
    assert m.decode().tolist() == ids.tolist()
    for i in {0, n // 2, n - 1}:
        assert m.access(i) == ids[i]
    for token in (0, 17, 39, 63):
        at = np.flatnonzero(ids == token)
        assert m.rank(token) == len(at) and m.rank(token, n // 2) == (at < n // 2).sum()
        assert [m.select(token, k) for k in range(min(len(at), 3))] == at[:3].tolist()
        assert m.select(token, len(at)) == -1


def test_token_occurrences(spark, docs, texts):
    shards = wavelet.write_token_shards(docs, shard_tokens=5000)
    common = Counter(i for ids in token_rows(texts, 2).values() for i in ids).most_common(1)[0]
    assert wavelet.token_occurrences(shards, common[0]).agg(F.sum("n")).first()[0] == common[1]
    one = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(np.arange(1 << 18).astype("<u4") % 50_000, 16).to_bytes())
    assert one.access(200_000) == 0 and sum(len(p.open) for p in one.planes) == 16  # of 64 frames
    ends = wavelet.token_occurrences(shards, 2)
    assert ends.agg(F.sum("n")).first()[0] == len(texts)


def check_packing(rows, ids, capacity):
    bins = {}
    for r in rows:
        got = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(got, "<u4").tobytes()) == r.ids_crc32 and len(got) == r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
        assert sum(n for _, n in parts) <= capacity
    return len(bins)


def test_packing(spark, sf, texts):
    ids = token_rows(texts, 0)
    rows = packing.op8_packing(spark, sf).collect()
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    n = check_packing(rows, ids, 2048)
    assert n <= -(-sum(map(len, ids.values())) // 2048) + 2
    for d, own in ids.items():
        assert sum(r.doc_id == d for r in rows) == -(-len(own) // 2048)


def test_packing_edges(spark, odd):
    rows = packing.pack_documents(odd, capacity=64).collect()
    assert sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert [r.length for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert packing.pack_documents(odd.where("false")).count() == 0


def optimum(items, capacity):
    """Fewest bins, by search over the bins of the longest item."""
    items = sorted(items, reverse=True)

    def go(rest, limit):
        if not rest:
            return 0
        if limit <= 0:
            return 99
        first, others = rest[0], rest[1:]
        best, seen = 99, set()
        for mask in range(1 << len(others)):
            chosen = [others[i] for i in range(len(others)) if mask >> i & 1]
            if first + sum(chosen) <= capacity and tuple(chosen) not in seen:
                seen.add(tuple(chosen))
                best = min(best, 1 + go([others[i] for i in range(len(others)) if not mask >> i & 1], min(limit, best) - 1))
        return best

    return go(items, 99)


def test_dominance_keeps_an_optimum():
    rng = np.random.default_rng(11)
    for _ in range(60):
        items = rng.integers(1, 11, rng.integers(1, 8)).tolist()
        fixed, rest = packing.dominance_reduction(Counter(items), 10)
        left = [n for n, c in rest.items() for _ in range(c)]
        used = [n for p, c in fixed for n in p for _ in range(c)]
        assert sorted(left + used) == sorted(items)
        assert sum(c for _, c in fixed) + (optimum(left, 10) if left else 0) == optimum(items, 10)
        full = packing.pack_histogram(Counter(items), 10)
        assert sorted(n for p, c in full for n in p for _ in range(c)) == sorted(items)
        assert all(sum(p) <= 10 for p, _ in full)


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_classes(fps):
    """Smallest reachable id of each row of (id, fingerprint)."""
    comp = list(range(len(fps)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 2:
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(fps)}


def test_simhash(spark, sf, texts):
    fps = [(d, slow_fingerprint(t or "")) for d, t in texts.items()]
    want = slow_classes(fps)
    got = simhash.op9_simhash(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in fps}
    assert {r.doc_id: r.component_id for r in got} == want


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    rng = np.random.default_rng(12)
    texts = [" ".join(rng.choice(list("abcdefg"), n)) for n in (1, 2, 3, 4, 40, 300, 20_000)] + ["", "  \n ", "x" * 200, "a \x0b b\tc  D" * 30]
    for block in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(simhash, "_BLOCK", block)
        for text in texts if block > 1 else texts[:6] + texts[7:]:
            assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_simhash_chains_and_edges(spark, odd):
    base = 0x0123456789ABCDEF
    chain = [base]
    for k in range(12):  # neighbours two bits apart, ends far apart
        chain.append(chain[-1] ^ 1 << (5 * k) % 64 ^ 1 << (5 * k + 31) % 64)
    far = base ^ (1 << 3 | 1 << 30 | 1 << 60)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate([*chain, far])]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long, id long")).collect()
    values = [*chain, far]
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 2}
    assert {(r.a, r.b) for r in links} == want
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_classes(odd).select("doc_id", "component_id").collect()}
    assert {(1, 1), (5, 1), (None, 1), (2, 2), (3, 2)} <= got
    kept = simhash.keep_one_per_class(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "7", "None"]
    twice = odd.where("doc_id = 5")
    assert simhash.keep_one_per_class(twice).count() == 1
    assert simhash.simhash_classes(odd.where("false")).count() == 0


def test_word_bpe(spark, sf, texts):
    library = Tokenizer.from_file(default_tokenizer("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in lexicon.op6_word_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_word_bpe_edges(spark, odd):
    library = Tokenizer.from_file(default_tokenizer("word_bpe_49k.json"))
    rows = lexicon.decode(lexicon.encode(odd, lexicon.build_lexicon(odd, lexicon_words=2))).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _, _ in ODD)
    of = {d: t or "" for d, t, _ in ODD}
    for r in rows:
        ids = library.encode(of[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.text == library.decode(ids, skip_special_tokens=False)
    empty = odd.where("false")
    assert lexicon.encode(empty, lexicon.build_lexicon(empty)).count() == 0


def test_word_bpe_blocks_and_generations(monkeypatch):
    monkeypatch.setattr(lexicon, "BLOCK_CHARS", 40)
    monkeypatch.setattr(lexicon, "MEMO_CHUNKS", 5)
    path = default_tokenizer("word_bpe_49k.json")
    library, tokenizer = Tokenizer.from_file(path), lexicon.WordTokenizer(path)
    encoder = lexicon.Encoder(tokenizer, lexicon.Lexicon.build([], [], np.dtype("<u4")))
    rng = np.random.default_rng(6)
    letters = list("abc dé \u0301\u0308'sT ll ΣΑΣ re.,!?12½ß漢 \n\t<|endoftext|>_-\x1c\x85\xa0")
    texts = ["".join(rng.choice(letters, rng.integers(0, 400))) for _ in range(300)] + ["", "x" * 500, " " * 300, "<|endoftext|> " * 30]
    for at in range(0, len(texts), 7):
        for text, ids in zip(texts[at : at + 7], encoder.encode(texts[at : at + 7]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(encoder.memo) + len(encoder.older) < 2000


def test_lexicon_keeps_its_bound(spark):
    docs = spark.createDataFrame([(i, "same w" + "".join(chr(97 + i // 26**k % 26) for k in range(3))) for i in range(400)], "doc_id long, text string")
    name = lexicon.build_lexicon(docs, lexicon_words=100)
    n = len(lexicon._open_lexicon(name).starts) - 1
    assert 60 <= n <= 140 and lexicon.build_lexicon(docs, lexicon_words=100) == name


def test_automaton_is_minimal_and_exact(tmp_path):
    words = sorted(b"tap taps top tops stop stops".split())
    ids = [np.array([i, i + 10], "<u4").tobytes() for i in range(len(words))]
    (tmp_path / "lex").write_bytes(lexicon.Lexicon.build(words, ids, np.dtype("<u4")).to_bytes())
    lex = lexicon.Lexicon.open(str(tmp_path / "lex"))
    assert lex.index(words).tolist() == list(range(len(words)))
    assert lex.index([b"", b"ta", b"tapss", b"x"]).tolist() == [-1] * 4
    assert lex.sequence(3).tolist() == [3, 13]
    # root, t, s, st, (t|st)+vowel, +p, +s: by hand, the smallest number of states
    assert len(lex.accept) == 7


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op2_toxicity(spark, sf).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic", "n_offending").collect()
    assert len(got) > 500
    # about one toxic label in fifteen of this table stands on a text without any toxic word
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.975
    assert np.mean([r.predicted for r in got if r.toxic]) > 0.85
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.n_offending > 0 for r in got if r.toxic]) > 0.8


def slow_fit(texts, labels, epochs, significance, rate=0.1, sparsity=1e-5):
    """Weight by feature, and bias, by plain loops over documents, sentences and words."""
    bags = [[sorted(set(re.findall(r"[^\W_]+", said))) for said in re.split(r"[.!?\n]", text.lower())] for text in texts]
    n1 = sum(labels)
    n0, n = len(labels) - n1, len(labels)
    df = (Counter(), Counter())
    for bag, label in zip(bags, labels, strict=True):
        for word in set().union(*bag):
            df[label].update(toxicity.features(word))
    telling = set()
    for f in df[0] | df[1]:
        share = (df[0][f] + df[1][f] + 1) / (n + 2)
        if abs(df[1][f] / n1 - df[0][f] / n0) / math.sqrt(max(share * (1 - share), 1e-6) * (1 / n0 + 1 / n1)) >= significance:
            telling.add(f)
    weights, first, second = {f: 0.0 for f in telling} | {"bias": -5.0}, Counter(), Counter()
    for step in range(1, epochs + 1):
        slope = {f: sparsity * ((w > 0) - (w < 0)) if f != "bias" else 0.0 for f, w in weights.items()}
        for bag, label in zip(bags, labels, strict=True):
            said = [[f for word in words for f in toxicity.features(word) if f in telling] for words in bag if words]
            p = [1 / (1 + math.exp(-weights["bias"] - sum(weights[f] for f in fs))) for fs in said]
            clean = math.prod(1 - x for x in p)
            push = (-clean / (1 - clean) if label else n1 / n0) / n  # derivative of the loss by log(1 - p)
            for x, fs in zip(p, said, strict=True):
                for f in [*fs, "bias"]:
                    slope[f] += push * x
        for f, g in slope.items():
            first[f], second[f] = 0.9 * first[f] + 0.1 * g, 0.99 * second[f] + 0.01 * g * g
            weights[f] -= rate * (first[f] / (1 - 0.9**step)) / (math.sqrt(second[f] / (1 - 0.99**step)) + 1e-8)
    return weights


@pytest.mark.parametrize("epochs", [1, 7, 40])
def test_fit_equals_brute_force(epochs):
    draw = random.Random(epochs)
    words = "fine day here all good people moron idiots walk talk house idiotic morons garden".split()
    labels = [int(i % 3 == 0) for i in range(24)]
    texts = [". ".join(" ".join(draw.choices(words if label else words[:6] + words[8:11], k=draw.randint(1, 6))) for _ in range(draw.randint(1, 4))) + draw.choice(["", "!", "\n.."]) for label in labels]
    got, want = toxicity.NoisyOr.fit(texts, labels, epochs=epochs, significance=1.0), slow_fit(texts, labels, epochs, 1.0)
    assert abs(got.bias - want.pop("bias")) < 1e-6 and len(want) > 3
    assert set(np.flatnonzero(got.weights).tolist()) == {f for f, w in want.items() if w}
    assert all(abs(got.weights[f] - w) < 1e-4 for f, w in want.items())


def test_words_count_once_however_they_are_written():
    weights = np.zeros(toxicity._BUCKETS, dtype=np.float32)
    for f in toxicity.features("bad"):
        weights[f] += 1.0
    scorer = toxicity.Scorer(toxicity.NoisyOr(weights, -1.0, 0.5), 0.5)
    once = scorer.score("bad")[0]
    assert scorer.score("bad bad, (bad")[0] == scorer.score("BAD bad bad")[0] == once
    slow = lambda text: 1 - np.prod([1 - 1 / (1 + np.exp(1.0 - len(set(re.findall("[a-z]+", s)) & {"bad"}))) for s in re.split(r"[.!?\n]", text) if s.strip()])
    for text in ("good day. bad day. bad", "bad! good", "a b c. d"):
        assert abs(scorer.score(text)[0] - slow(text)) < 1e-9
    long = "fine day. " * 70_000 + "bad"
    score, n, found = scorer.score(long)
    assert n == 70_001 and found[-1][0] == len(long) - 4 and score > 0.999
    assert scorer.score(" ... !!")[:2] == (0.0, 0)


def test_toxicity_fold_and_edges(spark, odd):
    ids = spark.range(200)
    want = {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r.id for r in ids.where(toxicity.held_out(F.col("id"))).collect()} == want
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, none)
    assert {r.score for r in toxicity.score_documents(odd, model).collect()} == {0.0}
    assert toxicity.keep_clean(odd, none).count() == len(ODD)
    trained = toxicity.NoisyOr.fit(["you moron. fine day here"] * 40 + ["fine day here. all good"] * 40, [1] * 40 + [0] * 40)
    scored = {(r.doc_id, r.score) for r in toxicity.score_documents(odd, trained).collect()}
    assert {(2, 0.0), (3, 0.0)} <= scored and len(toxicity.score_documents(odd, trained).collect()) == len(ODD)
    score, n, found = toxicity.Scorer(trained, 0.5).score("All good. You MORON! fine day")
    assert score > 0.5 and n == 3 and [(a, k) for a, k, _ in found] == [(9, 10)]
    assert toxicity.score_documents(odd.where("false"), trained).count() == 0


def test_language(spark, sf, docs):
    got = language.op3_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.language == r.lang for r in got]) > 0.98 and all(r.kept for r in got)
    pages = language.language_of_pages(spark, sf).collect()
    assert len(pages) == spark.read.parquet(f"{sf}/pages.parquet").count() and all(r.kept for r in pages)


def test_language_from_text_alone_and_against_wrong_declarations(spark, docs):
    """``lang`` is both label and declaration in the tables, so agreement is measured without it, and with wrong ones."""
    known = docs.where("length(text) > 100").select("doc_id", "text", "lang")
    evidence = lambda declared, shift: known.select((F.col("doc_id") + shift).alias("id"), "text", declared.alias("declared"), F.lit("").alias("suffix"), F.lit(f"h{shift}").alias("host"))
    wrong = F.when(F.col("lang") == "en", "de").otherwise("en")
    rows = evidence(F.col("lang"), 0).unionByName(evidence(F.lit(None).cast("string"), 1_000_000)).unionByName(evidence(F.when(F.col("doc_id") % 10 == 0, wrong).otherwise(F.lit(None)), 2_000_000))
    got = {r.id: r.language for r in language.identify(rows).collect()}
    said = {r.doc_id: r.lang for r in known.collect()}
    assert np.mean([got[d + 1_000_000] == v for d, v in said.items()]) > 0.97
    assert np.mean([got[d + 2_000_000] == v for d, v in said.items() if d % 10 == 0]) > 0.9


def correlation_within(groups: list[list[np.ndarray]]) -> float:
    """Intraclass correlation of the observations of one text, texts nested in groups, by its definition."""
    within = sum(((x - x.mean()) ** 2).sum() for g in groups for x in g) / sum(len(x) - 1 for g in groups for x in g)
    means = [np.concatenate(g).mean() for g in groups]
    freedom = sum(len(g) - 1 for g in groups)
    between = sum(len(x) * (x.mean() - m) ** 2 for g, m in zip(groups, means, strict=True) for x in g) / freedom
    sizes = [np.array([len(x) for x in g], dtype=float) for g in groups]
    texts = max(between - within, 0) / (sum(n.sum() - (n**2).sum() / n.sum() for n in sizes) / freedom)
    return texts / (texts + within)


def test_trigrams_of_a_text_are_weighed_by_their_correlation(spark):
    """Independent observations keep their full weight; texts that repeat one observation count as one each."""
    rng = np.random.default_rng(5)

    def rho(texts):
        rows = [(0, len(x), float(x.sum()), float((x**2).sum())) for x in texts]
        got = language.dispersion(spark.createDataFrame(rows, "best int, n long, total double, squares double"))
        assert abs(got - correlation_within([texts])) < 1e-9
        return got

    assert rho([rng.normal(size=n) for n in rng.integers(50, 400, 300)]) < 0.003
    assert rho([rng.normal() + 1e-4 * rng.normal(size=n) for n in rng.integers(50, 400, 300)]) > 0.99
    assert 0.15 < rho([0.5 * rng.normal() + rng.normal(size=n) for n in rng.integers(50, 400, 400)]) < 0.25
    empty = spark.createDataFrame([], "best int, n long, total double, squares double")
    one = spark.createDataFrame([(0, 9, 3.0, 2.0), (1, 5, 3.0, 2.0), (1, 0, 0.0, 0.0)], empty.schema)
    assert language.dispersion(empty) == language.dispersion(one) == 0


def slow_language(rows):
    """Language and confidence by id of ``id, text, declared, suffix, host``, by plain loops over all rows' own text likelihoods."""
    names = sorted({r[2] for r in rows if r[2]})
    counts = {n: np.full(language.BUCKETS, 0.05) for n in names}
    grams = {i: np.concatenate([np.zeros(0, dtype=np.int64), *language.trigrams(text)]) for i, text, *_ in rows}
    for i, _, declared, _, _ in rows:
        if declared:
            np.add.at(counts[declared], grams[i], 1)
    model = np.log(np.stack([counts[n] / counts[n].sum() for n in names], 1)).astype(np.float32)
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    raw = {i: model[t].astype(np.float64).sum(0) for i, t in grams.items()}
    groups = {k: [(model[t] - model[t].mean(1, keepdims=True))[:, k].astype(np.float64) for i, t in grams.items() if raw[i].argmax() == k] for k in range(len(names))}
    rho = correlation_within([g for g in groups.values() if g])
    assert 0 < rho < 1
    logs = {i: v / (1 + (len(grams[i]) - 1) * rho) for i, v in raw.items()}
    post = {i: soft(v) for i, v in logs.items()}
    total = sum(post.values()) + 0.5
    total = total / total.sum()
    by = lambda keep: sum((post[r[0]] for r in rows if keep(r)), np.zeros(len(names)))
    trust = np.stack([by(lambda r, d=d: r[2] == d) for d in names] + [np.zeros(len(names))]) + language.DECLARED_WEIGHT
    trust = np.log(trust / trust.sum(0))
    out = {}
    for i, _, declared, suffix, host in rows:
        s, h = by(lambda r, x=suffix: r[3] == x), by(lambda r, x=(suffix, host): (r[3], r[4]) == x)
        q = (s + language.SUFFIX_WEIGHT * total) / (s.sum() + language.SUFFIX_WEIGHT)
        want = soft(logs[i] + np.log((h + language.HOST_WEIGHT * q) / (h.sum() + language.HOST_WEIGHT)) + (trust[names.index(declared)] if declared else 0))
        out[i] = names[int(want.argmax())], want.max()
    return out


def test_language_equals_brute_force(spark):
    rows = [(i, made_up(i % 2, i), ("aa", "bb", None)[i % 3] if i % 7 else None, "x" if i % 4 else "y", f"h{i % 5}") for i in range(60)]
    evidence = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")
    got = {r.id: (r.language, r.confidence) for r in language.identify(evidence).collect()}
    for i, (name, sure) in slow_language(rows).items():
        assert got[i][0] == name and abs(got[i][1] - sure) < 1e-6


def test_language_of_pages_equals_brute_force(spark, sf):
    rows = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        host = (urlsplit(r.url or "").hostname or "").lower()
        said = re.search(r"<html[^>]* lang=[\"']?([A-Za-z]{2,3})", r.html or "")
        bare = re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", r.html or "")
        bare = re.sub(r"&#?\w+;", " ", re.sub(r"<[^>]*>", " ", bare))
        rows.append((r.page_id, bare, said and said.group(1).lower(), host.rpartition(".")[2] if "." in host else "", host))
    want = slow_language(rows)
    got = {r.page_id: r for r in language.language_of_pages(spark, sf).collect()}
    assert set(got) == set(want) and len({r.language for r in got.values()}) > 1
    for i, (name, sure) in want.items():
        assert got[i].language == name and abs(got[i].confidence - sure) < 1e-6 and got[i].kept == (sure >= 0.5)


def test_language_evidence(spark, docs):
    text = {r.lang: r.text for r in docs.where("length(text) > 2000").collect()}
    rows = [(9001, text["fr"], "en", "src1"), (9002, None, "en", "src1"), (9003, "123 456 !", "en", None), (9004, "xq", "de", "srcX"), (9004, "xq", "de", "srcX"), (None, text["de"], None, None)]
    more = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).withColumns({c: F.lit(1) for c in ("key", "id", "host", "n")})
    got = {r.id: r for r in language.identify(language.document_evidence(more)).where("id > 9000 or id is null").collect()}
    assert got[9001].language == "fr"  # the text outweighs a wrong declaration
    assert got[9002].rejected and got[9003].rejected and got[9002].language is None
    assert got[9004].language == "de"  # a short text follows the declaration
    assert got[None].language == "de"
    kept = language.keep_identified(more)
    assert kept.columns == more.columns and kept.count() == more.count() - 2
    assert language.identify(language.document_evidence(more.where("false"))).count() == 0


@pytest.mark.parametrize("text", ["12 345, 6.7 " * 100, "\u3000\u2026\u20ac " * 100, "1" * 2_000_000])
def test_long_texts_without_letters_are_rejected(spark, docs, text):
    rows = [(9001, text, "de", "src1"), (9002, text + "ab\u00e9", "de", "src1")]
    more = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = {r.id: r for r in language.identify(language.document_evidence(more)).where("id > 9000").collect()}
    assert got[9001].rejected and got[9001].language is None and got[9001].n_letters == 0
    assert got[9002].n_letters == 3 and got[9002].language is not None


def test_letters_are_counted_in_whole_texts(spark, sf, texts):
    got = language.op3_language(spark, sf).collect()
    assert all(r.n_letters == sum(map(str.isalpha, texts[r.doc_id] or "")) for r in got)


def made_up(language, n):
    """A text of words that only one language has."""
    rng = np.random.default_rng([language, n])
    return " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 4)) for rng in [np.random.default_rng([language, w]) for w in rng.integers(0, 40, 60)])


def test_rare_languages_are_fitted(spark):
    rows = [(k * 10_000 + i, made_up(k, i), name, "", "") for k, (name, n) in enumerate({"aa": 400, "bb": 400, "cc": 3, "dd": 3}.items()) for i in range(n)]
    rows += [(-2, made_up(2, 99), None, "", ""), (-3, made_up(3, 99), None, "", "")]
    evidence = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")
    got = {r.id: (r.language, r.rejected) for r in language.identify(evidence, fit_rows=20).where("id < 0").collect()}
    assert got == {-2: ("cc", False), -3: ("dd", False)}


def test_more_than_64_languages(spark):
    names = [f"{a}{b}" for a in "abcdefg" for b in "abcdefghij"]
    rows = [(k * 100 + i, made_up(k, i), name, "", "") for k, name in enumerate(names) for i in range(25)]
    rows += [(-1 - k, made_up(k, 99), None, "", "") for k in range(len(names))]
    evidence = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string")
    got = {r.id: (r.language, r.rejected) for r in language.identify(evidence).where("id < 0").collect()}
    assert got == {-1 - k: (name, False) for k, name in enumerate(names)}


def test_host_prior_decides_without_other_evidence(spark, docs):
    de = docs.where("lang = 'de'").limit(20).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.lit("").alias("suffix"), F.lit("de.host").alias("host"))
    en = docs.where("lang = 'en'").limit(20).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.lit("").alias("suffix"), F.lit("en.host").alias("host"))
    odd = spark.createDataFrame([(-1, "q", None, "", "de.host"), (-2, "q", None, "", "en.host")], "id long, text string, declared string, suffix string, host string")
    got = {r.id: r.language for r in language.identify(de.unionByName(en).unionByName(odd)).where("id < 0").collect()}
    assert got == {-1: "de", -2: "en"}


def test_licenses(spark):
    rows = [
        (1, "repo/LICENSE", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
        (2, "repo/src/a.py", "some code"),
        (3, "repo/src/b.py", "Licensed under the Apache License, Version 2.0.\nmany words of code here and there"),
        (4, "repo/src/deep/c.py", None),
        (5, "repo/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (6, "repo/vendor/x/y/z.c", ""),
        (7, "other/d.py", "licence plates are copyright of nobody in this long sentence about cars and roads"),
        (8, None, "no statement"),
        (6, "repo/vendor/x/y/z.c", ""),
    ]
    files = spark.createDataFrame(rows, "file_id long, path string, text string").withColumns({c: F.lit(1) for c in ("s", "dir", "license", "b")})
    got = {r.file_id: (r.license, r.how) for r in licenses.scan(files).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: ("MIT", "inherited"), 5: ("GPL-3.0", "own"), 6: ("GPL-3.0", "inherited"), 7: (None, "none"), 8: (None, "none")}
    assert licenses.scan(files).count() == len(rows) and licenses.scan(files.where("false")).count() == 0


def test_wrapped_notices_spdx_and_whole_texts(spark):
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY
 */
int main() {{}}"""
    bsd = """Copyright (c) 2020, The Authors

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.

"""
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    rows = [(1, "a/a.c", gpl.format(3)), (2, "b/b.c", gpl.format(2)), (3, "c/c.c", "// SPDX-License-Identifier: MIT\ncode"), (4, "d/d.c", "# SPDX-License-Identifier: GPL-3.0-or-later\ncode"), (5, "e/e.c", "# SPDX-License-Identifier: Zlib\ncode"), (6, "f/f.txt", bsd + third), (7, "g/g.txt", bsd)]
    got = {r.file_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == {1: "GPL-3.0", 2: "GPL-2.0", 3: "MIT", 4: "GPL-3.0", 5: None, 6: "BSD-3-Clause", 7: "BSD-2-Clause"}


def slow_statements(text):
    lines = re.split(r"\n+|(?<=[.!?;:])\s+", text)
    sign = r"[ \t]*(?:#+|//+|/?\*+/?|;+|--+|%+)?[ \t]*"
    out = list(lines)
    for paragraph in re.split(rf"\r?\n(?:{sign}\r?\n)+", text):
        said = re.split(r"(?<=[.!?;])\s+", re.sub(rf"\s*\r?\n{sign}", " ", paragraph))
        for n in (1, 2, 3):
            out += [" ".join(said[i : i + n]) for i in range(max(len(said) - n + 1, 1))]
    return [s for s in out if re.search(licenses.TELLING, s)]


def slow_licenses(texts):
    """Best licence of each text, by plain loops over all statements and templates."""
    split = lambda t: Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower()))
    said = {d: set(slow_statements(t)) for d, t in texts.items()}
    vectors = {s: split(s) for s in set().union(*said.values())}
    templates = [(name, split(t)) for name, t in licenses.TEMPLATES]
    known = set().union(*(t for _, t in templates))
    df = Counter(t for v in vectors.values() for t in v if t in known)
    idf = lambda t: np.log((len(vectors) + len(templates) + 1) / (df[t] + 1 + (t in known))) + 1 if t in known else np.log((len(vectors) + len(templates) + 1) / 2) + 1
    weigh = lambda v: {t: n * idf(t) for t, n in v.items()}
    norm = lambda w: np.sqrt(sum(x * x for x in w.values()))
    tw = [(name, weigh(t)) for name, t in templates]
    cosine = {}
    for s, v in vectors.items():
        w = weigh(v)
        for name, t in tw:
            c = round(sum(x * t.get(k, 0.0) for k, x in w.items()) / (norm(w) * norm(t)), 9) if w else 0.0
            if c >= licenses.MIN_COSINE:
                cosine.setdefault(s, {})[name] = max(c, cosine.get(s, {}).get(name, 0.0))
    out = {}
    for d, statements in said.items():
        sums = Counter()
        for s in statements:
            for name, c in cosine.get(s, {}).items():
                sums[name] += c
        if sums:
            out[d] = min(sums, key=lambda n: (-round(sums[n], 6), n))
    return out


def test_licenses_equal_brute_force(spark, sf, docs, texts):
    got = {r.doc_id: r.license for r in licenses.op4_licenses(spark, sf).where("how = 'own'").collect()}
    assert got == slow_licenses({d: t or "" for d, t in texts.items()}) and len(got) >= 3


def by_duckdb(sql, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return sorted(con.execute(sql).fetchall(), key=repr)


def test_licenses_equal_sql_on_awkward_documents(spark, tmp_path):
    gpl = " * You can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, version {}.\n *\n * Copyright of all; permission is asked.\n"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nint x;"
    texts = [gpl.format(2), gpl.format(3), mpl, "Released under the MIT License", None, "", "plain words", "# SPDX-License-Identifier: (MIT OR GPL-3.0-or-later)\nx = 1", "Licensed under CC BY 4.0. Released under the MIT License.",
             "\n\n. licence; Licensed under the Apache License, Version 2.0!\r\n\r\n// \r\nLICENSE: none \u0130", "words " * 30_000 + "\n//\nReleased under the\n// MIT License. " + "more " * 30_000]
    rows = [(None if i == 40 else i * 7, t, None if i % 5 == 0 else "en", [None, "a/b", "", "code"][i % 4]) for i, t in enumerate(texts * 6)]
    spark.createDataFrame(rows + rows[:4], "doc_id long, text string, lang string, source string").withColumn("license", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in licenses.op4_licenses(spark, str(tmp_path)).collect()), key=repr)
    assert got == by_duckdb(license_sql.SQL, tmp_path)
    assert {r[4] for r in got} == {"own", "inherited", "none"} and len(got) == len(rows) + 4


def test_absolute_paths_inherit(spark):
    mit = "Released under the MIT License"
    rows = [(1, "/usr/lib/LICENSE", mit), (2, "/usr/lib/a/b.c", "code"), (3, "/usr//lib//c.c", "code"), (4, "/usr/d.c", "code"), (5, "//e.c", "code")]
    got = {r.file_id: (r.license, r.how) for r in licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("MIT", "inherited"), 4: (None, "none"), 5: (None, "none")}


def test_headers_of_three_lines_and_identifiers(spark):
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nint x;"
    long = "word " * 200_000 + "\n\nReleased under the MIT License.\n\n" + "more " * 200_000
    rows = [(1, "a/x.c", mpl), (2, "b/y.py", "# SPDX-License-Identifier: BSD-2-Clause\nx = 1"), (3, "c/z.txt", long), (4, "d/t", "Licensed under CC BY 4.0. Released under the MIT License."), (4, "d/t", "Licensed under CC BY 4.0. Released under the MIT License.")]
    got = {r.file_id: (r.license, r.how) for r in licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == {1: ("MPL-2.0", "own"), 2: ("BSD-2-Clause", "own"), 3: ("MIT", "own"), 4: ("CC-BY-4.0", "own")}  # equal sums: the name that sorts first


def test_licenses_of_documents(spark, sf, docs):
    got = licenses.op4_licenses(spark, sf).join(docs.select("doc_id", "text"), "doc_id").collect()
    said = {"MIT": "Released under the MIT License", "Apache-2.0": "Licensed under the Apache License, Version 2.0", "GPL-3.0": "General Public License, version 3", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0"}
    for r in got:
        stated = {k for k, v in said.items() if v in (r.text or "")}
        assert (r.how == "own") == bool(stated) and (not stated or r.license in stated)


def article(source):
    body = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_main_text(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = sitetree.op1_main_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


class Elements(HTMLParser):
    """Of a well-formed page without inline elements: its elements by path, with their children, and its text blocks."""

    def __init__(self, source):
        super().__init__()
        self.open, self.elements, self.blocks = [], [], set()
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        step = ".".join([tag, *sorted(dict(attrs).get("class", "").split())])
        if self.open:
            self.open[-1][1].append(step)
        self.open.append(((*(self.open[-1][0] if self.open else ()), step), []))
        self.elements.append(self.open[-1])

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if data.strip():
            self.blocks.add((self.open[-1][0], " ".join(data.split())))


def slow_importance(pages):
    """Importance of every path with text below it, by host, straight from its definition."""
    shown, styles, texts = Counter(), defaultdict(Counter), defaultdict(Counter)
    for host, source in pages:
        page = Elements(source)
        shown.update({(host, path) for path, _ in page.elements})
        for path, seq in {(path, tuple(k for k, _ in groupby(seq))) for path, seq in page.elements if seq}:
            styles[host, path][seq] += 1
        for path, text in page.blocks:
            texts[host, path][text] += 1
    entropy = lambda c: -sum(n / c.total() * math.log(n / c.total()) for n in c.values())
    out = {}
    for (host, path), m in shown.items():
        fresh = total = 0.0
        for (h, below), said in texts.items():
            if h == host and below[: len(path)] == path:
                on = math.log(shown[h, below] + sitetree.SMOOTH)
                fresh += sum(n * (1 - math.log(n) / on) for n in said.values())
                total += said.total()
        if not total:
            continue
        content, seqs = fresh / total, styles[host, path]
        presentation = (entropy(seqs) + math.log((m + sitetree.SMOOTH) / m)) / math.log(m + sitetree.SMOOTH) if seqs else 0.0
        damped = sitetree.DAMPING ** len(seqs)
        out[host, path] = damped * content + (1 - damped) * presentation
    return out


def test_importance_equals_brute_force(spark):
    draw = random.Random(5)
    pages = []
    for i in range(60):
        items = "".join(f"<li>item {draw.randrange(9)}</li>" for _ in range(draw.randrange(4)))
        parts = ["<div class='top bar'><ul>" + items + "</ul>Menu</div>", f"<div class='c'><h2>Story {i}</h2><p>day {draw.randrange(40)}</p><p>always</p></div>", "<table><tr><td>cell</td></tr></table>", "<section></section>"]
        deep = "<div>" * 45 + f"far {i % 7}" + "</div>" * 45 if i % 3 == 0 else ""
        pages.append((f"h{i % 3}.example", "<html><body>" + "".join(draw.sample(parts, draw.randint(2, 4))) + deep + "</body></html>"))
    got = sitetree.importance(spark.createDataFrame(pages, "host string, html string")).collect()
    want = slow_importance(pages)
    assert len(got) == len({r.node for r in got}) == len(want) > 70
    order = lambda values: sorted((h, round(v, 9)) for h, v in values)
    assert order((r.host, r.importance) for r in got) == order((h, v) for (h, _), v in want.items())


def test_repeated_unmarked_branches_go(spark):
    page = "<html><body><div class='x1'>Call us now for the best offers</div><div class='x2'><h2>Story {0}</h2><p>What happened on day {0} &amp; why {1}</p></div><div class='x3'>All rights kept since 1999</div></body></html>"
    rows = [(i, f"https://news.example/{i}", page.format(i, i * 7)) for i in range(30)] + [(100, "https://one.example/", page.format(1, 2)), (101, None, None), (102, "x", ""), (100, "https://one.example/", page.format(1, 2))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "low", "salt", "node")})
    got = sitetree.extract_main_text(pages).collect()
    of = {r.page_id: r.text for r in got}
    assert of[3] == "Story 3\n\nWhat happened on day 3 & why 21"
    assert "Call us now" in of[100] and of[101] == of[102] == ""
    assert len(got) == len(rows) and sitetree.extract_main_text(pages.where("false")).count() == 0


def test_page_roles():
    kept = lambda s: sitetree.Page(s).kept({})
    page = """<html><head><title>t</title></head><body class="with-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">Cookies</div><div class=content>
    <article><header><h1>T &amp; t</h1></header><p>One<p>Two <b>x</b>&nbsp;y<ul><li>a<li>b</ul><script>if (a<b) "</article>"</script><table><tr><td>c<td>d</table>
    <div class="reader-comments"><article><p>bad</p></article></div><form>f</form></article></div><aside>s</aside><!-- <p>no</p> --><footer>z</footer>"""
    assert kept(page) == ["T & t", "One", "Two x y", "a", "b", "c", "d"]
    assert kept('<div><h1>Hi</h1>text<br>more 1 < 2</div><ul><li><a href=x>l1</a><li><a>l2</a></ul><div class="sidebar">s</div>') == ["Hi", "text more 1 < 2"]
    assert kept("") == [] and kept("plain &lt;text&gt;") == ["plain <text>"]
    assert len("".join(kept("<p>" + "<div>" * 3000 + "deep" + "x " * 100_000))) > 100_000


def test_entropy_decides_inside_articles(spark):
    page = "<body><article><h1>Story {0}</h1><div class='x1'>Follow us for more of this</div><p>What happened on day {0}, and why {1} came of it in the end</p></article><div class='x2'>Made since 1999</div></body>"
    pages = spark.createDataFrame([(i, f"https://news.example/{i}", page.format(i, i * 7)) for i in range(30)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in sitetree.extract_main_text(pages).collect()}
    assert got[3] == "Story 3\n\nWhat happened on day 3, and why 21 came of it in the end"


def test_importance_decides_by_degree(spark):
    """The same markup gives different texts on hosts where a branch repeats, rotates, or is new on each page; articles included."""
    page = "<body><article><h1>Story {0}</h1><p class='notice'>{1}</p><p>What happened on day {0}, and why {2} came of it in the end</p></article><div class='x2'>{3}</div></body>"
    said = {"same": lambda i: "Read our terms before you go on", "new": lambda i: f"Our own view of day {i} is number {i * 13}"}
    rows = [(h * 1000 + i, f"https://{name}{outer}.example/{i}", page.format(i, said[name](i), i * 7, said[outer](i)))
            for h, (name, outer) in enumerate([("same", "same"), ("new", "same"), ("same", "new"), ("new", "new")]) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in sitetree.extract_main_text(pages).collect()}
    assert [len(got[h * 1000 + 5]) for h in range(4)] == [2, 3, 3, 4]
    assert got[1005][1] == said["new"](5) and got[2005][2] == said["new"](5)


def test_inline_adverts_go():
    kept = lambda s: sitetree.Page(s).kept({})
    assert kept("<article><p>One <span class='ad'>Buy <b>now</b></span> two</p><p>three</p></article>") == ["One two", "three"]
    assert kept("<article><p>One</p><span class='sponsored'><div>Buy</div> now</span><p>two</p></article>") == ["One", "two"]
    assert kept("<article><p>One <span class='added'>kept</span> <ins class='adsense'>x") == ["One kept"]
    assert kept("<article><p class='comment'>Our view: yes</p><p>text</p><div class='comments'><p>no</p></div></article>") == ["Our view: yes", "text"]


def test_small_hosts_are_judged_smoothly(spark):
    page = "<html><body><div class='x1'>Call us now for the best offers</div><div class='x2'><p>What happened on day {0} &amp; why {1}</p></div></body></html>"
    got = {}
    for n in (1, 2, 3, 5, 9, 30):
        pages = spark.createDataFrame([(i, f"https://n{n}.example/{i}", page.format(i, i * 7)) for i in range(n)], "page_id long, url string, html string")
        low = {r.importance for r in sitetree.importance(sitetree.with_host(pages)).collect()}
        got[n] = min(low)
    assert got[1] == 1 and all(a > b for a, b in zip(got.values(), list(got.values())[1:])) and got[30] < 0.1


def test_deep_pages_take_linear_time(spark):
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert sitetree.Page("<div>" * n + "deep" + "</x></p>" * n).kept({}) == ["deep"]
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]
    rows = [(i, f"https://deep.example/{i}", "<div>" * 70 + f"text {i}" + "</div>" * 70 + "<div class=x><div class=y>same</div></div>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in sitetree.extract_main_text(pages).collect()} == {f"text {i}" for i in range(30)}
    sums = {r.node: r.importance for r in sitetree.importance(sitetree.with_host(pages)).collect()}
    page = sitetree.Page(rows[3][2], "deep.example")
    assert len(page.ids) == 73 and all(sums[i] > 0.5 for i in page.ids[1:71]) and sums[page.ids[72]] < 0.1


def test_copied_articles_stay(spark):
    page = "<body><article><h1>Story {0}</h1><p>The same long text of a copied article on every page of this host</p></article></body>"
    pages = spark.createDataFrame([(i, f"https://copies.example/{i}", page.format(i)) for i in range(30)], "page_id long, url string, html string")
    assert {len(r.text.split("\n\n")) for r in sitetree.extract_main_text(pages).collect()} == {2}


def test_main_text_is_not_lost_to_teasers_forms_and_slugs():
    kept = lambda s: sitetree.Page(s).kept({})
    assert kept("<div><p>the main text</p></div><div class=related><article>teaser</article></div>") == ["the main text"]
    assert kept("<div><p>the main text</p></div><aside><article>teaser</article></aside>") == ["the main text"]
    assert kept("<form id=aspnetForm><nav>menu</nav><div><p>all of the page</p></div></form>") == ["all of the page"]
    assert kept("<article><h1>T</h1><form><p>the whole text of the page</p></form></article>") == ["T", "the whole text of the page"]
    assert kept("<article><h2 id='related-work'>Related work</h2><section id='notice-of-change'><p>text</p></section><div id=comments>no</div></article>") == ["Related work", "text"]
    assert kept("<div>title</div><div class='sidebar-layout'><article>short but the main one</article><div class=comments>long comments, long comments, long comments</div></div>") == ["title", "short but the main one"]

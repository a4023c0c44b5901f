"""The training-data operators against brute force, on fixtures with nulls,
empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import math
import os
import re
import textwrap
import zlib

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from rowproof.llm import bpe_prefix, common, language_kernel, license_templates, license_tfidf, pii_transducer, quality_lists, queries, retrieval_packing, simhash_similar, simhash_vptree, toxicity_crf, vector_graph, warc_zstd

SMALL = "/root/testdata/sf0.001"
JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " ", "a", "a b", "A b", "x y z q x y z", "word " * 30_000, "é\u0085中 😀\n\n #!", "Ä ö ü", "a b c d e f g h", "a b c d e f g h"]


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r.doc_id, r.text) for r in common.table(spark, SMALL, "documents").collect()]
    rows = [(i, t, 1.0, "x") for i, t in real] + [(10_000 + i, t, 2.0, "y") for i, t in enumerate(ODD)] + [(10_011, ODD[-1], 2.0, "y"), (None, "lost id", 0.0, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, fp string").repartition(5).cache()


def nothing(docs):
    return docs.where("false")


def links(n, near):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_vector_graph(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    near = np.concatenate([base[:6] + 0.05 * rng.normal(size=(6, 16)) for _ in range(8)])
    x = np.concatenate([base, near, base[:3], base[:2] * 7]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [None, 1.0], 0), (905, [1.0, 0.0], 0), (906, [1.0, 0.1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n long")
    got = {r.vec_id: r for r in vector_graph.linked(df).collect()}
    u = vector_graph.unit(x)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    root = links(len(x), zip(*np.nonzero(s), strict=True))
    assert all(got[i].n_links == s[i].sum() and got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in range(len(x)))
    assert [(got[i].n_links, got[i].component_id) for i in range(900, 907)] == [(0, 900), (0, 901), (0, 902), (0, 903), (0, 904), (1, 905), (1, 905)]
    assert vector_graph.linked(df.where("false")).count() == 0


def test_vector_graph_dense(spark, monkeypatch):
    # A dense group cut into far more clusters than a node asks at first.
    monkeypatch.setattr(vector_graph, "CLUSTER", 8)
    rng = np.random.default_rng(8)
    center = rng.normal(size=24)
    x = np.concatenate([center + 0.25 * rng.normal(size=(500, 24)), rng.normal(size=(300, 24))]).astype(np.float32)
    s = vector_graph.unit(x) @ vector_graph.unit(x).T >= 0.9
    np.fill_diagonal(s, False)
    assert s.sum(1).max() > 400
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vector_graph.linked(df).collect()}
    root = links(len(x), zip(*np.nonzero(s), strict=True))
    assert all((got[i].n_links, got[i].component_id, got[i].audited_recall) == (s[i].sum(), root[i], 1.0) for i in range(len(x)))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    want = collections.Counter()
    ids = {}
    for r in docs.collect():
        x = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        ids[r.doc_id] = x
        want[(r.doc_id, len(x))] += 1
    pieces = retrieval_packing.packed(docs, JSON, RANKS, PATTERN).collect()
    at, total = collections.defaultdict(list), collections.Counter()
    for p in pieces:
        data = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert p.doc_tokens == len(ids[p.doc_id]) and p.length > 0 and p.ids_crc32 == zlib.crc32(data)
        at[p.sequence_id].append((p.offset, p.length))
        total[p.doc_id] += p.length
    assert all(total[d] == sum(n * k for (e, n), k in want.items() if e == d) for d in ids)
    for spans in at.values():
        place = 0
        for offset, n in sorted(spans):
            assert offset == place
            place += n
        assert place <= 2048
    full = sum(1 for s in at.values() if sum(n for _, n in s) == 2048)
    assert full >= len(at) - 8
    assert retrieval_packing.packed(nothing(docs), JSON, RANKS, PATTERN).count() == 0


def test_packing_tokens_agree():
    # The faster library and the shorter pattern give what the tokenizer file gives, for every character they are used on.
    t = retrieval_packing.tokens(JSON, RANKS, PATTERN)
    plain = [c for c in map(chr, range(9, 0x482)) if retrieval_packing.PLAIN.fullmatch(c)]
    rng = np.random.default_rng(11)
    parts = [*plain, *[" ", "\n", "'s", ".", "12", "the", " of", "\n\n", "  "] * 40]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(20_000)]
    texts += ["a" * 5000, " " * 5000, "x<|endoftext|>y", "日本 語", "\n\n", " \n", "a b\n\nc d\n", "w1, " * 3000]
    for x in texts:
        assert t.ids(x).tolist() == t.exact.encode(x, add_special_tokens=False).ids


def test_packing_ranks_by_bm25():
    rng = np.random.default_rng(12)
    docs = [rng.integers(0, 60, rng.integers(1, 14)) for _ in range(300)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=60)
    mean, k1, b = float(np.mean([len(d) for d in docs])), retrieval_packing.K1, retrieval_packing.B

    def brute(seed, d):
        tf = collections.Counter(d.tolist())
        idf = lambda x: np.log(1 + (300 - df[x] + 0.5) / (df[x] + 0.5))
        return sum(idf(x) * tf[x] * (k1 + 1) / (tf[x] + k1 * (1 - b + b * len(d) / mean)) for x in set(seed.tolist()) if x in tf)

    index = retrieval_packing.Index(docs, df, 300, mean)
    unused = rng.random(300) < 0.7
    for seed in range(0, 300, 7):
        got = np.concatenate(list(index.neighbours(seed, unused)))
        scores = np.array([brute(docs[seed], d) for d in docs])
        assert set(got.tolist()) == set(np.flatnonzero((scores > 0) & unused).tolist())  # nothing is left out
        assert np.all(np.diff(scores[got]) <= 1e-5)
    # With more terms than one query has, every document that shares any of them follows.
    many = [np.arange(0, 100), np.array([99]), np.array([0, 1]), np.array([200])]
    index = retrieval_packing.Index(many, np.full(201, 2), 4, 26.0)
    assert set(np.concatenate(list(index.neighbours(0, np.array([False, True, True, True])))).tolist()) == {1, 2}


def test_packing_repeats_itself(spark):
    df = common.table(spark, SMALL, "documents").select("doc_id", "text")
    first, second = (sorted((r for r in map(tuple, retrieval_packing.packed(d, JSON, RANKS, PATTERN).collect()) if r[5] < 1 << 62)) for d in (df, df.repartition(7)))
    assert first == second and first
    # A code with more tokens than a shard is split, and no shard mixes it with others.
    big = retrieval_packing.SHARD
    assert retrieval_packing.dealt([(5, 3 * big + 1), (1, 10), (2, 20), (9, 7)]) == [(1, 0, 1), (2, 0, 1), (5, 1, 4), (9, 5, 1)]


def test_language(spark, docs):
    train = common.table(spark, SMALL, "documents")
    model = language_kernel.learned(train.where(~language_kernel.held_out()))
    both = language_kernel.predicted(train, model).join(train.select(F.col("doc_id").alias("id"), "lang"), "id").where(language_kernel.held_out("id")).collect()
    assert sum(r.lang == r.lang_pred for r in both) / len(both) > 0.9
    got = {r.id: r for r in language_kernel.predicted(docs, model).collect()}
    assert [got[10_000 + i].lang_pred for i in range(3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    none = language_kernel.learned(train.where("false"))
    assert {r.lang_pred for r in language_kernel.predicted(docs, none).collect()} == {"und"}
    assert language_kernel.predicted(nothing(docs), model).count() == 0


def test_language_against_brute_force():
    # N-grams, kernel and regression by sets of byte strings and dense matrices.
    rng = np.random.default_rng(15)
    alphabets = ["abcdeé ", "efghiß ", "aeiouЖ "]
    rows = [(f"l{k}", "".join(rng.choice(list(a), rng.integers(5, 60)))) for k, a in enumerate(alphabets) for _ in range(60)]
    n_grams = lambda t: {b[i : i + k] for b in [t.lower().encode()] for k in range(1, 5) for i in range(len(b) - k + 1)}
    sets = [n_grams(t) for _, t in rows]
    marks = [i for k in range(3) for i in range(60 * k, 60 * k + language_kernel.LANDMARKS)]
    like = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k_nm = np.array([[like(a, sets[m]) for m in marks] for a in sets])
    ours = [language_kernel.grams(t) for _, t in rows]
    assert [len(g) for g in ours] == [len(x) for x in sets]
    assert np.allclose(language_kernel.kernel(ours, [ours[m] for m in marks]), k_nm)
    values, vectors = np.linalg.eigh(k_nm[marks])
    keep = values > language_kernel.RANK * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi, y = k_nm @ root, np.repeat(np.eye(3), 60, 0)
    beta = root @ np.linalg.solve(phi.T @ phi / 60 + language_kernel.RIDGE * 3 / 180 * np.eye(keep.sum()), phi.T @ y / 60)
    model = language_kernel.fitted(rows)
    new = ["".join(rng.choice(list(alphabets[k % 3]), 30)) for k in range(50)] + ["z" * 500, "é"]
    want = np.array([[like(n_grams(t), sets[m]) for m in marks] for t in new]) @ beta
    assert np.allclose(model.scores([language_kernel.grams(t) for t in new]), want, atol=1e-8)
    assert model.predict(new)[0] == [f"l{k}" for k in want.argmax(1)]
    # Every label is learned, however many there are, and numbers that share a slot are told apart.
    many = language_kernel.fitted([(f"x{i}", f"text{i} {i * i} word{i}") for i in range(300)])
    assert len(many.languages) == 300 and many.predict(["text7 49 word7"])[0][0] == "x7"
    known = np.unique(rng.integers(1, 1 << 62, 5000).astype(np.uint64))
    look = language_kernel.Lookup(known)
    assert look.find(known).tolist() == list(range(len(known))) and len(look.others) > 0
    assert look.find(np.setdiff1d(rng.integers(1, 1 << 62, 5000).astype(np.uint64), known)).max() == -1


def test_simhash(spark, docs):
    def brute(text):
        words = (text or "").encode().lower().split()
        parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = docs.collect()
    fps = [brute(r.text) for r in rows]
    got = collections.defaultdict(set)
    for r in simhash_vptree.near_duplicates(docs).collect():
        got[r.id].add((r.fp & (1 << 64) - 1, r.component))
    root = links(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    low = {}
    for r, k in zip(rows, root, strict=True):
        if r.doc_id is not None:
            low[k] = min(low.get(k, r.doc_id), r.doc_id)
    for r, f, k in zip(rows, fps, root, strict=True):
        assert (f, low.get(k)) in got[r.doc_id]
    kept = simhash_vptree.deduplicated(docs).collect()
    assert len([r for r in kept if r.doc_id is not None]) == len(low) and simhash_vptree.near_duplicates(nothing(docs)).count() == 0


@pytest.mark.parametrize("module", [simhash_vptree, simhash_similar])
def test_deduplicated_keeps_a_row_of_each_class(spark, module):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(1), "a"), (None, text(2), "b"), (None, text(2), "c"), (None, text(3), "d"), (7, text(3), "e"), (9, text(3), "f"), (8, text(4), "g"), (8, text(5), "h"), (8, text(5), "i"), (3, None, None), (4, "", "j"), (11, " ", "k")]
    df = spark.createDataFrame([(*r, r[0], i) for i, r in enumerate(rows)], "doc_id long, text string, tag string, __rp_row long, class int").repartition(4)
    kept = module.deduplicated(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()))
    assert got == sorted([(0, text(1)), (0, text(2)), (7, text(3)), (8, text(4)), (8, text(5)), (3, "")])
    assert module.deduplicated(df.where("false")).count() == 0


def test_similar_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(rng.choice(words, 60))  # in very many texts that have nothing else in common
    texts = []
    for k in range(12):
        base = list(rng.choice(words, rng.integers(60, 400)))
        texts.append(" ".join(base))
        for share in (0.002, 0.004, 0.008, 0.015, 0.03, 0.06):
            t = list(base)
            for i in rng.integers(0, len(t), max(1, int(share * len(t)))):
                t[i] = f"new{rng.integers(1 << 40)}"
            texts.append(" ".join(t))
    texts += [" ".join(rng.choice(words, 100)) + " " + passage for _ in range(80)] + [passage + f" end{i}" for i in range(60)]
    texts += [None, "", " \n", "a", "A", "a b", texts[0].upper(), texts[0]]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    n = len(texts)
    close = np.array([[like(a, b) for b in sets] for a in sets])
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(5)
    for block in (4096, 16):  # in one block, and with every shard and class of more than 16 texts split
        monkeypatch.setattr(simhash_similar, "BLOCK", block)
        monkeypatch.setattr(simhash_similar, "COMPARED", block)
        got = {r.row: r["class"] for r in simhash_similar.similar(df, "row").collect()}
        exact = links(n, np.argwhere(close >= 0.8 - 1e-9))
        assert len(got) == n
        assert all((got[a] == got[b]) == (exact[a] == exact[b]) for a in range(n) for b in range(a))
    assert simhash_similar.similar(df.where("false"), "row").count() == 0


def test_similar_about_the_threshold(spark):
    """Of pairs at 0.80 to 0.82 over 99 in 100 are linked, of pairs at 0.76 to 0.7999 none."""
    rng = np.random.default_rng(15)
    texts, close = [], []
    while len(close) < 800:
        n = int(rng.integers(40, 500))
        base = [f"p{len(close)}x{i}" for i in range(n)]
        other = list(base)
        for i in rng.choice(n, max(1, int(n * rng.uniform(0.015, 0.035))), replace=False):
            other[i] = "new"
        a, b = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (base, other))
        s = len(a & b) / len(a | b)
        if 0.76 <= s <= 0.82:
            texts += [" ".join(base), " ".join(other)]
            close.append(s)
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(6)
    got = {r.row: r["class"] for r in simhash_similar.similar(df, "row").collect()}
    linked = np.array([got[2 * k] == got[2 * k + 1] for k in range(len(close))])
    near = np.array(close) >= 0.8
    assert near.sum() > 150 and (~near).sum() > 150
    assert linked[near].mean() > 0.99 and not linked[~near].any()


def test_similar_forest_is_exact():
    # Vantage points, blocks and the core of a ball leave no link out.
    rng = np.random.default_rng(14)
    radius, words = simhash_similar.radius_of(0.8), simhash_similar.BITS // 64
    base = rng.integers(0, 1 << 63, (300, words), dtype=np.int64).view(np.uint64)
    flips = lambda x, k: x ^ np.packbits(np.array([rng.permutation(np.arange(words * 64) < k) for _ in x]), axis=1).view(np.uint64)
    fps = np.concatenate([base, flips(base[:200], 90), flips(base[:100], 130), flips(np.repeat(base[:1], 500, 0), 60), flips(np.repeat(base[1:2], 400, 0), 85)])
    d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(-1, dtype=np.int64)
    assert simhash_similar.forest(fps, radius).tolist() == links(len(fps), np.argwhere(np.triu(d <= radius, 1)))


def test_simhash_shards_in_blocks(spark, docs, monkeypatch):
    whole = sorted(map(tuple, simhash_vptree.near_duplicates(docs).select("id", "fp", "component").collect()), key=repr)
    monkeypatch.setattr(simhash_vptree, "GROUP", 20)
    assert sorted(map(tuple, simhash_vptree.near_duplicates(docs).select("id", "fp", "component").collect()), key=repr) == whole


def test_vector_graph_in_slices(spark, monkeypatch):
    # Blocks of members and slices of queries, both far smaller than a cluster.
    monkeypatch.setattr(vector_graph, "BLOCK", 60)
    monkeypatch.setattr(vector_graph, "SLICE", 90)
    rng = np.random.default_rng(21)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base, base + 0.08 * rng.normal(size=(150, 16)), base[:20] + 0.05 * rng.normal(size=(20, 16))]).astype(np.float32)
    s = vector_graph.unit(x) @ vector_graph.unit(x).T >= 0.9
    np.fill_diagonal(s, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vector_graph.linked(df).collect()}
    root = links(len(x), zip(*np.nonzero(s), strict=True))
    assert all((got[i].n_links, got[i].component_id) == (s[i].sum(), root[i]) for i in range(len(x)))


def test_vptree_is_exact():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.int64).view(np.uint64)
    flips = [base] + [base[:700] ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)) for _ in range(3)]
    fps = np.unique(np.concatenate(flips))
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 2, 1))
    want = links(len(fps), near)
    assert simhash_vptree.links_within(fps, 2).tolist() == want
    tree = simhash_vptree.build(fps[::7], 64)
    at, shards = simhash_vptree.shards_of(fps, tree, 2)
    homes = collections.defaultdict(set)
    for i, s in zip(at.tolist(), shards.tolist(), strict=True):
        homes[i].add(s)
    assert all(homes[a] & homes[b] for a, b in near.tolist())


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (5, 5), (None, 1)]
    out = {r.node: r.root for r in common.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_toxicity(spark, docs):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        t = [words[k] for k in rng.integers(0, 200, 60)]
        bad = i % 5 == 0
        if bad:
            t[10:12], t[40] = ["vilescum,", "Vileworm"], "vilefoul"
        rows.append((i, " ".join(t), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity_crf.learned(df.select("doc_id", "text"), df.where("doc_id % 3 <> 0").select("doc_id", "toxic"))
    got = toxicity_crf.scored(df, model).join(df.select(F.col("doc_id").alias("id"), "text", "toxic"), "id").where("id % 3 = 0").collect()
    assert all((r.score >= 0.5) == bool(r.toxic) for r in got)
    assert all(r.text[s.start : s.end].lower().startswith("vile") for r in got for s in r.spans)
    assert len(toxicity_crf.scored(docs, model).collect()) == docs.count() and toxicity_crf.filtered(docs, model).columns == docs.columns
    assert toxicity_crf.scored(docs, toxicity_crf.learned(docs, df.where("false").select("doc_id", "toxic"))).select("score").distinct().count() == 1
    assert toxicity_crf.scored(nothing(docs), model).count() == 0 and toxicity_crf.filtered(nothing(docs), model).count() == 0
    # Marginals against the sum over all labellings.
    m = toxicity_crf.Model(weights={"w=a": 0.7, "w=b": -0.4}, chain=[[1.2, 0.5], [0.8, 2.0]], start=0.6)
    tokens = "a b a a".split()
    total, ones = 0.0, np.zeros(4)
    for code in range(16):
        y = [code >> k & 1 for k in range(4)]
        p = m.start ** y[0] * np.prod([m.odds(t) ** k for t, k in zip(tokens, y, strict=True)]) * np.prod([m.chain[i][j] for i, j in zip(y, y[1:], strict=False)])
        total, ones = total + p, ones + p * np.array(y)
    assert np.allclose(m.marginals(["a b a a", "", "b"])[0], ones / total)


def test_toxicity_fits_whole_documents_in_blocks(monkeypatch):
    rng = np.random.default_rng(16)
    long = [[*rng.choice(["a", "b", "vile", "c"], 700)] for _ in range(6)]
    rows = [(" ".join(w), k % 2) for k, w in enumerate(long)] + [("a b vile c", 1), ("c", 0)]
    assert [w for words in long for p in toxicity_crf.pieces(words) for w in p] == [w for words in long for w in words]
    assert max(len(p) for words in long for p in toxicity_crf.pieces(words)) <= toxicity_crf.CHAIN_WORDS
    found = []
    for block in (200_000, 600):  # all pieces side by side, or one at a time
        monkeypatch.setattr(toxicity_crf, "CHAIN_BLOCK", block)
        model = toxicity_crf.Model()
        toxicity_crf.fit_chain(model, rows, {"vile"})
        found.append((model.weights, model.chain, model.start))
    assert found[0][0].keys() == found[1][0].keys() and np.allclose(list(found[0][0].values()), list(found[1][0].values()))
    assert np.allclose(found[0][1], found[1][1]) and np.isclose(found[0][2], found[1][2])


def test_bpe(spark, docs):
    import tiktoken

    v = bpe_prefix.vocabulary(RANKS, PATTERN)
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    got = collections.defaultdict(set)
    for r in bpe_prefix.digests(docs, RANKS, PATTERN).collect():
        got[r.id].add((r.n_tokens, r.ids_sha256, r.decoded_sha256))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in docs.collect():
        ids = plain.encode_ordinary(r.text or "")
        assert (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())) in got[r.doc_id]
    rng = np.random.default_rng(4)
    parts = ["the ", "ing", "  ", "\n", "é", "x1", "'s", "\u0085", "一", " ", "..", "aaa"]
    for _ in range(300):
        t = "".join(rng.choice(parts, 12))
        assert v.encode(t) == plain.encode_ordinary(t)
    piece = bpe_prefix.Piece(v, b"hello wor")
    piece.append(b"lding")
    piece.replace(2, 5, b"y th")
    assert piece.tokens() == bpe_prefix.Piece(v, piece.data).tokens()
    # Appends and edits anywhere in long pieces give what a fresh encoding gives.
    letters = list(b"abcdefgh eiou-=")
    for _ in range(60):
        piece = bpe_prefix.Piece(v, bytes(rng.choice(letters, rng.integers(0, 900)).tolist()))
        for _ in range(4):
            a, b = sorted(rng.integers(0, len(piece.data) + 1, 2).tolist())
            piece.replace(a, min(b, a + 5), bytes(rng.choice(letters, rng.integers(0, 6)).tolist()))
            piece.append(bytes(rng.choice(letters, rng.integers(0, 9)).tolist()))
            fresh = bpe_prefix.Piece(v, piece.data)
            assert (piece.last, piece.state, piece.tokens()) == (fresh.last, fresh.state, fresh.tokens())
    assert bpe_prefix.digests(nothing(docs), RANKS, PATTERN).count() == 0


def test_license(spark, docs):
    long = {t.name: t.text for t in license_templates.TEMPLATES if len(t.text) > 600}
    wrap = lambda text, mark: "\n".join(mark + line for p in text.strip().split("\n") for line in [*textwrap.wrap(p, 60), ""])
    code = "\n".join(f"value{i} = compute{i}(row{i}, other{i % 7})" for i in range(300))
    rows = [
        (1, "s/a/LICENSE", "Released under the MIT License.\nand a few words of ours beside it, which are about other things", 1, "q"),
        (2, "s/a/b/x", "no words", 1, "q"),
        (2, "s/a/b/x", "no words", 1, "q"),
        (3, "s/c/x", "text\nLicensed under the Apache License, Version 2.0.\nmore " + "text " * 50, 1, "q"),
        (4, "t", None, 1, "q"),
        (5, None, "", 1, "q"),
        (6, "s/d/terms.txt", "Copyright (c) 2020 Some Body\n\n" + wrap(long["MIT"], ""), 1, "q"),
        (7, "s/d/e/f/g.py", "# Copyright (c) 2021 Some Body\n#\n" + wrap(long["BSD-3-Clause"], "# ") + "\n" + code, 1, "q"),
        (8, "s/d/e/f/h.py", code, 1, "q"),
        (9, "s/h.c", "/*\n * This Source Code Form is subject to the terms of the\n * Mozilla Public License, v. 2.0.\n * If a copy of the MPL was not distributed with this file,\n * You can obtain one at http://mozilla.org/MPL/2.0/.\n */\n" + code, 1, "q"),
        (10, "s/copying.txt", wrap(long["Zlib"], ""), 1, "q"),
        (11, "u/x", "word " * 30_000 + "\0 SPDX-License-Identifier: MIT", 1, "q"),
        (12, "u/y", code + "\n// SPDX-License-Identifier: ISC\n" + code, 1, "q"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, dir int, term string").repartition(3)
    out = license_tfidf.scanned(df, "path").collect()
    got = sorted((r.doc_id, r.license or "", r.basis, r.license_from or "") for r in out)
    assert got == [
        (1, "MIT", "file", "s/a/LICENSE"), (2, "MIT", "inherited", "s/a"), (2, "MIT", "inherited", "s/a"), (3, "Apache-2.0", "header", "s/c/x"),
        (4, "", "none", ""), (5, "", "none", ""), (6, "MIT", "file", "s/d/terms.txt"), (7, "BSD-3-Clause", "header", "s/d/e/f/g.py"), (8, "MIT", "inherited", "s/d"),
        (9, "MPL-2.0", "header", "s/h.c"), (10, "Zlib", "file", "s/copying.txt"), (11, "MIT", "header", "u/x"), (12, "ISC", "header", "u/y"),
    ]
    assert set(out[0].asDict()) == {"doc_id", "path", "dir", "term", "license", "similarity", "basis", "license_from"}

    # Cosines of the whole texts and lines by dictionaries, from all units and terms.
    said = [license_tfidf.terms((r[2] or "").replace("\0", " ")) for r in rows]
    df_ = collections.Counter(t for s in said for t in set(s))

    def vector(t):
        return {w: (1 + math.log(n)) * (math.log((len(rows) + 1) / (df_[w] + 1)) + 1) for w, n in collections.Counter(t).items()}

    def cosine(a, b):
        return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    templates = [(t.name, vector(license_tfidf.terms(t.text))) for t in license_templates.TEMPLATES if t.name]
    by_id = {r.doc_id: r for r in out}
    for doc_id, unit in ((3, rows[3][2].split("\n")[1]), (10, rows[10][2])):
        cos, name = max((round(cosine(vector(license_tfidf.terms(unit)), v), 6), name) for name, v in templates)
        assert (by_id[doc_id].license, by_id[doc_id].similarity) == (name, cos)
    assert by_id[12].similarity == 1
    assert license_tfidf.scanned(df.where("false"), "path").count() == 0



GNU = """This {thing} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation{words}.

This {thing} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} for more details.

You should have received a copy of the GNU {name}
along with this {thing}.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_license_notices_of_one_family(spark):
    """Notices as projects print them, over code, among all documents of a table."""
    later = ", either version {} of the License, or\n(at your option) any later version"
    gnu = lambda name, words, thing="program", mark=":": GNU.format(name=name, words=words, thing=thing, mark=mark)
    code = "\n".join(f"static int f{i}(int a{i}) {{ return a{i} + {i}; }}" for i in range(60))
    said = {
        "GPL-3.0-or-later": gnu("General Public License", later.format(3)),
        "GPL-2.0-or-later": gnu("General Public License", "; either version 2 of the License, or\n(at your option) any later version", mark=";"),
        "GPL-2.0-only": gnu("General Public License", ", version 2 of the License", mark=";"),
        "GPL-3.0-only": gnu("General Public License", ", version 3 of the License"),
        "LGPL-2.1-or-later": gnu("Lesser General Public License", "; either\nversion 2.1 of the License, or (at your option) any later version", "library", ";"),
        "LGPL-2.1-only": gnu("Lesser General Public License", "; version 2.1 of the License", "library", ";"),
        "LGPL-3.0-or-later": gnu("Lesser General Public License", later.format(3), "library"),
        "AGPL-3.0-or-later": gnu("Affero General Public License", later.format(3)),
        "AGPL-3.0-only": gnu("Affero General Public License", ", version 3 of the License"),
        "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.',
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "BSD-3-Clause": "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.",
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "MIT OR Apache-2.0": "SPDX-License-Identifier: MIT OR  Apache-2.0",
        "EPL-2.0": "SPDX-License-Identifier: EPL-2.0 */",
        "GPL-2.0-only WITH Linux-syscall-note": "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note",
        "(MIT AND BSD-2-Clause) OR ISC": "spdx-license-identifier: (MIT AND BSD-2-Clause) OR ISC",
    }
    docs = common.table(spark, SMALL.replace("0.001", "0.01"), "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.concat(F.lit("other/"), "doc_id").alias("path"))
    rows = []
    for i, (name, text) in enumerate(said.items()):
        for mark in ("# ", " * ", "// "):
            rows.append((i, "\n".join(mark + x for x in ["Copyright (C) 2019 Some Body", "", *text.strip().split("\n"), ""]) + "\n" + code, f"made/{i}/{len(rows)}"))
    names = list(said)
    rows += [(500 + i, "no words here", f"made/{i}/x") for i in range(len(names))]  # nothing here is a licence file
    rows += [(900, "MIT License\n\n" + license_templates._MIT, "made/LICENSE"), (901, code, "made/up/x.c"), (902, "/* SPDX-License-Identifier: EPL-2.0 */\n" + code, "made/up/y.c")]
    rows += [(903, "// SPDX-License-Identifier: EPL-2.0", "made/short/y.c"), (904, code, "made/short/z.c")]
    found = license_tfidf.scanned(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, path string")), "path").where("path like 'made%'").collect()
    for r in found:
        if r.doc_id < 100:
            assert (r.license, r.basis) == (names[r.doc_id], "header"), (names[r.doc_id], r.license, r.similarity)
        elif r.doc_id < 900:
            assert (r.license, r.basis, r.license_from) == ("MIT", "inherited", "made")
    got = {r.doc_id: (r.license, r.basis) for r in found}
    assert [got[i] for i in range(900, 905)] == [("MIT", "file"), ("MIT", "inherited"), ("EPL-2.0", "header"), ("EPL-2.0", "header"), ("MIT", "inherited")]


FULL = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="this machine has no licence texts")
@pytest.mark.parametrize("titles", [True, False])
def test_license_full_texts(spark, titles):
    """Whole licence files, also without the lines of their titles."""
    docs = common.table(spark, SMALL.replace("0.001", "0.01"), "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.concat(F.lit("other/"), "doc_id").alias("path"))
    text = {k: open(f"/usr/share/common-licenses/{k}").read() for k in FULL}
    if not titles:
        text = {k: "\n".join(t.split("\n")[8:]) for k, t in text.items()}
    rows = [(i, text[k], f"p{i}/LICENSE") for i, k in enumerate(FULL)]
    found = license_tfidf.scanned(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, path string")), "path").where("doc_id < 100").collect()
    assert {r.doc_id: (r.license, r.basis) for r in found} == {i: (v, "file") for i, v in enumerate(FULL.values())}, [(r.doc_id, r.license, r.similarity) for r in found]


def test_pii(spark, docs):
    def brute(t):
        out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0:
                out.append(("card", m.start(), m.end()))
        return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]

    rng = np.random.default_rng(5)
    for _ in range(3000):
        t = "".join(rng.choice(list("0123456789012345....@@-- +()ab%_\né"), rng.integers(0, 60)))
        assert pii_transducer.joined(pii_transducer.detect(t)) == pii_transducer.joined(brute(t))
    hidden = {"to john.doe (at) example (dot) com now": "to <EMAIL> now", "аlice@exаmple.com ok": "<EMAIL> ok", "call plus four four seven seven zero zero nine zero zero one two three ok": "call <PHONE> ok", "ip １９２.168.0.1 end": "ip <IP> end", "the cat at home dot": "the cat at home dot", "meet at example.com": "meet at example.com"}
    assert {t: pii_transducer.mask(t) for t in hidden} == hidden
    got = pii_transducer.found(docs).collect()
    assert len(got) == docs.count()
    out = pii_transducer.redacted(docs)
    assert out.columns == docs.columns and out.where("text is null").count() == 1


def test_pii_disguises_of_four_languages():
    hidden = {
        "ip 192[.]168[.]0[.]1 end": "ip <IP> end", "ip 192 dot 168 dot 0 dot 1 end": "ip <IP> end", "ip 10 punto 0.0 (punto) 7 end": "ip <IP> end", "max (at) beispiel (punkt) de": "<EMAIL>", "juan arroba correo punto es": "<EMAIL>",
        "marie arobase exemple point fr ok": "<EMAIL> ok", "ruf plus vier neun drei null eins zwei drei vier fünf sechs an": "ruf <PHONE> an", "llama más tres cuatro nueve uno dos tres cuatro cinco seis siete ya": "llama <PHONE> ya",
        "look at this point we make": "look at this point we make", "at one point five": "at one point five", "version 1 dot 2 dot 3": "version 1 dot 2 dot 3", "1.2.3.4.5 dot 6": "1.2.3.4.5 dot 6".replace("1.2.3.4", "<IP>"),
    }
    assert {t: pii_transducer.mask(t) for t in hidden} == hidden


def test_pii_numbers_that_mix_words_and_digits():
    hidden = {
        "card four111 1111 1111 1111 ok": "card <CARD> ok", "pay 4111 one one one one 1111 1111 now": "pay <CARD> now", "four, one, one, one, 1111, 1111, 1111 end": "<CARD> end", "forty-one eleven eleven 11 1111 1111": "<CARD>",
        "ring plus forty-nine, seventeen, 1234567 bye": "ring <PHONE> bye", "+44 seven700 900123": "<PHONE>", "one 2, 3 four": "one 2, 3 four", "twenty one men": "twenty one men", "someone 12345678901234": "someone 12345678901234",
    }
    assert {t: pii_transducer.mask(t) for t in hidden} == hidden
    digits = lambda t: pii_transducer.digits_of(t.split())
    assert [digits("twenty one"), digits("twenty zero"), digits("twenty thirty five nineteen"), digits("plus 4 ninety nine nine")] == ["21", "200", "203519", "+4999"]


def test_pii_gates():
    # An address is found by itself as it is beside other words or letters.
    hidden = ["jane@example dot com", "jane@example (dot) com", "jane [at] example.com", "jane at example dot com", "jane (at) example [.] com", "JANE AT EXAMPLE DOT COM", "jane (dot) doe@example.com", "plus FOUR four SEVEN seven zero zero nine zero zero one two three"]
    for t in hidden:
        spans = lambda text: pii_transducer.detect(text) + pii_transducer.added(text, pii_transducer.detect(text))
        alone = spans(t)
        assert alone
        for lead in ("x at ", "İ ", "( . "):
            assert [(k, a - len(lead), b - len(lead)) for k, a, b in spans(lead + t)] == alone
    # The gates drop nothing that the edits would change.
    rng = np.random.default_rng(6)
    parts = ["a", "b1", " ", " at ", " AT ", " dot ", " Dot ", "(at)", "[dot]", "(.)", ".", "@", "<@>", "İ", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(parts, 9))
        if edits := pii_transducer.sign_edits(t):
            r = pii_transducer.Rewritten(t, edits)
            want = [(k, *r.back(s, e)) for k, s, e in pii_transducer.detect(r.text)]
            base = pii_transducer.detect(t)
            want = [(k, a, b) for k, a, b, touched in want if touched and all(b <= x or y <= a for kind, x, y in base if kind == k)]
            assert pii_transducer.added(t, base) == want


def test_warc(spark):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, "u3", "other"), (4, "u4", None), (5, "u5", ""), (3, "u3", "other"), (None, "u", "same"), (7, "u7", "x" * 300_000)]
    rows += [(100 + i, f"http://h/{i}", f"<html><body>page number {i} {'text ' * (i % 50)}</body></html>") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc_zstd.archived(df)
    got = sorted(map(tuple, warc_zstd.read_archives(manifest).collect()), key=repr)
    top = collections.defaultdict(int)
    for p, _, h in rows:
        top[h or ""] = max(top[h or ""], p or 0)
    b32 = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    want = sorted(((p, len(h or ""), b32(h or ""), "response" if p == top[h or ""] else "revisit", None if p == top[h or ""] else top[h or ""]) for p, _, h in rows), key=repr)
    assert got == want
    with open(manifest.first().uri.removeprefix("file://"), "rb") as f:
        assert f.read(4) == b"\x5d\x2a\x4d\x18"
    assert warc_zstd.read_archives(warc_zstd.archived(df.where("false"))).count() == 0


def test_warc_dictionary_in_every_archive(spark):
    for rows in ([(1, "u", "")], [(1, "u", "x")], [(i, f"u{i}", f"page {i} " * 9) for i in range(7)]):
        manifest = warc_zstd.archived(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
        for r in manifest.collect():
            with open(r.uri.removeprefix("file://"), "rb") as f:
                assert f.read(4) == b"\x5d\x2a\x4d\x18"
        assert sorted(r.page_id for r in warc_zstd.read_archives(manifest).collect()) == [r[0] for r in rows]


def test_warc_frames_stand_alone(spark):
    import struct

    import zstandard

    rows = [(i, f"http://h/{i}", f"<p>{'words of a page ' * 9}{i % 90}</p>") for i in range(300)]
    manifest = warc_zstd.archived(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    seen, ids, refers = [], {}, []
    for uri in [r.uri for r in manifest.collect()]:
        data = open(uri.removeprefix("file://"), "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == warc_zstd.SKIPPABLE
        d, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])), 8 + size
        while at < len(data):
            one = d.decompressobj()
            said = one.decompress(data[at:])
            at = len(data) - len(one.unused_data)
            head = dict(x.split(": ", 1) for x in said.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
            seen.append(head["WARC-Type"])
            ids[head["WARC-Record-ID"]] = head
            if "WARC-Refers-To" in head:
                refers.append(head)
    assert seen[0] == "warcinfo" and collections.Counter(seen) == {"warcinfo": len(manifest.collect()), "response": 90, "revisit": 210}
    # Standard readers find the response of a revisit.
    assert len(refers) == 210 and all(ids[h["WARC-Refers-To"]]["WARC-Type"] == "response" and ids[h["WARC-Refers-To"]]["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"] for h in refers)


def test_quality(spark, docs, monkeypatch):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[x] > 1 for k in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(hit)

    for r in quality_lists.statistics(docs, "stats").collect():
        s = r.stats
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute(r.text)
    # Different windows of one hash are told apart: here all windows share few hashes.
    with monkeypatch.context() as weak:
        weak.setattr(quality_lists.F, "xxhash64", lambda a, b, c: F.length(F.concat(a, b, c)).cast("long") % 5)
        for r in quality_lists.statistics(docs, "stats").collect():
            assert r.stats.n_repeat_words == brute(r.text)[4]
    # A list as one expression decides as the rules do one by one.
    c = quality_lists.Condition
    rules = [(c("symbols_per_word", True, 0.02), c("words", True, 60.0)), (c("chars_per_word", False, 4.5),), (c("repeat_share", True, 0.1), c("dup_line_share", False, 0.5))]
    ratios = [F.expr(c(k, True, 0.0).sql("stats").rsplit(" > ", 1)[0]).alias(k) for k in quality_lists.RATIOS]
    found = quality_lists.judged(docs, rules).select("rule", *ratios).collect()
    x = np.array([[float(r[k]) for k in quality_lists.RATIOS] for r in found])
    first = np.select([quality_lists.hits(rule, x) for rule in rules], [1, 2, 3], 0)
    assert [r.rule or 0 for r in found] == first.tolist() and set(first) == {0, 1, 2, 3}
    real, labels = common.table(spark, SMALL, "documents"), common.table(spark, SMALL, "labels")
    out = quality_lists.filtered(real, labels)
    assert out.columns == real.columns and 0 < out.count() < real.count()
    assert quality_lists.learned(real, labels.where("false")) == [] and quality_lists.filtered(nothing(docs), labels).count() == 0
    x = np.array([[100, 5, 0.9 if i % 4 == 0 else 0.01, 0, 0, 0] for i in range(200)], float)
    rules = quality_lists.cover(x, np.arange(200) % 4 == 0)
    assert [str(c).split()[:2] for r in rules for c in r] == [["symbols_per_word", ">"]]


def test_quality_learns_planted_conjunctions():
    # Two conditions, three conditions, and a condition that only the growing part backs, which pruning takes back.
    rng = np.random.default_rng(21)
    x = rng.uniform(0, 1, (3000, 6)) * [1000, 10, 1, 1, 1, 1]
    two = (x[:, 2] > 0.6) & (x[:, 4] > 0.5)
    three = (x[:, 0] <= 500) & (x[:, 3] > 0.5) & (x[:, 5] > 0.6)
    bad = two | three
    rules = quality_lists.cover(x, bad)
    covered = np.logical_or.reduce([quality_lists.hits(r, x) for r in rules])
    assert covered[bad].mean() > 0.9 and (~covered[~bad]).mean() > 0.97
    names = {frozenset(c.ratio for c in r) for r in rules}
    assert any({"symbols_per_word", "dup_line_share"} <= n for n in names) and any({"words", "marks_per_word", "repeat_share"} <= n for n in names)
    spurious = (quality_lists.Condition("symbols_per_word", True, 0.6), quality_lists.Condition("words", True, 990.0))
    assert quality_lists.pruned(spurious, x, x[:, 2] > 0.6, 1.0) == spurious[:1]


def test_quality_names(spark, docs):
    labels = common.table(spark, SMALL, "labels")
    odd = ["__rp_words", "__rp_lines", "__rp_windows", "__rp_bound", "__rp_stats", "__rp_kept", "stats", "kept", "rule", "failed", "id", "y"]
    clash = docs.select("doc_id", "text", *[F.lit(7).alias(c) for c in odd])
    kept = quality_lists.filtered(clash, labels)
    assert kept.columns == clash.columns and all(tuple(r)[2:] == (7,) * len(odd) for r in kept.collect())
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in quality_lists.filtered(docs, labels).collect())
    with pytest.raises(ValueError):
        quality_lists.judged(clash, [])


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = common.table(spark, SMALL, "documents")
    n, seen = docs.count(), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SMALL), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.count())
    assert n > seen[0] >= seen[1] >= seen[2] == seen[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == seen[3]


def test_pipeline_on_odd_tables(spark):
    # Nulls in every column, empty and very long texts, a word of a million
    # characters, repeated rows and ids, and names that the stages use themselves.
    import corpus_pipeline

    rng = np.random.default_rng(22)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(n)) + "."
    copy = prose(120)
    rows = [(1, copy), (2, copy + " Ends elsewhere"), (3, copy), (3, copy), (None, copy), (None, prose(80)), (None, prose(80)), (4, None), (None, None), (5, ""), (6, " \n"), (7, prose(200_000)), (8, prose(90)), (8, prose(95)), (9, "x" * 1_000_000 + " " + prose(80)), (10, "x" * 1_000_000), (11, prose(60) + " a@b.de +49 170 1234567")]
    names = ["__rp_row", "__rp_words", "__rp_stats", "__rp_kept", "row", "node", "class", "fp", "key", "id", "kept", "score", "spans", "sequence_id", "number"]
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "s", None, *[f"{c}{k}" for c in names]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)).repartition(4)
    every, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SMALL), name)
        assert docs.columns == every.columns and docs.dtypes == every.dtypes
        assert all(r["__rp_row"][8:] == r["number"][6:] == r["class"][5:] for r in docs.collect())  # a row's columns stay its own
        seen.append(sorted(r.doc_id or 0 for r in docs.collect()))
    assert seen[0] == sorted([0, 0, 0, 1, 2, 3, 3, 7, 8, 8, 9, 11]) and seen[1] == seen[0]
    assert seen[2] == seen[3] == sorted([0, 0, 1, 7, 8, 8, 9, 11])  # of the copies the smallest id stays
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len({r.doc_id for r in packed}) == 6
    nothing_left = every.where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        nothing_left = stage(spark, nothing_left, SMALL)
        assert nothing_left.columns == every.columns and nothing_left.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, nothing_left, SMALL).count() == 0


def test_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]

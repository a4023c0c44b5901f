"""Periodic runs, interpolated n-grams and the Merkle manifest against brute
force, on fixtures with nulls, empty and long texts, ties, repeated rows, empty
tables and clashing columns."""

import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rowproof.llm import common, interpolated_ngrams, merkle_manifest, periodic_runs, queries

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \t\n", "a", "a b", "A b", "a b c d e f " * 7, "word " * 3_000, "x" * 1_000_000, "é\u0085中 é\u0085中 " * 9, "Ä ö ü", "a b c d e f g h", "a b c d e f g h"]


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1) for r in common.table(spark, SMALL, "documents").collect()]
    rows = real + [(10_000 + i, t, "en", "odd", 5, 2) for i, t in enumerate(ODD)]
    rows += [(10_000, ODD[0], "en", "odd", 5, 2), (None, "lost id", None, None, None, 3), (None, "lost id", None, None, None, 3), (20_000, "alone", "en", "one row", 5, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int").repartition(5).cache()


def brute_runs(w, shortest):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - s + q >= max(shortest, 2 * q):
                best.setdefault((s - q, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_are_all_maximal_repetitions():
    rng = random.Random(1)
    for _ in range(1500):
        n, kinds = rng.randint(0, 90), rng.choice([1, 2, 2, 3, 5, 30])
        w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            for i in range(a, rng.randint(a, n)):
                w[i] = w[a + (i - a) % p]
        shortest = rng.choice([1, 2, 4, 5, 12, 12])
        assert periodic_runs.runs(w, shortest) == brute_runs(w, shortest), (w, shortest)


def test_runs_of_a_constant_text_take_one_diagonal():
    assert periodic_runs.runs([b"x"] * 300_000) == [(0, 300_000, 1)]
    assert periodic_runs.runs([b"%d" % (i % 777) for i in range(100_000)]) == [(0, 100_000, 777)]


def test_runs_query(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count()
    got, changed = collections.defaultdict(list), 0
    for r in rows:
        got[r.doc_id].append(tuple(r)[1:])
    for d in docs.collect():
        w = (d.text or "").encode().split()
        h = zlib.crc32(str(d.doc_id).encode()) if d.doc_id is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            changed += 1
        found = brute_runs(w, 12)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        said = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        want = (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
        assert got[d.doc_id].pop() == want, d.doc_id
    assert changed > 10


def test_runs_of_an_empty_table(docs):
    assert periodic_runs.periodic_runs(docs.where("false")).collect() == []


def words_of(text):
    return (text or "").encode().lower().split() + [None]  # None: the end


class Brute:
    """Counts of n-grams as dictionaries."""

    def __init__(self, texts, order):
        self.order, self.grams = order, collections.Counter()
        for t in texts:
            for h in self.events(t):
                self.grams.update(h)
        self.tokens = sum(c for (k, *_), c in self.grams.items() if k == 1)
        self.types = len([1 for k, *_ in self.grams if k == 1])
        self.after = collections.Counter()
        for (k, *g), c in self.grams.items():
            self.after[(k, *g[:-1])] += c

    def events(self, text):
        w = ["start"] * (self.order - 1) + words_of(text)
        return [[(k, *w[i - k + 1 : i + 1]) for k in range(1, self.order + 1)] for i in range(self.order - 1, len(w))]

    def mixture(self, event, weights):
        """Probability, and the joint probability with each level answering."""
        p, parts = 1 / (self.types + 1), [1 / (self.types + 1)]
        for k, g in enumerate(event, 1):
            h = self.after[(k, *g[1:-1])]
            w = weights[k - 1][int(math.log2(h)) + 1] if h else 0
            own = w * self.grams[g] / h if h else 0
            parts = [x * (1 - w) for x in parts] + [own]
            p = own + (1 - w) * p
        return p, parts

    def bucket(self, k, g):
        h = self.after[(k, *g[1:-1])]
        return int(math.log2(h)) + 1 if h else 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_interpolated_ngrams(docs, order):
    trains = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    model, short, told = interpolated_ngrams.fitted(docs, trains, order=order)
    rows = docs.collect()
    got = collections.defaultdict(list)
    for r in interpolated_ngrams.applied(model, short, told).collect():
        got[r.id].append(r)
    training = [r.text for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    full = Brute(training, order)
    assert (model.tokens, model.types) == (full.tokens, full.types)
    for d in rows:
        r, events = got[d.doc_id].pop(), full.events(d.text)
        assert r.n_tokens == len(events) and r.train_tokens == full.tokens
        assert r.n_known == sum(full.grams[e[0]] > 0 for e in events)
        assert r.base_score == pytest.approx(sum(math.log10((full.grams[e[0]] + 1) / (full.tokens + full.types + 1)) for e in events), abs=1e-6)
        assert r.score == pytest.approx(sum(math.log10(full.mixture(e, model.weights)[0]) for e in events), abs=1e-6)
    # the weights: expectation-maximisation by hand on the texts held out
    held = [t for t in training if xxhash.xxh64_intdigest((t or "").encode(), 2) % interpolated_ngrams.DELETED == 0]
    kept = Brute([t for t in training if xxhash.xxh64_intdigest((t or "").encode(), 2) % interpolated_ngrams.DELETED], order)
    events = collections.Counter(tuple(e) for t in held for e in kept.events(t))
    assert sum(events.values()) == model.events > 0
    weights, likelihood = np.full((order, interpolated_ngrams.BUCKETS), 0.5), []
    for _ in range(model.rounds):
        own, every, total = collections.Counter(), collections.Counter(), 0
        for e, m in events.items():
            p, parts = kept.mixture(e, weights)
            total += m * math.log(p)
            for k, g in enumerate(e, 1):
                own[k, kept.bucket(k, g)] += m * parts[k] / p
                every[k, kept.bucket(k, g)] += m * sum(parts[: k + 1]) / p
        likelihood.append(total)
        for (k, b), x in every.items():
            if b and x:
                weights[k - 1, b] = min(interpolated_ngrams.MOST, own[k, b] / x)
    for (k, b), x in every.items():
        if b and x:
            assert model.weights[k - 1, b] == pytest.approx(weights[k - 1, b], abs=1e-5)
    assert all(b >= a - 1e-6 for a, b in zip(likelihood, likelihood[1:], strict=False))
    # probabilities after any context add up to one
    for context in [g[1:-1] for g in list(full.grams)[:2000:97] if g[0] == order]:
        each = [(k, *context[len(context) - k + 1 :]) for k in range(1, order + 1)]
        said = [g[1] for g in full.grams if g[0] == 1] + ["unknown"]
        assert sum(full.mixture([(*h, w) for h in each], model.weights)[0] for w in said) == pytest.approx(1)


def test_interpolation_beats_the_base_on_held_out_texts(spark):
    rows = queries.op12_interpolated_ngrams(spark, SMALL).where("held_out").collect()
    assert len(rows) > 20 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_blocks_and_ranges_do_not_change_scores(docs, monkeypatch):
    trains = F.col("doc_id") % 3 != 0
    want = {(r.id, r.score, r.n_known) for r in interpolated_ngrams.scored(docs, trains).select("id", F.round("score", 6).alias("score"), "n_known").collect()}
    monkeypatch.setattr(interpolated_ngrams, "RANGE", 500)
    monkeypatch.setattr(interpolated_ngrams, "BLOCK", 10_000)
    got = {(r.id, r.score, r.n_known) for r in interpolated_ngrams.scored(docs.repartition(3), trains).select("id", F.round("score", 6).alias("score"), "n_known").collect()}
    assert got == want


def test_ngrams_without_training_texts_or_rows(docs):
    rows = interpolated_ngrams.scored(docs, F.lit(False)).collect()
    assert len(rows) == docs.count() and {(r.train_tokens, r.n_known, r.base_score, r.score) for r in rows} == {(0, 0, 0.0, 0.0)}
    assert interpolated_ngrams.scored(docs.where("false"), F.lit(True)).collect() == []
    few = docs.where("doc_id = 10004 or doc_id = 10001")
    assert sorted(r.n_tokens for r in interpolated_ngrams.scored(few, F.lit(True)).collect()) == [1, 3]


class Caught:
    """Stands for blocks and answers; hands over the function that would score them."""

    where = groupBy = cogroup = lambda self, *_: self

    def applyInArrow(self, f, _):
        return f


def block_told(texts, order, seed=0):
    """A block of texts, invented answers to it, and a model."""
    block, rng = interpolated_ngrams.Block(), np.random.default_rng(seed)
    for i, t in enumerate(texts):
        block.add(i, t.encode(), True)
    short = pa.Table.from_pylist([block.row(0, False)], interpolated_ngrams.BLOCKS)
    told = []
    for k, keys in enumerate(interpolated_ngrams.grams_of(short, 0, order)[0].keys, 1):
        for shard, part in enumerate(np.array_split(rng.zipf(1.7, len(keys)).clip(max=10**6).astype(np.int64) - 1, 16)):
            told.append({"block": 0, "n": k, "shard": shard, "total": interpolated_ngrams.crushed(part)})
    weights = rng.random((order, interpolated_ngrams.BUCKETS))
    return short, pa.Table.from_pylist(told, interpolated_ngrams.ANSWERS), interpolated_ngrams.Model(order, 10**7, 10**5, weights, 1, 1)


def test_a_block_of_ngrams_is_scored_in_little_memory():
    rng = np.random.default_rng(3)
    texts = [" ".join(map("w{}".format, rng.zipf(1.2, 2_000).clip(max=10**6))) for _ in range(500)]
    short, told, model = block_told(texts, 2)
    score, n = interpolated_ngrams.applied(model, Caught(), Caught()), short.column("n")[0].as_py()
    assert n > 1_000_000
    for f in (lambda: interpolated_ngrams.grams_of(short, 0, 2), lambda: score(short, told)):
        tracemalloc.start()
        f()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 56 * n  # bytes a token; 86 were needed when every step held all tokens


@pytest.mark.parametrize("order", [1, 2, 3])
def test_slices_of_a_block_do_not_change_scores(order, monkeypatch):
    texts = ["a b c a b", "", " ", "one", "a b c d e f g " * 9, "", "b a " * 30, "x y z"]
    short, told, model = block_told(texts, order)
    score = interpolated_ngrams.applied(model, Caught(), Caught())
    want = score(short, told).to_pydict()
    for size in (1, 2, 5, 7, 64):
        monkeypatch.setattr(interpolated_ngrams, "SLICE", size)
        got = score(short, told).to_pydict()
        for column, values in want.items():
            assert got[column] == pytest.approx(values, rel=1e-12)


def test_short_words_close_a_block():
    block, words = interpolated_ngrams.Block(), 1_000
    block.add(1, b"a " * words, True)
    assert block.bytes >= 4 * words


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(d, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d.doc_id, d.source, d.lang, d.n_chars, text)])


def brute_tree(nodes):
    """The top, and for every node the (left, right) of each level."""
    paths, spans = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for i in range(len(run)):
                for x in spans[a + i]:
                    paths[x].append(("".join(run[:i]), "".join(run[i + 1 :])))
        spans = [sum(spans[a : a + 16], []) for a in range(0, len(nodes), 16)]
        nodes = [sha(*nodes[a : a + 16]) for a in range(0, len(nodes), 16)]
    return nodes[0], paths


def test_merkle_query(spark, docs, tmp_path):
    many = docs.unionByName(docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", "lang", F.lit("src0").alias("source"), "n_chars", "rank").where("doc_id < 1000150"))
    wide = spark.range(300).select(F.col("id") + 5_000_000, F.lit("t").alias("text"), F.lit("x").alias("lang"), F.concat(F.lit("s"), F.col("id") % 290).alias("source"), F.lit(1).cast("long"), F.lit(1)).toDF(*many.columns)
    many = many.unionByName(wide)
    many.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op13_merkle_manifest(spark, str(tmp_path)).collect()
    groups = collections.defaultdict(list)
    for d in many.collect():
        groups[d.source].append((d.doc_id is not None, d.doc_id or 0, leaf_of(d, d.text), d))
    tops, below = [], []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(groups[source], key=lambda x: x[:3])
        top, paths = brute_tree([x[2] for x in leaves])
        tops.append(top)
        below.append((leaves, top, paths))
    root, above = brute_tree(tops)
    want = []
    for (leaves, top, paths), high in zip(below, above, strict=True):
        for (_, _, leaf, d), path in zip(leaves, paths, strict=True):
            now = leaf
            if d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 5 == 0:
                now = leaf_of(d, d.text and d.text.translate({c: c + 32 for c in range(65, 91)}))
            for left, right in path + high:
                now = sha(left, now, right)
            want.append((d.doc_id or -1, leaf, top, root, sha(*[x for s in path + high for x in s]), now, now == root))
    assert sorted((r.doc_id or -1, *tuple(r)[1:]) for r in rows) == sorted(want)
    assert {r.verified for r in rows} == {True, False}


def test_merkle_requests_and_small_tables(spark, docs):
    leaf = merkle_manifest.digest_of(F.col("doc_id"), F.col("text"))
    made = merkle_manifest.manifest(docs, leaf)
    some = made.leaves.where("id % 20 = 3 or tree = ''")
    every = {(r.id, r.rank): r.path for r in merkle_manifest.proofs(made).collect()}
    got = merkle_manifest.proofs(made, some).withColumn("root", merkle_manifest.folded(F.col("leaf"), F.col("path"))).collect()
    assert len(got) == some.count() > 5 and {r.root for r in got} == {made.root}
    assert all(r.path == every[r.id, r.rank] for r in got)
    # records are stored once, under the digest of what they hold
    assert all(r.digest == sha(*r.children) for r in made.nodes.collect()) and made.nodes.count() == made.nodes.select("digest").distinct().count()
    one = merkle_manifest.manifest(docs.where("doc_id = 20000"), leaf)
    (r,) = merkle_manifest.proofs(one).collect()
    assert one.root == r.leaf == r.subroot and r.path == []
    none = merkle_manifest.manifest(docs.where("false"), leaf)
    assert none.root is None and merkle_manifest.proofs(none).collect() == []

"""Toxic spans by a linear-chain conditional random field.

Learning (driver, from at most ``PER_CLASS`` labelled documents of each class,
equal texts once): words and word beginnings whose document counts lean to the
toxic class by a wide margin label the tokens of toxic documents; a two-label chain with word,
affix and shape features is fitted to these tokens by its likelihood gradient,
long documents in pieces and all pieces in blocks, so memory stays flat;
a logistic curve maps a document's marginals to a probability.

Scoring (Spark tasks): forward-backward marginals of every token of every whole
text, many documents side by side, in time proportional to the tokens.  Tokens
whose marginal is at least one half form spans with source offsets.

Defined results: null and empty texts have no spans and the score that the
curve gives to no toxic token; without labelled documents of both classes every
score is the share of toxic labels (0 if there is none); repeated rows repeat.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Bounds of the learning sample: documents of a class, and those of them that fit the chain.
PER_CLASS, CHAIN_PER_CLASS = 1500, 400
#: Words of a piece of a document that is fitted as a chain (a longer document is
#: several pieces, all of them fitted), and tokens that are worked on at once.
CHAIN_WORDS, CHAIN_BLOCK = 512, 200_000
#: A word labels tokens if it leans to toxic documents by so many standard
#: deviations, in so many of them, as this share of all that hold it.
LEAN, LEAST, PURE = 6.5, 4, 0.8
#: Lengths of the word beginnings that count as words do, for inflected words.
STEMS = (4, 5, 6)
EPOCHS, RATE, RIDGE = 40, 0.25, 0.02
#: Words whose potentials a worker remembers.
WORDS = 400_000

EDGE = re.compile(r"^\W+|\W+$")
TOKEN = re.compile(r"\S+")


def features(token: str) -> list[str]:
    word = EDGE.sub("", token)
    out = ["*", f"w={word}", f"s={word[-3:]}", *[f"p={word[:n]}" for n in STEMS if len(word) > n]]
    if any(c.isdigit() for c in word):
        out.append("digit")
    if len(word) != len(token):
        out.append("edge")
    return out


def recursion(e: np.ndarray, lengths: np.ndarray, a: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (label 1 to label 0) of sequences laid side by
    side: ``e`` (time, sequence) odds of label 1, longest sequence first."""
    forward, backward = np.empty_like(e), np.ones_like(e)
    steps = len(e)
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # sequences longer than t
    forward[0] = e[0] * start
    for t in range(1, steps):
        k = live[t]
        r = forward[t - 1, :k]
        forward[t, :k] = e[t, :k] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0])
    for t in range(steps - 2, -1, -1):
        k = live[t + 1]
        x = e[t + 1, :k] * backward[t + 1, :k]
        backward[t, :k] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
    return forward, backward


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    chain: list[list[float]] = field(default_factory=lambda: [[1.0, 1.0], [1.0, 1.0]])
    start: float = 1.0
    curve: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    bias: float = -20.0

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def odds(self, token: str) -> float:
        return math.exp(max(-30.0, min(30.0, sum(self.weights.get(f, 0.0) for f in features(token)))))

    def potentials(self, tokens: list[str]) -> np.ndarray:
        got = list(map(self.known.get, tokens))
        if None in got:
            if len(self.known) > WORDS:
                self.known.clear()
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self.known[tokens[i]] = self.odds(tokens[i])
        return np.array(got)

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """P(toxic) of each white-space token of each text."""
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        each = [self.potentials(t.lower().split()) for t in texts]
        order = sorted((i for i in range(len(each)) if len(each[i])), key=lambda i: -len(each[i]))
        a = np.array(self.chain)
        while order:
            # Side by side: documents of like length, as many as keep the block small.
            n = max(1, min(len(order), 1_000_000 // len(each[order[0]])))
            some, order = order[:n], order[n:]
            lengths = np.array([len(each[i]) for i in some])
            e = np.ones((lengths[0], len(some)))
            for k, i in enumerate(some):
                e[: lengths[k], k] = each[i]
            forward, backward = recursion(e, lengths, a, self.start)
            p = forward * backward
            p = (p / (1 + p)).T
            for k, i in enumerate(some):
                out[i] = p[k, : lengths[k]].copy()
        return out

    def score(self, p: np.ndarray) -> float:
        x = summary(p)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(x @ np.array(self.curve))))))


def summary(p: np.ndarray) -> np.ndarray:
    """Strongest token, expected toxic tokens, and their share, of a document."""
    if not len(p):
        return np.zeros(3)
    s = float(p.sum())
    return np.array([float(p.max()), math.log1p(s), min(1.0, 20 * s / len(p))])


def units(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]] if word else []


def lexicon(docs: list[tuple[str, int]], share: float) -> set[str]:
    """Words and beginnings that lean to toxic documents, clean ones weighing
    what they weigh among all labels."""
    clean, bad = Counter(), Counter()
    for text, y in docs:
        (bad if y else clean).update({u for t in set(text.lower().split()) for u in units(EDGE.sub("", t))})
    toxic = sum(y for _, y in docs)
    ratio = (1 - share) / share * toxic / max(1, len(docs) - toxic)
    out = set()
    for u, k in bad.items():
        n = k + ratio * clean[u]
        if k >= LEAST and k >= PURE * n and k - n * share >= LEAN * math.sqrt(n * share * (1 - share)):
            out.add(u)
    return out


def pieces(words: list[str]) -> list[list[str]]:
    """A document's words in pieces of nearly equal length, none over ``CHAIN_WORDS``."""
    k = -(-len(words) // CHAIN_WORDS)
    return [words[len(words) * i // k : len(words) * (i + 1) // k] for i in range(k)]


class Block:
    """Pieces laid side by side, longest first, with the labels of their tokens."""

    def __init__(self, seqs: list[tuple[list[int], list[bool]]]):
        self.lengths = np.array([len(s) for s, _ in seqs])
        self.ids = np.full((self.lengths[0], len(seqs)), -1, np.int32)
        gold = np.zeros(self.ids.shape, bool)
        for k, (s, y) in enumerate(seqs):
            self.ids[: len(s), k], gold[: len(s), k] = s, y
        self.there, self.gold = self.ids >= 0, gold
        pair = self.there[1:]
        self.pairs = np.array([[(pair & (gold[:-1] == i) & (gold[1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)

    def gradient(self, unit: np.ndarray, trans: np.ndarray, begin: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Observed less expected: of each word's label, of the label pairs, and of the first labels."""
        e = np.where(self.there, np.exp(np.clip(unit[self.ids], -30, 30)), 1.0)
        a = np.exp(trans)
        f, b = recursion(e, self.lengths, a, math.exp(begin))
        p = f * b
        p = p / (1 + p)
        pair = self.there[1:]
        x = np.where(pair, e[1:] * b[1:], 0)
        cells = np.stack([np.ones_like(x) * a[0, 0], a[0, 1] * x, f[:-1] * a[1, 0], f[:-1] * a[1, 1] * x])
        cells = np.where(pair, cells / cells.sum(0), 0).sum((1, 2)).reshape(2, 2)
        return np.bincount(self.ids[self.there], (self.gold - p)[self.there], len(unit)), self.pairs - cells, float((self.gold[0] - p[0]).sum())


def fit_chain(model: Model, docs: list[tuple[str, int]], words: set[str]) -> None:
    """Maximise the likelihood of the token labels by adaptive gradient steps."""
    cut = sorted(((piece, y) for t, y in docs for piece in pieces(t.lower().split())), key=lambda x: -len(x[0]))
    names: dict[str, int] = {}
    tokens: dict[str, list[int]] = {}
    count = Counter(f for s, _ in cut for t in set(s) for f in features(t))
    for s, _ in cut:
        for t in s:
            if t not in tokens:
                tokens[t] = [names.setdefault(f, len(names)) for f in features(t) if f == "*" or count[f] >= 3]
    vocab = {t: i for i, t in enumerate(tokens)}
    row = np.repeat(np.arange(len(vocab)), [len(x) for x in tokens.values()])
    col = np.array([i for x in tokens.values() for i in x])
    hit = {t: not words.isdisjoint(units(EDGE.sub("", t))) for t in vocab}
    blocks, i = [], 0
    while i < len(cut):
        k = max(1, CHAIN_BLOCK // len(cut[i][0]))
        blocks.append(Block([([vocab[t] for t in s], [y == 1 and hit[t] for t in s]) for s, y in cut[i : i + k]]))
        i += k
    w, trans, begin = np.zeros(len(names)), np.zeros((2, 2)), 0.0
    w[names["*"]] = -4.0
    square = [np.full(len(names), 1e-6), np.full((2, 2), 1e-6), 1e-6]
    n = len(cut)
    for _ in range(EPOCHS):
        unit = np.bincount(row, w[col], len(vocab))
        diff, cells, first = (sum(x) for x in zip(*(b.gradient(unit, trans, begin) for b in blocks), strict=True))
        steps = (np.bincount(col, diff[row], len(names)) / n - RIDGE * w / n, cells / n - RIDGE * trans, first / n - RIDGE * begin)
        for k, g in enumerate(steps):
            square[k] = square[k] + g * g
        w = w + RATE * steps[0] / np.sqrt(square[0]) * (np.abs(steps[0]) > 1e-9)
        trans = trans + RATE * steps[1] / np.sqrt(square[1])
        begin = begin + RATE * steps[2] / math.sqrt(square[2])
    model.weights = {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}
    model.chain, model.start = np.exp(trans).tolist(), math.exp(begin)


def fit_curve(model: Model, docs: list[tuple[str, int]], share: float) -> None:
    """Logistic regression of the label on a document's marginals; the classes
    weigh what they weigh among all labels."""
    x = np.stack([summary(p) for p in model.marginals([t for t, _ in docs])])
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.array([y for _, y in docs], float)
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, len(y) - y.sum())) * len(y)
    b = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.diag([1, 1, 1, 1e-3])
        b = b + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.5 * np.array([1, 1, 1, 1e-3]) * b), -2, 2)
    model.curve, model.bias = b[:3].tolist(), float(b[3])


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled documents, chosen by a hash of the id."""
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    total = {r.y: r.n for r in some.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = total.get(1, 0) / max(1, sum(total.values()))
    model = Model(bias=math.log(max(1e-6, share) / max(1e-6, 1 - share)) if total else -20.0)
    chosen = [some.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS) for y in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # Both sides of the union are limited above, so what is broadcast has a bound.
    found = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").groupBy(F.xxhash64("text").alias("h"), "y").agg(F.min_by("text", "id").alias("text")).orderBy("h", "y").limit(4 * PER_CLASS)
    rows = [(r.text, r.y) for r in found.select("text", "y").toLocalIterator()]
    if {y for _, y in rows} != {0, 1}:
        return model
    return fitted(model, rows, share)


def fitted(model: Model, rows: list[tuple[str, int]], share: float) -> Model:
    words = lexicon(rows, share)
    if words:
        chain = [r for y in (0, 1) for r in [r for r in rows if r[1] == y and r[0].split()][:CHAIN_PER_CLASS]]
        if chain:
            fit_chain(model, chain, words)
        fit_curve(model, rows, share)
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """(id, score, spans array<struct<start, end, p>>) of every row; offsets are
    code points, ends exclusive, neighbouring toxic tokens in one span."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was learned from
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ps = m.marginals(texts)
            found = [spans_of(t, p) if with_spans else [] for t, p in zip(texts, ps, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([m.score(p) for p in ps], pa.float64()), pa.array(found, spans)], ["id", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, spans array<struct<start:int,end:int,p:double>>")


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    if not len(p) or p.max() < 0.5:
        return []
    out: list[dict] = []
    last = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if p[i] >= 0.5:
            if last == i - 1:
                out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], float(p[i]))}
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(p[i])})
            last = i
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that learning never sees: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def filtered(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, columns unchanged."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = shared.value.marginals([t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()])
            yield b.filter(pa.array([shared.value.score(p) < limit for p in ps], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

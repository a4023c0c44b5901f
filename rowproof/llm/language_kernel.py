"""Language identification with a string kernel.

The kernel is the blended-spectrum presence kernel: the number of distinct byte
n-grams (``MIN_N`` to ``MAX_N`` bytes of the lower-cased UTF-8 text) that two
texts share, normalised by both texts' own counts.  Nyström landmarks are a few
learning texts of each language; kernel values to the landmarks span the
feature space in which one-versus-rest ridge regression is solved.

A language's score is linear in the kernel row, so landmarks and coefficients
are multiplied once: the presence matrix of the landmarks (n-grams by
landmarks) times the coefficients gives a number for each n-gram and language.
A batch of texts is then scored as its sparse presence matrix times these.

N-grams are packed into 64-bit numbers and looked up exactly, so the kernel is
exact; every n-gram of a landmark and every learned language counts, and whole
texts of any length are read.

Defined results: ``und`` with score 0 for null texts and texts without a
letter, and for every text if no labelled text could be learned from; with a
single learned language that one is given; ties go to the language first in
order; repeated rows repeat.  The score is the winning regression value, cut to
0..1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches

#: Bounds: learning texts of a language, of all languages together (each has two at least), and landmarks of a language.
PER_LANGUAGE, LEARNED, LANDMARKS = 300, 60_000, 40
MIN_N, MAX_N = 1, 4
#: Ridge of the regression; eigenvalues of the landmark kernel below this share of the largest are left out.
RIDGE, RANK = 1e-2, 1e-6
#: Texts of one product.
BATCH = 128
LETTER = re.compile(r"[^\W\d_]")


def grams(text: str) -> np.ndarray:
    """Distinct n-grams of a text, each as its bytes behind a leading one."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    out, g = [], np.full(len(b), 1, np.uint64)
    for n in range(1, MAX_N + 1):
        if len(b) < n:
            break
        g = (g[: len(b) - n + 1] << np.uint64(8)) | b[n - 1 :]
        if n >= MIN_N:
            s = np.sort(g)
            out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Lookup:
    """Places of numbers in a sorted array: most stand alone in their slot of a
    table, the others are searched for."""

    def __init__(self, known: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(len(known) + 1))) + 3)
        self.table, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        s, first = np.unique(self.slot(known), return_index=True)
        self.table[s], self.place[s] = known[first], first
        self.rest = np.delete(np.arange(len(known)), first)
        self.others = known[self.rest]

    def slot(self, g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, g: np.ndarray) -> np.ndarray:
        """Place of each number, or -1.  Zero is never one of them."""
        s = self.slot(g)
        there = self.table[s]
        out = np.where(there == g, self.place[s], -1)
        if len(self.others):
            miss = np.flatnonzero((there != g) & (there != 0))
            at = np.minimum(np.searchsorted(self.others, g[miss]), len(self.others) - 1)
            hit = self.others[at] == g[miss]
            out[miss[hit]] = self.rest[at[hit]]
        return out


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # sorted n-grams of all landmarks
    folded: np.ndarray  # (n-gram, language)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "lookup"}

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """Regression values (text, language) of texts, given as their n-grams."""
        if not hasattr(self, "lookup"):
            self.lookup = Lookup(self.grams)
        at = self.lookup.find(np.concatenate(sets))
        text = np.repeat(np.arange(len(sets)), [len(g) for g in sets])[at >= 0]
        rows = self.folded[at[at >= 0]]
        out = np.zeros((len(sets), len(self.languages)))
        if len(text):
            first = np.flatnonzero(np.diff(text, prepend=-1))
            out[text[first]] = np.add.reduceat(rows, first, axis=0)
        return out / np.sqrt(np.maximum([len(g) for g in sets], 1))[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        live = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        for a in range(0, len(live), BATCH):
            some = live[a : a + BATCH]
            y = self.scores([grams(texts[i]) for i in some])
            for i, best, value in zip(some, y.argmax(1).tolist(), y.max(1).tolist(), strict=True):
                lang[i], score[i] = self.languages[best], min(1.0, max(0.0, float(value)))
        return lang, score


EMPTY = Model([], np.zeros(0, np.uint64), np.zeros((0, 0)))


def kernel(sets: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """Shared n-grams of texts and landmarks, normalised by the counts of both."""
    gram, mark = np.concatenate(marks), np.repeat(np.arange(len(marks)), [len(m) for m in marks])
    order = np.argsort(gram, kind="stable")
    gram, mark = gram[order], mark[order]
    out = np.zeros((len(sets), len(marks)))
    for i, g in enumerate(sets):
        a, b = np.searchsorted(gram, g), np.searchsorted(gram, g, side="right")
        n = b - a
        spread = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[i] = np.bincount(mark[spread], minlength=len(marks))
    own = lambda some: np.sqrt(np.maximum([len(g) for g in some], 1))
    return out / own(sets)[:, None] / own(marks)


def fitted(rows: list[tuple[str, str]]) -> Model:
    """Fit to (language, text) rows; the first of each language are the landmarks."""
    rows = [r for r in rows if r[1] and LETTER.search(r[1])]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return EMPTY
    sets, of, at = [grams(t) for _, t in rows], {name: i for i, name in enumerate(languages)}, {}
    for i, r in enumerate(rows):
        at.setdefault(r[0], []).append(i)
    marks = [i for name in languages for i in at[name][:LANDMARKS]]
    k_nm = kernel(sets, [sets[i] for i in marks])
    values, vectors = np.linalg.eigh(k_nm[marks] / 2 + k_nm[marks].T / 2)
    keep = values > RANK * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = k_nm @ root
    y = np.zeros((len(rows), len(languages)))
    y[np.arange(len(rows)), [of[r[0]] for r in rows]] = 1
    # Every language weighs the same, however many rows it has.
    w = (1 / y.sum(0))[y.argmax(1)][:, None]
    solved = np.linalg.solve((phi * w).T @ phi + RIDGE * len(languages) / len(rows) * np.eye(phi.shape[1]), (phi * w).T @ y)
    weights = root @ solved / np.sqrt([max(1, len(sets[i])) for i in marks])[:, None]
    held, mark = np.concatenate([sets[i] for i in marks]), np.repeat(np.arange(len(marks)), [len(sets[i]) for i in marks])
    order = np.argsort(held, kind="stable")
    first = np.flatnonzero(np.diff(held[order], prepend=np.uint64(0)))
    folded = np.stack([np.add.reduceat(weights[:, k][mark[order]], first) for k in range(len(languages))], 1)
    return Model(languages, held[order][first], folded)


def learned(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``PER_LANGUAGE`` texts of every language, fewer where there
    are so many languages that these would be over ``LEARNED``, chosen by a hash
    of the id."""
    spark = docs.sparkSession
    some = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h")).where("lang is not null and text is not null")
    names = some.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row for each label
    if not names:
        return EMPTY
    most = max(2, min(PER_LANGUAGE, LEARNED // len(names)))
    # A hash thins each language to a few times the bound; only what is left is ranked.
    thin = spark.createDataFrame([(r["lang"], max(1, r.n // (4 * most))) for r in names], "lang string, thin long")
    chosen = some.join(F.broadcast(thin), "lang").where(F.pmod(F.shiftright("h", 20), F.col("thin")) == 0)
    chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= most)
    rows = sorted((r["lang"], r.k, r.text) for r in chosen.select("lang", "k", "text").toLocalIterator())
    return fitted([(lang, text) for lang, _, text in rows])


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; only the text is looked at."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the n-grams of the landmarks, with a number for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that learning never sees: crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))

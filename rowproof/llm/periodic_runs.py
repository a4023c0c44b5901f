"""Stretches of words that repeat with a period, found word by word.

A run is a stretch of consecutive words whose smallest period is q (words q
apart are equal), of ``max(shortest, 2 * q)`` words or more, that no neighbour
extends keeping the period.  Words q apart match on a diagonal of lag q, so a
run is a diagonal of ``length - q`` matches that ended.

The words are read once, from left to right.  Active diagonals are held by lag,
sparsely: a lag whose word equals the present one grows by a match, any other
ends, and a diagonal that ends with enough matches emits its run at once.  New
lags come from the earlier occurrences of the present word:

* A run has at least half of ``shortest`` matches, so only occurrences that
  agree in that many words (a context) can belong to one; contexts that occur
  once are skipped altogether, and a text without a repeated one has no run.
* Occurrences are kept by the word before the context.  Those behind the same
  word as the present one lie on a diagonal that is active already, or was left
  out for good.
* A lag that cannot repeat twice before the text ends is left out, and so is a
  multiple of an active lag whose stretch begins at the same word: both end at
  the same word, and the smaller lag is the period of both.

Words are compared as such, so the result is exact.  Every text is handled on
its own, whole, in one task; memory is a few numbers for each of its words.  A
text of very few different words in no order has about as many diagonals as
pairs of equal contexts, and takes as long.

Defined results: null and empty texts, and texts of blanks, have no run and an
empty collapsed text; repeated rows and null ids are returned as they came.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Least words of a run.
SHORTEST = 12

#: Odd multiplier of the contexts' rolling keys.
MIX = np.uint64(0x9E3779B97F4A7C15)

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def contexts(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where a context that occurs twice or more begins, and the class of each."""
    n = len(numbers) - size + 1
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = (key ^ (key >> np.uint64(31))) * MIX + numbers[k : k + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.r_[same, False] | np.r_[False, same]
    at, kind = order[twice], np.cumsum(np.r_[False, ~same])[twice]
    back = np.argsort(at)
    return at[back], kind[back]


def runs(words: list[bytes], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, size = len(words), max(1, (shortest + 1) // 2)
    if n < max(shortest, 2):
        return []
    number = Numbers()
    numbers = np.fromiter(map(number.__getitem__, words), np.int64, n)
    if len(number) == n:
        return []
    at, kinds = contexts(numbers, size)
    if not len(at):
        return []
    w = numbers.tolist()
    out: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}  # lag -> the first word that matched the one a lag before
    heads: dict[int, list[int]] = {}  # first word of a stretch -> its active lags
    seen: dict[int, dict[int, list[int]]] = {}  # context -> word before it -> places

    def ended(lag: int, end: int) -> None:
        first = active.pop(lag)
        heads[first - lag].remove(lag)
        if not heads[first - lag]:
            del heads[first - lag]
        if end - first + lag >= max(shortest, 2 * lag):
            out.append((first - lag, end - first + lag, lag))

    last = -2
    for t, kind in zip(at.tolist(), kinds.tolist(), strict=True):
        i = t + size - 1  # the present word, last of the context
        if t != last + 1:
            for lag in list(active):
                ended(lag, last + size)
        else:
            now = w[i]
            for lag in [x for x in active if w[i - x] != now]:
                ended(lag, i)
        last, before, here = t, w[t - 1] if t else -1, seen.setdefault(kind, {})
        for word, places in here.items():
            if word == before:
                continue
            for j in reversed(places):
                lag = t - j
                if lag > n - t:
                    break
                if w[j : j + size] == w[t : t + size] and not any(lag % x == 0 for x in heads.get(j, ())):
                    active[lag] = t
                    heads.setdefault(j, []).append(lag)
        here.setdefault(before, []).append(t)
    for lag in list(active):
        ended(lag, last + size)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by blanks."""
    if not found:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(id, runs array<struct<start, length, period>>, collapsed string) of every row's whole text."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each, texts = [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = text.split() if text else []  # bytes: blanks, tabs and line ends of ASCII only
                found = runs(words, shortest)
                each.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(each, RUNS), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")

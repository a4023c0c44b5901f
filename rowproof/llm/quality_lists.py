"""Quality rules as a learned decision list, in built-in functions only.

Statistics of every whole text are column expressions.  Sequential covering
learns from a bounded sample of labelled rows' statistics (``PER_CLASS`` of each
class): a conjunction of thresholds is grown on one part by information gain,
pruned on the other, kept if it is precise there, and the rows it covers are
taken out before the next is grown.  The list becomes one ordered conditional
expression, so applying it costs no pass and no shuffle of its own.

Defined results: null texts have no words; every ratio over nothing is 0; a
list learned from too little is empty and keeps everything; repeated rows
repeat.  Columns of any name may be there: ``filtered`` returns them untouched,
and ``judged``, whose results have names, refuses a table that has one of these.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Labelled rows of each class that are learned from.
PER_CLASS = 1500
#: Rules at most, conditions of a rule at most, thresholds tried of a statistic,
#: labelled rows that a rule covers at least, and its precision at least.
RULES, CONDITIONS, CUTS, COVER, PRECISION = 12, 4, 24, 5, 0.95

WHITE = r"[\x20\x09-\x0D]"

#: What conditions may be about: name and expression over the statistics' columns.
RATIOS = {
    "words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are computed here, once a row: no later
    filter or projection can pull their expressions into its own."""
    one = F.struct(*[c.alias(name) for name, c in columns.items()])
    (held,) = unused(df, "bound")
    out = df.withColumn(held, F.explode_outer(F.array(one)))
    return out.withColumns({name: F.col(held)[name] for name in columns}).drop(held)


def statistics(df: DataFrame, into: str, text_col: str = "text") -> DataFrame:
    """``df`` with a column ``into``: a struct of the counts of each text."""
    words_, lines_, windows_ = unused(df.select("*", F.lit(0).alias(into)), "words", "lines", "windows")
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, WHITE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = bound(df, **{words_: words, lines_: lines})
    w, lines = F.col(words_), F.col(lines_)
    n = F.size(w)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    base = bound(base, **{windows_: windows})
    h = F.col(windows_)
    # get(transform(array(x), f)) binds x, so it is computed once and not for each element.
    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    said = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    at = lambda s, k: F.when(k >= 0, F.get(s, F.greatest(k, F.lit(0))))

    def twice(s: Column, same) -> Column:
        """Those that are the same as a neighbour."""
        return F.filter(s, lambda x, k: F.coalesce(same(x, at(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)))

    def covered(s: Column) -> Column:
        start = F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(F.sort_array(s), start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    # Windows of a hash that occurs again, then of these the ones whose words (they
    # hold no blank) do: few windows are ever spelt out.
    hashed = lambda s: twice(s, lambda x, y: x["h"] == y["h"])
    spelt = lambda s: twice(s, lambda x, y: (x["h"] == y["h"]) & (x["said"] == y["said"]))
    again = bind(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), hashed)
    again = bind(F.sort_array(F.transform(again, lambda x: F.struct(x["h"].alias("h"), said(x["i"]).alias("said"), x["i"].alias("i")))), spelt)
    repeats = F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(F.transform(again, lambda x: x["i"])))
    stats = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_marks"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
    )
    return bound(base, **{into: stats}).drop(words_, lines_, windows_)


def base_failed(stats: str = "stats") -> Column:
    s = F.col(stats)
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, list(RATIOS).index(self.ratio)]
        return column > self.cut if self.above else column <= self.cut

    def __str__(self) -> str:
        return f"{self.ratio} {'>' if self.above else '<='} {self.cut!r}"

    def sql(self, stats: str) -> str:
        ratio = RATIOS[self.ratio]
        for name in ("n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words"):
            ratio = ratio.replace(name, f"{stats}.{name}") if name in ratio else ratio
        return f"({ratio}) {'>' if self.above else '<='} {self.cut!r}D"


Rule = tuple[Condition, ...]


def hits(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([np.ones(len(x), bool), *(c.holds(x) for c in rule)])


def counts(rule: Rule, x: np.ndarray, bad: np.ndarray, weight: float) -> tuple[float, float]:
    """Bad rows, and weighted good rows, that a rule covers."""
    y = bad[hits(rule, x)]
    return float(y.sum()), float((~y).sum()) * weight


def grow(x: np.ndarray, bad: np.ndarray, weight: float) -> Rule:
    rule: Rule = ()
    while len(rule) < CONDITIONS:
        p, n = counts((), x, bad, weight)
        if not p or not n:
            break
        best: tuple[float, Condition | None] = (1e-9, None)
        for k, ratio in enumerate(RATIOS):
            values = np.unique(x[:, k])
            step = max(1, len(values) // CUTS)
            for cut in sorted({float(values[i] + values[i - 1]) / 2 for i in [*range(1, len(values), step), len(values) - 1] if i}):
                for above in (True, False):
                    c = Condition(ratio, above, cut)
                    p1, n1 = counts((c,), x, bad, weight)
                    if p1:
                        gain = p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p / (p + n)))
                        best = max(best, (gain, c), key=lambda b: b[0])
        if best[1] is None:
            break
        rule = (*rule, best[1])
        hit = best[1].holds(x)
        x, bad = x[hit], bad[hit]
    return rule


def pruned(rule: Rule, x: np.ndarray, bad: np.ndarray, weight: float) -> Rule:
    def worth(r: Rule) -> float:
        p, n = counts(r, x, bad, weight)
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def cover(x: np.ndarray, bad: np.ndarray, weight: float = 1.0) -> list[Rule]:
    """Sequential covering: ordered rules that reject, from ratios (rows by
    ``RATIOS``) and marks of bad rows.  ``weight``: how many rows each good row
    stands for, measured in bad ones.  Every third row prunes."""
    part = [(x[at], bad[at]) for at in (np.arange(len(x)) % 3 != 2, np.arange(len(x)) % 3 == 2)]
    out: list[Rule] = []
    while len(out) < RULES:
        rule = pruned(grow(*part[0], weight), *part[1], weight)
        (q, m), (p, n) = (counts(rule, *half, weight) for half in part)
        if not rule or not p or p + q < COVER or p < PRECISION * (p + n) or q < PRECISION * (q + m):
            break
        out.append(rule)
        part = [(a[~hits(rule, a)], b[~hits(rule, a)]) for a, b in part]
    return out


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Learn from labelled rows that pass the base rules."""
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    total = {r.y: r.n for r in some.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(total) != {0, 1}:
        return []
    chosen = [some.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS) for y in (0, 1)]
    # Both sides are limited above, so what is broadcast has a bound.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "id")
    ratios = [F.expr(Condition(r, True, 0.0).sql("stats").rsplit(" > ", 1)[0]).alias(r) for r in RATIOS]
    found = statistics(texts, "stats").where(~base_failed()).select("id", "y", *ratios).orderBy(F.xxhash64("id"), "id", *RATIOS).limit(4 * PER_CLASS).collect()
    x = np.array([[float(r[k]) for k in RATIOS] for r in found]).reshape(-1, len(RATIOS))
    bad = np.array([r.y == 0 for r in found], bool)
    if not bad.any() or bad.all():
        return []
    share = min(PER_CLASS, total[1]) / total[1] / (min(PER_CLASS, total[0]) / total[0])
    return cover(x, bad, 1 / share)


def verdict(rules: list[Rule], stats: str = "stats") -> Column:
    """Number of the first rule that rejects a row, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(F.expr(" and ".join(c.sql(stats) for c in rules[k - 1])), F.lit(k)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule], text_col: str = "text", into: tuple[str, str, str, str] = ("stats", "failed", "rule", "kept")) -> DataFrame:
    """``docs`` with four columns, named by ``into``: the counts, whether a base rule
    fails, the first rule of the list that rejects, and whether the row is kept."""
    stats, failed, rule, kept = into
    if {c.lower() for c in into} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column among {into}")
    out = statistics(docs, stats, text_col).withColumns({failed: base_failed(stats), rule: verdict(rules, stats)})
    return out.withColumn(kept, ~F.col(failed) & F.col(rule).isNull())


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep, columns unchanged."""
    into = tuple(unused(docs, "stats", "failed", "rule", "kept"))
    out = judged(docs, learned(docs, labels, id_col, text_col), text_col, into)
    return out.where(F.col(into[3])).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Operators over the ordered rows of a page.

All take the page's keys, the position column (a total order within a page) and
the column they work on, and use one window specification, so a plan that
chains them shuffles once by page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowproof.functions.scalars import once


def positioned(df: DataFrame, page: list[str], order: list, name: str = "pos") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*page).orderBy(*order)).cast("long"))


def ditto_value(page: list[str], pos: str, column: str, is_ditto: Column) -> Column:
    """Repeat signs take the value above, also a null one; above the first there is none."""
    above = Window.partitionBy(*page).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    kept = F.when(~is_ditto, F.struct(F.col(column).alias("v")))
    return F.last(kept, ignorenulls=True).over(above)["v"]


def ditto_filled(df: DataFrame, page: list[str], pos: str, column: str, is_ditto: Column) -> DataFrame:
    return df.withColumn(column, ditto_value(page, pos, column, is_ditto))


def carried_value(page: list[str], pos: str, column: str, lo: float, hi: float) -> Column:
    """Values printed without their integer part take that of the last full one
    above; a dropped decimal point is undone where that gives a legal value."""
    v = F.col(column)
    full = F.abs(v).between(lo, hi)
    above = Window.partitionBy(*page).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last(F.when(full, F.floor(F.abs(v))), ignorenulls=True).over(above)
    fraction = F.when(F.abs(v) < 1, v)
    for power in range(1, 7):
        fraction = F.coalesce(fraction, F.when(v / 10**power < 1, v / 10**power))
    restored = F.round(carry + fraction, 4)
    return F.when(full | carry.isNull() | v.isNull(), v).otherwise(once(restored, lambda r: F.when((v < 1) | r.between(lo, hi), r).otherwise(v)))


def carried(df: DataFrame, page: list[str], pos: str, column: str, lo: float, hi: float) -> DataFrame:
    return df.withColumn(column, carried_value(page, pos, column, lo, hi))


def index_filled(df: DataFrame, page: list[str], pos: str, index: str, lo: int, hi: int) -> DataFrame:
    """Illegal indexes are filled if three or more legal ones agree on one offset."""
    w = Window.partitionBy(*page)
    legal = F.col(index).between(lo, hi)
    offset = F.when(legal, F.col(index) - F.col(pos))
    agreed = (F.count(offset).over(w) >= 3) & (F.min(offset).over(w) == F.max(offset).over(w))
    filled = F.col(pos) + F.min(offset).over(w)
    return df.withColumn(index, F.when(F.coalesce(legal, F.lit(False)), F.col(index)).when(agreed & filled.between(lo, hi), filled).otherwise(F.col(index)))


def longest_runs(df: DataFrame, page: list[str], pos: str, index: str) -> DataFrame:
    """Per page the first longest run whose next index is the same or one more:
    page, first_pos, last_pos, n_rows, n_distinct, first_index."""
    w = Window.partitionBy(*page).orderBy(pos)
    before = F.lag(index).over(w)
    breaks = F.coalesce(~(F.col(index) - before).isin(0, 1), F.lit(True))
    runs = df.withColumn("__run", F.sum(breaks.cast("int")).over(w)).where(F.col(index).isNotNull())
    sizes = runs.groupBy(*page, "__run").agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count("*").alias("n_rows"), F.count_distinct(index).alias("n_distinct"), F.min(index).alias("first_index"))
    best = F.max_by(F.struct("first_pos", "last_pos", "n_rows", "n_distinct", "first_index"), F.struct(F.col("n_rows"), -F.col("first_pos")))
    return sizes.groupBy(*page).agg(best.alias("b")).select(*page, "b.*")


def duplicates(df: DataFrame, page: list[str], pos: str, index: str) -> DataFrame:
    """Adds first_pos: where the row's index was first claimed, null if here."""
    first = F.min(pos).over(Window.partitionBy(*page, index))
    return df.withColumn("first_pos", F.when(F.col(index).isNotNull() & (F.col(pos) > first), first))


def in_order(page: list[str], pos: str, index: str) -> Column:
    """Whether a row's index lies between those of its neighbours."""
    w, v = Window.partitionBy(*page).orderBy(pos), F.col(index)
    return F.coalesce(F.lag(index).over(w) < v, F.lit(True)) & F.coalesce(v < F.lead(index).over(w), F.lit(True))


def spurious_duplicates(df: DataFrame, page: list[str], pos: str, index: str, ok: Column | None = None) -> DataFrame:
    """Adds spurious: of two rows that claim an index, the one that breaks the
    order of its neighbours (``ok``, where that is known); both where that cannot be told."""
    same = Window.partitionBy(*page, index).orderBy(pos)
    v = F.col(index)
    out = df.withColumn("__ok", in_order(page, pos, index) if ok is None else ok)
    out = out.withColumns({
        "__first": F.first("__ok").over(same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "__k": F.row_number().over(same),
        "__later": F.max("__ok").over(same.rowsBetween(1, Window.unboundedFollowing)),
    })
    first = F.col("__later").isNotNull() & (~F.col("__ok") | F.col("__later"))
    later = ~F.col("__ok") | F.col("__first")
    flag = F.when(v.isNull(), False).when(F.col("__k") == 1, first).otherwise(later)
    return out.withColumn("spurious", F.coalesce(flag, F.lit(False))).drop("__ok", "__first", "__k", "__later")


def sequence_violations(df: DataFrame, page: list[str], pos: str, index: str) -> DataFrame:
    """Adds off_sequence: the index is not the position, or is claimed twice."""
    n = F.count("*").over(Window.partitionBy(*page, index))
    return df.withColumn("off_sequence", F.coalesce((F.col(index) != F.col(pos)) | (n > 1), F.lit(False)))


def deduped_labels(df: DataFrame, page: list[str], pos: str, label: str, score: str) -> DataFrame:
    """Of consecutive equal labels (nulls skipped) the row of the best score, the first of ties."""
    w = Window.partitionBy(*page).orderBy(pos)
    there = df.where(F.col(label).isNotNull())
    new = F.coalesce(F.lag(label).over(w) != F.col(label), F.lit(True))
    runs = there.withColumn("__run", F.sum(new.cast("int")).over(w))
    return runs.groupBy(*page, "__run").agg(F.max_by(F.struct(pos, label, score), F.struct(F.col(score), -F.col(pos))).alias("b")).select(*page, "b.*")


def label_blocks(df: DataFrame, page: list[str], pos: str, label: str, wanted: list[str]) -> DataFrame:
    """Complete blocks: page, first_pos, last_pos of runs that read exactly ``wanted``."""
    w = Window.partitionBy(*page).orderBy(pos)
    starts = F.sum((F.col(label) == wanted[0]).cast("int")).over(w)
    ends = F.coalesce(F.sum((F.col(label) == wanted[-1]).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = df.withColumn("__b", starts + ends).groupBy(*page, "__b").agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.transform(F.sort_array(F.collect_list(F.struct(pos, label))), lambda x: x[label]).alias("labels"))
    return runs.where(F.col("labels") == F.array(*map(F.lit, wanted))).select(*page, "first_pos", "last_pos")


def trios(df: DataFrame, page: list[str], pos: str, label: str, wanted: tuple[str, str, str]) -> DataFrame:
    """Positions where three rows in a row carry the wanted labels."""
    w = Window.partitionBy(*page).orderBy(pos)
    hit = (F.col(label) == wanted[0]) & (F.lead(label, 1).over(w) == wanted[1]) & (F.lead(label, 2).over(w) == wanted[2])
    return df.withColumn("__hit", hit).where("__hit").select(*page, F.col(pos).alias("first_pos"))


def inherited(df: DataFrame, page: list[str], pos: str, column: str) -> DataFrame:
    """An empty heading gives none, a missing one takes the last that could be read."""
    above = Window.partitionBy(*page).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    readable = F.when(F.col(column) != "", F.col(column))
    last = F.last(readable, ignorenulls=True).over(above)
    out = F.when(F.col(column) == "", None).otherwise(last)
    source = F.when(readable.isNotNull(), "printed").when(F.col(column).isNull() & last.isNotNull(), "inherited").otherwise("none")
    return df.withColumns({"resolved": out, "resolved_from": source})


def near_pairs(df: DataFrame, page: list[str], pos: str, columns: list[str], limit: float, least: int = 2) -> DataFrame:
    """Pairs of rows of a page whose common columns (``least`` or more) all differ by
    less than ``limit``.  Joined on the page and on neighbouring cells of the
    first column that both have, so only rows that can be near meet, and once."""
    gaps = F.filter(F.array(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns]), lambda x: x.isNotNull())
    a = df.select(*page, F.col(pos).alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = df.select(*page, F.col(pos).alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])

    def first(k: int) -> DataFrame:
        cell = lambda side: F.floor(F.col(f"{side}_{columns[k]}") / limit)
        there = a.withColumn("__cell", cell("a")).join(b.withColumn("__cell", F.explode(F.array(cell("b") - 1, cell("b"), cell("b") + 1))), [*page, "__cell"])
        for c in columns[:k]:
            there = there.where(F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull())
        return there.where((F.col("a") < F.col("b")) & (F.size(gaps) >= least) & (F.array_max(gaps) < limit)).select(*page, "a", "b")

    return reduce(DataFrame.unionByName, map(first, range(max(1, len(columns) - max(1, least) + 1))))


def preflight(df: DataFrame, page: list[str], pos: str, plausible: Column, rows: int = 3, least: int = 2) -> DataFrame:
    """Per page passes: ``least`` of its first ``rows`` rows are plausible."""
    return df.groupBy(*page).agg((F.count_if((F.col(pos) <= rows) & plausible) >= least).alias("passes"))


def spread(df: DataFrame, page: list[str], pos: str, shares: list[float]) -> DataFrame:
    """The rows of a page at these shares of its length (positions from 1)."""
    n = df.groupBy(*page).agg(F.count("*").alias("__n"))
    at = F.array(*[F.floor(F.col("__n") * F.lit(s)) for s in shares])
    return df.join(n, page).where(F.array_contains(at, (F.col(pos) - 1).cast("long"))).drop("__n")


def plausible(index: Column, lo: float, hi: float, hard: Column, violations: Column, collapsed: Column, numbers: list[Column]) -> Column:
    """Whether a row can be one of the page's: its index is legal, or, where that can't
    be read, it has no hard problem, nothing outside its range, no repeated
    constant and some number."""
    legal = F.coalesce(index.between(lo, hi), F.lit(False))
    some = F.coalesce(*[F.when(n.isNotNull(), True) for n in numbers], F.lit(False))
    return legal | (~hard & (F.size(violations) == 0) & ~collapsed & some)

"""Scoring, voting and robust comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions.scalars import same_cell

from .series import median


def voted(votes: DataFrame, key: list[str], value: str) -> DataFrame:
    """Strict majority of the votes, null being one; else the median of the others."""
    per = votes.groupBy(*key, value).agg(F.count("*").alias("__n"))
    # The counts are at most as many as distinct votes of a cell, and are reduced per key.
    total = per.groupBy(*key).agg(F.sum("__n").alias("votes"), F.max(F.struct("__n", F.col(value).alias("v"))).alias("top"))
    middle = votes.groupBy(*key).agg(F.median(value).alias("middle"))
    agreed = 2 * F.col("top.__n") > F.col("votes")
    return total.join(middle, key).select(*key, F.when(agreed, F.col("top.v")).otherwise(F.col("middle")).alias("value"), agreed.alias("agreed"), "votes")


def score(gold: DataFrame, read: DataFrame, sheet: list[str], row: list[str], columns: list[str], tolerance: float = 0.05) -> DataFrame:
    """Per sheet: n_cells, cell_acc, structural_err_rate (rows missing or wrong in
    three cells or more)."""
    g = gold.select(*sheet, *row, *[F.col(c).alias(f"g_{c}") for c in columns])
    r = read.select(*sheet, *row, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("__there"))
    right = sum((same_cell(F.col(f"g_{c}"), F.col(f"r_{c}"), tolerance).cast("int") for c in columns), F.lit(0))
    right = F.when(F.col("__there"), right).otherwise(0)
    rows = g.join(r, [*sheet, *row], "left").withColumn("__right", right)
    n = len(columns)
    broken = F.col("__there").isNull() | (n - F.col("__right") >= min(3, n))
    return rows.groupBy(*sheet).agg((F.count("*") * n).alias("n_cells"), (F.sum("__right") / (F.count("*") * n)).alias("cell_acc"), F.avg(broken.cast("double")).alias("structural_err_rate"))


def disagreements(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """Cells (key, column, a, b) of rows in both reads that differ."""
    both = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns]), key)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("double").alias("a"), F.col(f"b_{c}").cast("double").alias("b")) for c in columns])
    out = both.select(*key, F.explode(cells).alias("c")).select(*key, "c.*")
    return out.where(~same_cell(F.col("a"), F.col("b"), tolerance))


def robust_relation(df: DataFrame, stat: Column, limit: float = 6.0) -> DataFrame:
    """Adds centre, mad, z and agrees: distance from the median in median absolute
    deviations.  Both medians are exact and found by ranges, in no single task."""
    rows = df.withColumn("stat", stat)
    rows = rows.crossJoin(F.broadcast(median(rows, "stat", "centre")))  # one row
    mad = median(rows.select(F.abs(F.col("stat") - F.col("centre")).alias("off")), "off", "mad").select(F.greatest("mad", F.lit(1e-9)).alias("mad"))
    out = rows.crossJoin(F.broadcast(mad)).withColumn("z", F.abs(F.col("stat") - F.col("centre")) / F.col("mad"))  # one row
    return out.withColumn("agrees", F.col("z") <= limit)


def aggregate_checks(days: DataFrame, printed: DataFrame, page: list[str], columns: dict[str, str], tolerance: float | dict[str, float] = 0.06, blank_is_zero: bool = False) -> DataFrame:
    """Printed monthly values against the aggregate of the days: page, column,
    computed, printed, passes (null where a day is missing, unless blanks count
    as zero).  The tolerance may differ by column."""
    made = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}
    value = (lambda c: F.coalesce(F.col(c), F.lit(0.0))) if blank_is_zero else F.col
    sums = days.groupBy(*page).agg(*[F.when(F.count(value(c)) == F.count("*"), made[how](value(c))).alias(f"d_{c}") for c, how in columns.items()])
    both = sums.join(printed.select(*page, *[F.col(c).alias(f"p_{c}") for c in columns]), page)
    limit = lambda c: F.lit(float(tolerance.get(c, 0.06) if isinstance(tolerance, dict) else tolerance))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("computed"), F.col(f"p_{c}").alias("printed"), limit(c).alias("limit")) for c in columns])
    out = both.select(*page, F.explode(cells).alias("c")).select(*page, "c.*")
    return out.withColumn("passes", F.abs(F.col("computed") - F.col("printed")) <= F.col("limit")).drop("limit")


def agreement(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], by: list[str], tolerance: float = 0.005) -> DataFrame:
    """Per ``by`` (of the key; none: over all): cells of rows in both reads, and the share that agrees."""
    both = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns]), key)
    same = sum((same_cell(F.col(f"a_{c}"), F.col(f"b_{c}"), tolerance).cast("int") for c in columns), F.lit(0))
    return both.groupBy(*by).agg(F.count("*").alias("n_rows"), (F.count("*") * len(columns)).alias("n_cells"), (F.sum(same) / (F.count("*") * len(columns))).alias("agrees"))


def external_pairs(df: DataFrame, published: DataFrame, key: list[str], value: str, other: str) -> DataFrame:
    """(key, value, other) where both series have a number."""
    numbers = lambda d, c: d.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).select(*key, F.col(c).cast("double").alias(c))
    return numbers(df, value).join(numbers(published, other), key)

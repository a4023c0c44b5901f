"""Series within groups: smoothing, budgets, expectations, fits, and votes over them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, radius: int) -> DataFrame:
    """Adds smooth: the mean of ``value`` over ``radius`` rows on either side; nulls do not count."""
    return df.withColumn("smooth", F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-radius, radius)))


def within_cap(df: DataFrame, keys: list[str], order: list[str], cost: str, cap: float) -> DataFrame:
    """Adds spent, the cost so far with this row, and allowed: whether it stays within ``cap``."""
    spent = F.sum(cost).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("spent", spent).withColumn("allowed", F.coalesce(F.col("spent") <= cap, F.lit(True)))


def consecutive(df: DataFrame, keys: list[str], month: str) -> DataFrame:
    """Adds follows: whether ``month`` (a date) is the month after the group's previous row; null for the first."""
    before = F.lag(month).over(Window.partitionBy(*keys).orderBy(month))
    return df.withColumn("follows", F.add_months(before, 1) == F.col(month))


def fitted_line(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least squares of ``y`` on ``x`` per group; null where ``x`` does not vary."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def values_at(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per group (all rows where there are no keys) the values at given places of
    its values in order, from 0; a place is made of n, the number of values.

    Equal values are counted first.  Distinct ones are dealt by range, so a group
    of any size lies in as many parts as it needs; the parts' counts tell which
    of them holds a place, and only those are ordered."""
    key = F.struct(*keys) if keys else F.lit(0)
    held = df.where(F.col(value).isNotNull()).groupBy(key.alias("__key"), F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    parts = cut(held.repartitionByRange("__key", "__v").withColumn("__part", F.spark_partition_id()))
    of_key = Window.partitionBy("__key")
    sums = parts.groupBy("__key", "__part").agg(F.sum("__n").alias("__s"))
    sums = sums.withColumns({"__all": F.sum("__s").over(of_key), "__to": F.sum("__s").over(of_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0))})
    at = {name: place(F.col("__all")).cast("long") for name, place in places.items()}
    inside = [(x >= F.col("__to") - F.col("__s")) & (x < F.col("__to")) for x in at.values()]
    near = parts.join(sums.where(reduce(lambda a, b: a | b, inside)), ["__key", "__part"])
    upto = F.col("__to") - F.col("__s") + F.sum("__n").over(Window.partitionBy("__key", "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("__upto", upto)
    out = near.groupBy("__key").agg(*[F.min(F.when((F.col("__upto") > x) & (F.col("__upto") - F.col("__n") <= x), F.col("__v"))).alias(name) for name, x in at.items()], F.first("__all").alias("n"))
    return out.select(*[F.col("__key")[k].alias(k) for k in keys], *places, "n")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the place of each row among those of its key, from 1.  Rows are dealt by
    ranges of key and order and numbered behind the counts of the ranges before,
    so a key of any size is no task's alone."""
    parts = cut(df.withColumn("__key", F.struct(*keys)).repartitionByRange("__key", *order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__key", "__part").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__key", "__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__key", "__part").orderBy(*order))
    out = parts.withColumn("__within", within).join(counts, ["__key", "__part"])
    return out.withColumn(name, F.col("__before") + F.col("__within")).drop("__key", "__part", "__before", "__within")


def value_at_share(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Per group the value at index min(n - 1, int(share * n)) of its values in order, from 0."""
    return values_at(df, keys, value, {"value": lambda n: F.least(n - 1, F.floor(F.lit(share) * n))})


def median(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row: the exact median of a column; none without values."""
    ends = values_at(df, [], value, {"__low": lambda n: F.floor((n - 1) / 2), "__high": lambda n: F.floor(n / 2)})
    return ends.select(((F.col("__low") + F.col("__high")) / 2).alias(name))


def modal_count(df: DataFrame, keys: list[str], count: Column, known: list[int], low: int, high: int) -> DataFrame:
    """Per group the most frequent ``count`` -- within [low, high] if any row is, and
    one of ``known`` if any of those is; ties to the smallest."""
    votes = df.groupBy(*keys, count.alias("__c")).agg(F.count("*").alias("__n"))
    c = F.col("__c")
    rank = F.struct(c.between(low, high), c.between(low, high) & c.isin(known), F.col("__n"), -c)
    return votes.groupBy(*keys).agg(F.max_by(c, rank).alias("cells"), F.max_by("__n", rank).alias("votes"))


def oversampled(df: DataFrame, keys: list[str], order: list[Column], rows: int, times: int) -> DataFrame:
    """The first ``rows`` rows of each group, each ``times`` times, numbered in copy."""
    first = df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= rows)
    return first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__k")


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last judgement of each key in an append-only log; combined before it is shuffled."""
    last = F.max(F.struct(*order, *[v for v in values if v not in order])).alias("__last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col("__last")[v].alias(v) for v in values])


def reconciled(df: DataFrame, keys: list[str], order: list[str], month: str, years: list[int]) -> DataFrame:
    """Adds reconciled and flagged: sheets follow one another by a month, so each
    is the first one's month and its place; those read otherwise are flagged.
    The first has nothing to be held against but the years that are known."""
    w = Window.partitionBy(*keys).orderBy(*order)
    place, first = F.row_number().over(w), F.first(month).over(w)
    out = df.withColumn("__place", place).withColumn("reconciled", F.add_months(first, F.col("__place") - 1))
    odd = F.when(F.col("__place") == 1, ~F.year(month).isin(years)).otherwise(F.col(month) != F.col("reconciled"))
    return out.withColumn("flagged", F.coalesce(odd, F.lit(True))).drop("__place")

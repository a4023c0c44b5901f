"""Blocks of a few rows and their printed total: judged as a whole, and the
tolerances that their arithmetic bears out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowproof.functions import scalars
from rowproof.layout import Layout
from rowproof.operators import publish, series
from rowproof.operators.rejudge import totals_broken

#: Rows that are nearer than this in every column both have were one printed row.
NEAR = 0.5


def rejudged_blocks(df: DataFrame, block: list[str], label: str, total: str, columns: list[str], layout: Layout, barometer: str, altitude: str, tolerance: float = 25.0, near: float = NEAR) -> DataFrame:
    """``df`` with its barometer restored, problems and flagged.

    A reading whose hundreds are left out gets those that the altitude allows, or is
    a problem.  A block of three rows or more whose total (the row labelled
    ``total``) isn't theirs says so in all of its rows, as nobody can tell which
    one holds the error.  Two rows of a block that are near in every column both
    have (two or more) were read off one printed row.  All by block: one shuffle."""
    whole = Window.partitionBy(*block)
    restored = publish.altitude_restored(F.col(barometer), F.col(altitude))
    out = df.withColumn("__baro", restored).withColumns({barometer: F.col("__baro.value"), "__elided": F.col("__baro.failed")})
    is_total = F.coalesce(F.col(label) == total, F.lit(False))
    out = out.withColumn("__totals", totals_broken(layout, block, label, ~is_total, is_total, {c: F.col(c) for c in columns}))
    out = out.withColumn("__three", F.count_if(~is_total).over(whole) >= 3)
    broken = F.when(F.col("__three") & (F.size("__totals") > 0), F.concat(F.lit("block_arithmetic: "), F.get("__totals", F.lit(0))))
    values = F.array(*[F.col(c).cast("double") for c in columns])
    out = out.withColumn("__values", values)
    others = F.collect_list(F.when(~is_total, F.struct(F.col(label).alias("label"), F.col("__values").alias("v")))).over(whole)

    def same(o: Column) -> Column:
        gaps = F.filter(F.zip_with(o["v"], F.col("__values"), lambda a, b: F.abs(a - b)), lambda g: g.isNotNull())
        return (o["label"] != F.col(label)) & (F.size(gaps) >= 2) & (F.array_max(gaps) < near)

    out = out.withColumn("__near", ~is_total & F.exists(others, lambda o: F.coalesce(same(o), F.lit(False))))
    problems = F.array_compact(F.array(
        F.when(F.col("__elided"), F.lit("elided_without_one_value")), broken,
        F.when(scalars.implausible_pressure(F.col(barometer), F.col(altitude), tolerance), F.lit("pressure_implausible")), F.when(F.col("__near"), F.lit("near_duplicate_row")),
    ))
    out = out.withColumn("problems", problems)
    return out.withColumn("flagged", F.size("problems") > 0).drop("__baro", "__elided", "__totals", "__three", "__values", "__near")


def calibrated(df: DataFrame, block: list[str], label: str, labels: list[str], total: str, columns: list[str], sound: Column, ordered: Column, share: float = 0.9, factor: float = 1.5, least: float = 0.05) -> DataFrame:
    """(column, n, middle, at_share, most, tolerance): how far printed totals lie from the
    mean of their rows, over blocks that are complete, whose rows are all ``sound``
    and whose total row is ``ordered``; the tolerance that admits a share of them."""
    of = lambda x, c: F.max(F.when(F.col(label) == x, F.col(c)))
    there = [F.max(F.when(F.col(label) == x, True)).alias(f"__t{i}") for i, x in enumerate([*labels, total])]
    sums = df.groupBy(*block).agg(
        F.min(F.coalesce(sound, F.lit(False))).alias("__sound"), F.max(F.when(F.col(label) == total, ordered)).alias("__ordered"), *there,
        *[(F.abs(of(total, c) - sum((of(x, c) for x in labels[1:]), of(labels[0], c)) / len(labels))).alias(c) for c in columns],
    )
    good = sums.where(F.col("__sound") & F.col("__ordered") & sum((F.col(f"__t{i}").isNotNull().cast("int") for i in range(len(labels) + 1)), F.lit(0)).eqNullSafe(len(labels) + 1))
    long = good.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("off")) for c in columns])).alias("d")).select("d.*")
    at = series.values_at(long, ["column"], "off", {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "at_share": lambda n: F.least(n - 1, F.floor(F.lit(share) * n)), "most": lambda n: n - 1})
    return at.select("column", "n", ((F.col("low") + F.col("high")) / 2).alias("middle"), "at_share", "most", F.round(F.greatest(F.lit(least), F.col("at_share") * factor), 2).alias("tolerance"))

"""Reports over judged pages: what to do next, what is worst, what passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import numbered


def worklist(assigned: DataFrame, produced: DataFrame, page: list[str], order: list[str], period: str) -> DataFrame:
    """Pages to produce: of several assignments the last in ``order`` holds; those
    without a period, and those produced already, are left out."""
    rest = [c for c in assigned.columns if c not in page]
    last = assigned.groupBy(*page).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("__last"))
    out = last.select(*page, *[F.col("__last")[c].alias(c) for c in rest]).where(F.coalesce(F.col(period), F.lit("")) != "")
    return out.join(produced.select(*page).distinct(), page, "left_anti")


def worst_cells(classified: DataFrame, n: int) -> DataFrame:
    """The ``n`` columns and shifts that disagree most often (a top-n report; ties by name)."""
    cells = classified.select(F.explode(F.concat("shifts", "changed")).alias("cell"))
    return cells.groupBy("cell").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cell").limit(n)


def benchmark(sheets: DataFrame) -> DataFrame:
    """Over scored sheets: cells and accuracy of all cells, the mean sheet's
    structural errors, and whether every sheet passes."""
    n = F.sum("n_cells")
    passes = (F.col("structural_err_rate") < 0.03) & (F.col("cell_acc") >= 0.95)
    return sheets.agg(
        F.coalesce(n, F.lit(0)).alias("n_cells"), F.coalesce(F.sum(F.col("cell_acc") * F.col("n_cells")) / n, F.lit(1.0)).alias("cell_acc"),
        F.coalesce(F.avg("structural_err_rate"), F.lit(0.0)).alias("structural_err_rate"), F.coalesce(F.bool_and(passes), F.lit(True)).alias("passes"),
    )


def probe(flagged: DataFrame, wrong: DataFrame, key: list[str]) -> DataFrame:
    """How well flags find wrong cells: n_flagged, n_wrong, n_both, recall and precision (null of nothing)."""
    both = flagged.select(*key).distinct().withColumn("__f", F.lit(1)).join(wrong.select(*key).distinct().withColumn("__w", F.lit(1)), key, "full_outer")
    out = both.agg(F.count("__f").alias("n_flagged"), F.count("__w").alias("n_wrong"), F.count_if(F.col("__f").isNotNull() & F.col("__w").isNotNull()).alias("n_both"))
    share = lambda of: F.when(F.col(of) > 0, F.col("n_both") / F.col(of))
    return out.withColumns({"recall": share("n_wrong"), "precision": share("n_flagged")})


def read_often(reads: DataFrame, sheet: list[str], run: str, least: int = 2) -> DataFrame:
    """Reads of the sheets that ``least`` runs or more gave."""
    enough = reads.groupBy(*sheet).agg(F.count_distinct(run).alias("__n")).where(F.col("__n") >= least)
    return reads.join(enough.select(*sheet), sheet, "left_semi")


def filled(df: DataFrame, page: list[str], row: list[str], cells: list[str]) -> DataFrame:
    """How many pages and rows have any cell that is not empty."""
    any_ = F.exists(F.array(*[F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) for c in cells]), lambda x: x)
    rows = df.where(any_).select(*page, *[c for c in row if c not in page]).distinct()
    return rows.agg(F.count_distinct(F.struct(*page)).alias("n_pages"), F.count("*").alias("n_rows"))


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times, numbered in copy; none for zero or null."""
    return df.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int")))))


def training_rows(df: DataFrame, key: list[str], times: Column, excluded: DataFrame, page: list[str], seed: str, most: int | None = None) -> DataFrame:
    """Rows to train on: none of the excluded pages, each ``times`` times, numbered by
    place in an order that the seed shuffles; the first ``most`` of them, if asked.
    Places come by ranges of the order, so no task holds all rows."""
    kept = df.join(excluded.select(*page).distinct(), page, "left_anti")
    copies = repeated(kept, times)
    shuffled = copies.withColumn("__h", F.xxhash64(F.lit(seed), *key, "copy"))
    out = numbered(shuffled.withColumn("__all", F.lit(0)), ["__all"], ["__h", *key, "copy"], "place").drop("__h", "__all")
    return out if most is None else out.where(F.col("place") <= most)

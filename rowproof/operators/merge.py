"""Merging, enrichment and replacement of reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(sources: list[DataFrame], key: list[str], order: list) -> DataFrame:
    """Union of sources; of rows with one key that of the earliest source, then of the order, stays."""
    tagged = [s.withColumn("__src", F.lit(i)) for i, s in enumerate(sources)]
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    first = F.row_number().over(Window.partitionBy(*key).orderBy("__src", *order))
    return all_.withColumn("__k", first).where("__k = 1").drop("__k", "__src")


def enriched(rows: DataFrame, registry: DataFrame, key: list[str], value: str, source: str, keeps: Column, order: list[str] | None = None) -> DataFrame:
    """Rows take ``value`` and ``source`` of the registry, unless they keep their
    own or the registry's is empty.  Of a key's entries the last in ``order``
    (else the greatest) holds, so rows never multiply."""
    last = registry.groupBy(*key).agg(F.max(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order or [])], F.col(value).alias("__v"), F.col(source).alias("__s"))).alias("__last"))
    new = last.select(*key, "__last.__v", "__last.__s")
    take = ~F.coalesce(keeps, F.lit(False)) & F.col("__v").isNotNull() & (F.col("__v") != "")
    out = rows.join(new, key, "left").withColumn("touched", F.coalesce(take, F.lit(False)))
    return out.withColumns({value: F.when(F.col("touched"), F.col("__v")).otherwise(F.col(value)), source: F.when(F.col("touched"), F.col("__s")).otherwise(F.col(source))}).drop("__v", "__s")


def not_produced(candidates: DataFrame, produced: DataFrame, key: list[str]) -> DataFrame:
    return candidates.join(produced.select(*key), key, "left_anti")


def replaced_pages(old: DataFrame, new: DataFrame, page: list[str], index: str) -> DataFrame:
    """Per page of the new read whether it replaces the old one: it covers more
    distinct days (1 to 31), or as many (some) with fewer rows for each."""
    def covered(df: DataFrame, tag: str) -> DataFrame:
        day = F.when(F.col(index).between(1, 31), F.col(index))
        return df.groupBy(*page).agg(F.count_distinct(day).alias(f"{tag}_days"), F.count("*").alias(f"{tag}_rows"))

    both = covered(new, "new").join(covered(old, "old"), page, "left")
    nd, od, nr, orr = (F.col(c) for c in ("new_days", "old_days", "new_rows", "old_rows"))
    tie = (nd == od) & (nd > 0) & (nr / nd < orr / od - 1e-9)
    return both.withColumn("decision", F.when(od.isNull(), "unknown").when((nd > od) | tie, "replace").otherwise("keep"))

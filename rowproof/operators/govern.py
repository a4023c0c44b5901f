"""Samples, fingerprints and leakage guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .series import numbered


def stratified_sample(df: DataFrame, stratum: list[str], key: list[str], k: int, seed: str) -> DataFrame:
    """At most k rows of each stratum, chosen by a hash of the key: the same rows every time."""
    h = F.md5(F.concat_ws("/", F.lit(seed), *[F.col(c).cast("string") for c in key]))
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*stratum).orderBy(h, *key))).where(F.col("__k") <= k).drop("__k")


def row_digest(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]), 256)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """n and sha256 of a table, whatever its order: row digests are added up in
    four parts (partial sums, so no task sees more than its rows) and the sums
    are digested."""
    rows = df.select(row_digest(columns).alias("d"))
    part = lambda i: F.sum(F.conv(F.substring("d", 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    sums = rows.agg(F.count("*").alias("n"), *[part(i).alias(f"s{i}") for i in range(4)])
    return sums.select("n", F.sha2(F.concat_ws("|", "n", "s0", "s1", "s2", "s3"), 256).alias("sha256"))


def leaked(train: DataFrame, gold: DataFrame, key: list[str], content: str) -> DataFrame:
    """Training rows that gold knows by key or by content (sha256)."""
    h = lambda c: F.sha2(F.col(c), 256)
    by_key = train.join(gold.select(*key).distinct(), key, "left_semi").select(*key)
    by_content = train.withColumn("__h", h(content)).join(gold.select(h(content).alias("__h")).distinct(), "__h", "left_semi").select(*key)
    return by_key.unionByName(by_content).distinct()


def published_counts(df: DataFrame, verdict: str, is_row: Column, values: list[str]) -> DataFrame:
    """One row: rows, usable ones (checks_pass, qc_clean), and the values there are in
    usable rows that are readings."""
    usable = F.coalesce(F.col(verdict).isin("checks_pass", "qc_clean"), F.lit(False))
    there = sum((F.col(v).isNotNull().cast("long") for v in values), F.lit(0).cast("long"))
    return df.agg(F.count("*").alias("rows"), F.count_if(usable).alias("usable"), F.coalesce(F.sum(F.when(usable & is_row, there)), F.lit(0)).alias("values_usable"))


def ordered_digest(df: DataFrame, order: list[str], line: Column, run: int = 4096) -> DataFrame:
    """(n, sha256) of a table's lines in order: runs of ``run`` lines have a digest each,
    runs of these again, and so on to one, so no task holds more than a run."""
    now = numbered(df.select(*order, line.alias("__d")).withColumn("__all", F.lit(0)), ["__all"], order, "__i")
    now = now.select((F.col("__i") - 1).alias("i"), F.sha2("__d", 256).alias("d"))
    n = left = now.count()
    while left > 1:
        runs = now.groupBy(F.floor(F.col("i") / run).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "d")))["d"].alias("ds"))
        now, left = cut(runs.select("i", F.sha2(F.array_join("ds", ""), 256).alias("d"))), -(-left // run)
    return now.select(F.lit(n).alias("n"), F.col("d").alias("sha256"))

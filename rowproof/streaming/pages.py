"""Pages as streams (an extension): rows of a page arrive in any number of batches,
and a page is judged again whenever one of them brings rows of it.

A batch's rows and its judgements are folders named by its number, written whole.
So a batch that is replayed after a failure replaces what it wrote before, and
nothing is counted twice or lost; a stream that is started again goes on behind
the last batch its checkpoint names.  Only pages that a batch touches are read
and judged again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def step(batch: DataFrame, number: int, store: str, out: str, page: list[str], row: list[str], judge: Callable[[DataFrame], DataFrame]) -> None:
    """Take one batch: keep its rows, and judge all rows of the pages it touches.  Of a
    row (page and ``row``) that came more than once the last batch's holds."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
    held = spark.read.parquet(store).where(F.col("batch") <= number)
    touched = held.where(F.col("batch") == number).select(*page).distinct()
    rows = held.join(touched, page, "left_semi")
    rest = [c for c in held.columns if c not in (*page, *row, "batch")]
    last = rows.groupBy(*page, *row).agg(F.max(F.struct("batch", *rest)).alias("__last"))
    judge(last.select(*page, *row, *[F.col("__last")[c].alias(c) for c in rest])).write.mode("overwrite").parquet(f"{out}/batch={number}")


def judged(stream: DataFrame, store: str, out: str, checkpoint: str, page: list[str], row: list[str], judge: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Run over what is there and stop; started again, it takes what is new."""
    take = lambda batch, number: step(batch, number, store, out, page, row, judge)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, page: list[str]) -> DataFrame:
    """Each page's judgements of the last batch that touched it."""
    every = spark.read.parquet(out)
    last = every.groupBy(*page).agg(F.max("batch").alias("batch"))
    return every.join(last, [*page, "batch"], "left_semi").drop("batch")

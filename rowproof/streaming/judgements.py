"""Judgement logs as streams: an extension, the batch operators are the whole of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def judgements(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """JSON-lines files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def latest(log: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The last judgement of each key; state is one row a key."""
    last = F.max(F.struct(order, *[v for v in values if v != order])).alias("last")
    return log.groupBy(*keys).agg(last).select(*keys, *[F.col("last")[v].alias(v) for v in values])


def counted(log: DataFrame, time: str, verdict: str, window: str, late: str) -> DataFrame:
    """Judgements of each verdict in each window of time; rows later than ``late`` are dropped and their state with them."""
    return log.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), verdict).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), verdict, "n")

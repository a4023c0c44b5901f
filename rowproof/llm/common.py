"""Helpers shared by the training-data operators: tables, written
intermediate tables, bounded Arrow batches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python.  Texts can be long, so
#: the bound on bytes is what keeps a worker's memory flat.
ARROW_ROWS = 2000
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).  Where the session
    names none, a temporary one is set for a local master, as in tests; on a
    cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    and a lost executor costs no recomputation of what came before."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def consecutive(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows of equal ``keys`` (longs or ints) that follow each other, whatever batches cut them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        where = np.stack([b.column(b.schema.get_field_index(k)).to_numpy() for k in keys], 1)
        cut = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for i, j in zip(cut, cut[1:], strict=False):
            part = b.slice(i, j - i)
            if held and any(held[-1].column(held[-1].schema.get_field_index(k))[0] != part.column(part.schema.get_field_index(k))[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer than any column of ``df``, so that none is one."""
    return [f"__rp_{n}" + "_" * max((len(c) for c in df.columns), default=0) for n in names]


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges -> (node, root): root is the smallest node reachable.

    Alternating large-star and small-star contraction.  Minima are aggregated
    before they are joined back, so a node with very many edges costs a skewed
    join at most, which adaptive execution splits.  Every round is written to
    the shared folder.  Nodes without an edge to another node do not appear.
    """
    spark = edges.sparkSession
    now = written(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
    del spark
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())

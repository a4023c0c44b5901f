"""Frozen folders: a table of file digests, and reading that fails where a file
is missing, unknown or changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.operators.govern import fingerprint

#: Files named in an error.
NAMED = 5


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, sha256) of the files in a folder; their bytes are hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def freeze(spark: SparkSession, path: str, manifest: str, pattern: str = "*") -> None:
    digests(spark, path, pattern).write.mode("overwrite").json(manifest)


def differences(frozen: DataFrame, found: DataFrame) -> DataFrame:
    """(name, problem): files not in the manifest, not in the folder, or changed."""
    both = frozen.select("name", F.col("sha256").alias("__a")).join(found.select("name", F.col("sha256").alias("__b")), "name", "full_outer")
    problem = F.when(F.col("__a").isNull(), "not in the manifest").when(F.col("__b").isNull(), "missing").when(F.col("__a") != F.col("__b"), "changed")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def read_frozen(spark: SparkSession, path: str, manifest: str, schema: str, pattern: str = "*") -> DataFrame:
    """The folder's JSON documents, once every file is what the manifest says."""
    frozen = spark.read.schema("name string, sha256 string").json(manifest)
    bad = differences(frozen, digests(spark, path, pattern)).orderBy("name").limit(NAMED).collect()
    if bad:
        raise ValueError("; ".join(f"{r.name}: {r.problem}" for r in bad))
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).json(path)


def write_version(df: DataFrame, columns: list[str], version: str, path: str) -> None:
    """Declare the table's present state published: its rows and digest under a version."""
    fingerprint(df, columns).select(F.lit(version).alias("version"), F.current_timestamp().alias("frozen_at"), "n", "sha256").write.mode("overwrite").json(path)


def version_problems(df: DataFrame, columns: list[str], path: str) -> DataFrame:
    """(problem): no row while the table is what was published."""
    was = df.sparkSession.read.schema("version string, n long, sha256 string").json(path)
    now = fingerprint(df, columns).select(F.col("n").alias("rows"), F.col("sha256").alias("digest"))  # one row
    said = F.format_string("changed since %s was frozen (%d rows then, %d now; sha256 %s -> %s)", "version", "n", "rows", F.substr("sha256", F.lit(1), F.lit(12)), F.substr("digest", F.lit(1), F.lit(12)))
    return was.crossJoin(F.broadcast(now)).where("sha256 <> digest").select(said.alias("problem"))


def write_training(entries: DataFrame, path: str, page: list[str], row: str, cells: list[str]) -> None:
    """A training manifest as JSON lines, one document a page (so it may be of any size):
    the page, n_examples, n_cells, and its examples in order of their rows."""
    rest = [c for c in entries.columns if c not in (*page, row)]
    n = sum((F.col(c).isNotNull().cast("long") for c in cells), F.lit(0).cast("long"))
    nested = F.sort_array(F.collect_list(F.struct(row, *rest))).alias("examples")
    entries.groupBy(*page).agg(F.count("*").alias("n_examples"), F.sum(n).alias("n_cells"), nested).write.mode("overwrite").json(path)


def read_training(spark: SparkSession, path: str, page: str, example: str) -> DataFrame:
    """The examples of a training manifest, each with its page; schema strings of both."""
    keys = [c.split()[0] for c in page.split(",")]
    return spark.read.schema(f"{page}, examples array<struct<{example}>>").json(path).select(*keys, F.explode("examples").alias("e")).select(*keys, "e.*")

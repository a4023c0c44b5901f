"""Sources and sinks: JSON lines, documents with a list of pages, yearly tables
with banner lines, append-only logs, and text files of one series each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MONTHS = 12


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON-lines files, blank lines skipped; the schema is declared, never inferred."""
    return spark.read.schema(schema).json(path)


def read_listed(spark: SparkSession, glob: str, schema: StructType | str) -> DataFrame:
    """Rows of all JSON-lines files of a pattern, with file (its path) and place, by
    which they stand in it; ``publish.first_file_wins`` decides between them."""
    rows = spark.read.schema(schema).json(glob)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))  # rows of a block come in order
    return rows.withColumns({"file": F.col("_metadata.file_path"), "place": place})


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_pages(spark: SparkSession, path: str, page: str) -> DataFrame:
    """Pages (a schema string) of JSON documents that have them under ``pages``."""
    return spark.read.schema(f"pages array<struct<{page}>>").option("multiLine", True).json(path).select(F.explode("pages").alias("p")).select("p.*")


def read_worklist(spark: SparkSession, path: str, page: str) -> DataFrame:
    """Pages of JSON documents of any of the three forms: a list under ``pages``, a bare
    list, or lists by key, which are put together."""
    text = spark.read.text(path, wholetext=True)
    v = F.col("value")
    listed = F.from_json(v, f"pages array<struct<{page}>>")["pages"]
    bare = F.when(F.ltrim(v).startswith("["), F.from_json(v, f"array<struct<{page}>>"))
    by_key = F.flatten(F.map_values(F.from_json(v, f"map<string,array<struct<{page}>>>")))
    return text.select(F.explode(F.coalesce(bare, listed, by_key)).alias("p")).select("p.*")


def read_daily(spark: SparkSession, path: str, fields: int = 5, date: int = 2, value: int = 3, missing: int = -9999) -> DataFrame:
    """(date, value) of comma files of daily values in tenths: lines of fewer fields or
    without a date are banners, and a sentinel is no value."""
    cells = F.transform(F.split("value", ","), lambda x: F.trim(x))
    lines = spark.read.text(path).select(cells.alias("c")).where((F.size("c") >= fields) & F.get("c", F.lit(date)).rlike("^[0-9]{8}$"))
    v = F.get("c", F.lit(value)).try_cast("int")
    return lines.select(F.try_to_date(F.get("c", F.lit(date)), "yyyyMMdd").alias("date"), F.when(v != missing, v / 10).alias("value"))


def write_with_summary(df: DataFrame, path: str, summary: DataFrame) -> None:
    """JSON lines, and beside them (``.summary``) a summary of few rows: the committer
    puts either in place whole, the rows first."""
    df.write.mode("overwrite").json(path)
    summary.coalesce(1).write.mode("overwrite").json(f"{path}.summary")


def read_yearly(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """(year, month, value) of comma files with a year and twelve months a line.
    Lines that start with no year in the range are banners; cells that are not
    numbers are left out."""
    cells = F.transform(F.split("value", ","), lambda x: F.trim(x))  # trim takes a second argument, which transform would fill
    lines = spark.read.text(path).select(cells.alias("c")).where(F.get("c", F.lit(0)).rlike("^[0-9]{1,9}$"))
    long = lines.select(F.get("c", F.lit(0)).try_cast("int").alias("year"), F.posexplode(F.slice("c", 2, MONTHS)).alias("k", "cell"))
    return long.where(F.col("year").between(first, last)).select("year", (F.col("k") + 1).alias("month"), F.col("cell").try_cast("double").alias("value")).where("value is not null")


def write_series(df: DataFrame, path: str, keys: list[str], order: list[str], line: Column) -> None:
    """One folder for each key's lines, in order of its files' names: lines are dealt by
    ranges of key and order, so a long series is several files and no task's alone."""
    lines = df.select(*keys, *order, line.alias("__line"))
    lines.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*keys, "__line").write.mode("overwrite").partitionBy(*keys).text(path)

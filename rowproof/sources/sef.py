"""Station exchange files: twelve header lines, a line of column names, and a
line an observation, one file a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.operators.series import numbered

from .files import write_series

# The format's version, its header fields and its columns.
VERSION = "1.0.0"
HEADER = ("SEF", "ID", "Name", "Lat", "Lon", "Alt", "Source", "Link", "Vbl", "Stat", "Units", "Meta")
COLUMNS = ("Year", "Month", "Day", "Hour", "Minute", "Period", "Value", "Meta")


def cell(value: Column, kind: str = "string") -> Column:
    """Absence is ``NA``; a whole number has no decimals."""
    text = value.cast("string")
    if kind in ("double", "float"):
        text = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(text)
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("NA"))


def lines(df: DataFrame, series: list[str], order: list[str], header: dict[str, Column]) -> DataFrame:
    """(series, line_no, line) of rows with year .. value and meta.  ``header`` has
    expressions over the series' columns; fields that it lacks are ``NA``."""
    heads = df.select(*series).distinct()
    kinds = dict(heads.select(*[c.alias(k) for k, c in header.items()]).dtypes)
    first = [F.concat(F.lit(f"{k}\t"), F.lit(VERSION) if k == "SEF" else cell(header.get(k, F.lit(None)), kinds.get(k, "string"))) for k in HEADER]
    heads = heads.select(*series, F.posexplode(F.array(*first, F.lit("\t".join(COLUMNS)))).alias("line_no", "line"))
    kinds = dict(df.dtypes)
    cells = [cell(F.col(c.lower()), kinds[c.lower()]) for c in COLUMNS[:-1]]
    body = numbered(df, series, order, "__place").select(*series, (F.col("__place") + len(HEADER)).alias("line_no"), F.concat_ws("\t", *cells, F.coalesce("meta", F.lit(""))).alias("line"))
    return heads.withColumn("line_no", F.col("line_no").cast("long")).unionByName(body)


def write(df: DataFrame, path: str, series: list[str], order: list[str], header: dict[str, Column]) -> None:
    write_series(lines(df, series, order, header), path, series, ["line_no"], F.col("line"))

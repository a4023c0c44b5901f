"""Registered queries of the series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.operators import series

from .queries import EVENTS, events, query, table


@query(f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM ({EVENTS})")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.smoothed(events(spark, sf_dir), ["user_id"], ["pos"], "value", 2).select("event_id", F.round("smooth", 6).alias("smooth"))


COST = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query(f"""
SELECT o_orderkey, CAST(spent AS BIGINT) AS spent, spent <= 50000000 AS allowed
FROM (SELECT o_orderkey, sum({COST}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, {COST} ROWS UNBOUNDED PRECEDING) AS spent FROM orders)
""")
def cost_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return series.within_cap(df, ["o_custkey"], ["o_orderdate", "o_orderkey", "cents"], "cents", 50_000_000).select("o_orderkey", "spent", "allowed")


@query("""
WITH m AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)
SELECT o_custkey, month, CAST(lag(month) OVER (PARTITION BY o_custkey ORDER BY month) + INTERVAL 1 MONTH AS DATE) = month AS follows FROM m
""")
def period_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("month")).distinct()
    return series.consecutive(m, ["o_custkey"], "month")


@query(f"SELECT user_id, round(regr_slope(value, pos), 6) AS slope, round(regr_intercept(value, pos), 6) AS intercept FROM ({EVENTS}) GROUP BY user_id")
def line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = series.fitted_line(events(spark, sf_dir), ["user_id"], "pos", "value")
    return fit.select("user_id", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("""
SELECT event_type, v[CAST(least(len(v) - 1, floor(0.9 * len(v))) AS BIGINT) + 1] AS value, CAST(len(v) AS BIGINT) AS n
FROM (SELECT event_type, list(value ORDER BY value) FILTER (value IS NOT NULL) AS v FROM events GROUP BY 1)
""")
def tolerance_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.value_at_share(table(spark, sf_dir, "events"), ["event_type"], "value", 0.9)


@query("""
WITH c AS (SELECT conv_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS c, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY ALL)
SELECT conv_id, c AS cells, n AS votes FROM c
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY c BETWEEN 5 AND 40 DESC, c BETWEEN 5 AND 40 AND c IN (9, 12, 14, 16) DESC, n DESC, c) = 1
""")
def cell_count_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").where("text is not null")
    return series.modal_count(d, ["conv_id"], F.size(F.split("text", " ")).cast("long"), [9, 12, 14, 16], 5, 40)


@query("""
SELECT doc_id, lang, unnest(range(1, 4)) AS copy FROM (
    SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('again/' || doc_id), doc_id) <= 15)
""")
def balanced_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.concat(F.lit("again/"), F.col("doc_id").cast("string")).cast("binary"))
    out = series.oversampled(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], [key, F.col("doc_id")], 15, 3)
    return out.select("doc_id", "lang", F.col("copy").cast("long").alias("copy"))


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query("""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_numbers, max_number FROM (
    SELECT doc_id, t, list_max(list_transform(t, lambda x: TRY_CAST(replace(x, ',', '.') AS DOUBLE))) AS max_number
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '-?[0-9]+(?:[.,][0-9]+)?') AS t FROM documents))
""")
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("-?[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_numbers"), F.array_max(F.transform("t", lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))).alias("max_number"))

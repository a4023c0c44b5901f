"""Registered queries of reports and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.functions import replies
from rowproof.operators import evaluate, reading, reports

from .queries import ORACLES, lines, query, second_read, table
from .reading_queries import CELLS, CLASSIFIED, two_reads


@query("SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def reply_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values among fences, trailing commas, an echoed schema, and prose."""
    k, p = F.col("event_id") % 5, F.col("props")
    reply = F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.regexp_replace(p, "\\}$", ",}")).when(k == 3, F.concat(F.lit('{"title": "Sheet"}\n'), p, F.lit(" as asked"))).otherwise(F.concat(F.lit("Here: "), p))
    df = table(spark, sf_dir, "events").select("event_id", replies.recovered(reply, "k long", lambda v: v["k"].isNotNull()).alias("v"))
    return df.select("event_id", F.col("v.k").alias("k"))


@query("""
WITH last AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey DESC) = 1)
SELECT o_custkey, o_orderpriority, o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS period FROM last
WHERE o_orderkey % 7 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
""")
def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("period"))
    produced = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return reports.worklist(assigned, produced, ["o_custkey"], ["o_orderpriority", "o_orderkey"], "period")


@query(CLASSIFIED + "SELECT cell, count(*) AS n FROM (SELECT unnest(shifts || changed) AS cell FROM c) GROUP BY 1 ORDER BY n DESC, cell LIMIT 4")
def worst_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.worst_cells(reading.classified(two_reads(spark, sf_dir), CELLS, "a_", "b_"), 4)


@query(f"""
SELECT CAST(sum(n_cells) AS BIGINT) AS n_cells, round(sum(cell_acc * n_cells) / sum(n_cells), 6) AS cell_acc, round(avg(structural_err_rate), 6) AS structural_err_rate,
       bool_and(structural_err_rate < 0.03 AND cell_acc >= 0.95) AS passes FROM ({ORACLES["score_vs_gold"]})
""")
def benchmark_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = lines(spark, sf_dir)
    out = reports.benchmark(evaluate.score(gold, second_read(gold), ["l_orderkey"], ["pos"], ["l_quantity", "l_tax", "l_discount"]))
    return out.select("n_cells", F.round("cell_acc", 6).alias("cell_acc"), F.round("structural_err_rate", 6).alias("structural_err_rate"), "passes")


@query("""
WITH f AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 470), w AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 20 = 0),
n AS (SELECT (SELECT count(*) FROM f) AS n_flagged, (SELECT count(*) FROM w) AS n_wrong, (SELECT count(*) FROM f JOIN w USING (user_id, event_type)) AS n_both)
SELECT *, round(n_both / n_wrong, 9) AS recall, round(n_both / n_flagged, 9) AS precision FROM n
""")
def probe_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    out = reports.probe(e.where("value > 470"), e.where("event_id % 20 = 0"), ["user_id", "event_type"])
    return out.withColumns({c: F.round(c, 9) for c in ("recall", "precision")})


@query("""
SELECT user_id, event_id, event_type FROM events
WHERE (user_id, CAST(ts AS DATE)) IN (SELECT (user_id, CAST(ts AS DATE)) FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING count(DISTINCT event_type) >= 2)
""")
def read_often(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return reports.read_often(e, ["user_id", "day"], "event_type").select("user_id", "event_id", "event_type")


@query("""
SELECT count(DISTINCT conv_id) AS n_pages, count(*) AS n_rows FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE trim(CASE WHEN turn % 3 <> 0 THEN text END) <> '')
""")
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").withColumn("cell", F.when(F.col("turn") % 3 != 0, F.col("text")))
    return reports.filled(df, ["conv_id"], ["turn"], ["cell"])


@query("SELECT p_partkey, CAST(unnest(range(1, p_size % 4 + 1)) AS INT) AS copy FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def training_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a factor of their own, without those that are held out."""
    held = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    df = table(spark, sf_dir, "part").join(held, "p_partkey", "left_anti")
    return reports.repeated(df, F.col("p_size") % 4).select("p_partkey", "copy")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")
def suspects_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderpriority like '1%'").select("o_custkey"))

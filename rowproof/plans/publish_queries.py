"""Registered queries of the way from judged rows to a published dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowproof.functions import parse
from rowproof.layout import Check, Layout, LayoutColumn
from rowproof.operators import checks, evaluate, pages, publish

from .queries import LINE_ORDER, LINES, by_page, lines, query, second_read, spread, table

#: Verdicts as the orders' lines would have them.
VERDICT = "CASE l_returnflag WHEN 'A' THEN 'checks_pass' WHEN 'N' THEN 'qc_clean' ELSE 'flagged' END"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("verdict", F.expr(VERDICT))


@query("""
SELECT o_orderkey, CASE WHEN t THEN 1 ELSE 0 END AS item_is_text, CASE WHEN t THEN 0 ELSE o_custkey END AS item_number, CASE WHEN t THEN 'x' || o_custkey ELSE '' END AS item_text,
       CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 99 WHEN 2 THEN 98 WHEN 3 THEN 12 WHEN 4 THEN -1 ELSE 3 END AS ordinal
FROM (SELECT *, o_custkey % 3 = 0 AS t FROM orders)
""")
def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.expr("CASE WHEN o_custkey % 3 = 0 THEN 'x' || o_custkey ELSE CAST(o_custkey AS STRING) END")
    row = F.expr("CASE o_orderkey % 6 WHEN 0 THEN '1' WHEN 1 THEN ' Mez.' WHEN 2 THEN 'Dec' WHEN 3 THEN '12' WHEN 5 THEN '3' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", *publish.document_order(item), publish.row_ordinal(row).alias("ordinal"))


@query(f"""
SELECT count(DISTINCT (l_orderkey, l_suppkey)) AS pages, count(*) AS rows, count_if(v = 'checks_pass') AS checks_pass, count_if(v = 'qc_clean') AS qc_clean, count_if(v = 'flagged') AS flagged,
       count_if(v <> 'flagged') AS usable,
       CAST(coalesce(sum(CASE WHEN v <> 'flagged' AND l_linenumber < 7 THEN 1 + CAST(l_tax > 0.01 AS INT) + CAST(l_partkey % 5 > 0 AS INT) END), 0) AS BIGINT) AS values_usable
FROM (SELECT *, {VERDICT} AS v FROM lineitem)
""")
def summarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [F.col("l_quantity"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")), F.when(F.col("l_partkey") % 5 > 0, F.col("l_discount"))]
    return publish.summarised(judged(spark, sf_dir), ["l_orderkey", "l_suppkey"], "verdict", values, F.col("l_linenumber") < 7)


#: By layout and column: published variable, statistic, printed unit, hour, period.
MAPPING = [("A", "l_quantity", "p", "point", "mmHg", 7, "p"), ("A", "l_tax", "rr", "sum", "", 24, "day"), ("N", "l_quantity", "ta", "mean", "F", 14, "day"), ("R", "l_discount", "rr", "sum", "in", 24, "day")]


@query(f"""
WITH r AS (SELECT l.*, s_suppkey, {VERDICT} AS v FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey < 20),
c AS (
    SELECT *, 'p' AS vbl, 'point' AS stat, 7 AS hour, 'p' AS period, round(l_quantity * 1.333224, 3) AS value FROM r WHERE l_returnflag = 'A'
    UNION ALL SELECT *, 'rr', 'sum', 24, 'day', CASE WHEN l_partkey % 5 > 0 THEN l_tax END FROM r WHERE l_returnflag = 'A'
    UNION ALL SELECT *, 'ta', 'mean', 14, 'day', round((l_quantity - 32) * 5 / 9, 3) FROM r WHERE l_returnflag = 'N'
    UNION ALL SELECT *, 'rr', 'sum', 24, 'day', round(l_discount * 25.4, 3) FROM r WHERE l_returnflag = 'R'
)
SELECT s_suppkey AS station, vbl, stat, hour, period, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, CAST(day(l_shipdate) AS INT) AS day,
       round(value, 3) AS value, CASE WHEN v = 'flagged' THEN 'uncertain' ELSE '' END AS qc
FROM c WHERE value IS NOT NULL
""")
def station_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).withColumn("l_tax", F.when(F.col("l_partkey") % 5 > 0, F.col("l_tax")))
    stations = table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("station"))
    day = [F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.day("l_shipdate").alias("day")]
    known = publish.at_stations(rows.withColumnRenamed("l_suppkey", "station"), stations, "station").select("station", "l_returnflag", "verdict", *day, "l_quantity", "l_tax", "l_discount")
    out = publish.long_form(known, MAPPING, "l_returnflag", ["station", "year", "month", "day"], "verdict")
    return out.withColumn("value", F.round("value", 3))


@query("SELECT l_suppkey AS station, count(*) AS n_rows FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20) GROUP BY 1")
def stations_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = table(spark, sf_dir, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("station"))
    return publish.unknown_stations(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "station"), stations, "station")


PRICES = Layout("prices", (LayoutColumn("price", elided=True, elided_low=900, elided_high=1000), LayoutColumn("tax", elided=True, elided_low=0, elided_high=250)))


@query("""
SELECT l_orderkey, l_linenumber, round(printed, 4) AS printed, round(CASE WHEN printed < 100 THEN 900 + round(printed, 2) ELSE printed END, 4) AS price, round(l_tax * 1000, 4) AS tax
FROM (SELECT *, CASE WHEN l_extendedprice >= 100 THEN round(l_extendedprice % 100, 4) ELSE l_extendedprice END AS printed FROM lineitem)
""")
def from_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with the hundreds taken away and given back; taxes in a band that
    holds three candidates stay as printed."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_tax") * 1000).alias("tax"))
    printed = publish.to_printed(PRICES, {"price": F.col("l_extendedprice"), "tax": F.col("tax")})
    df = df.withColumn("printed", printed["price"])
    made = publish.from_printed(PRICES, {"price": F.col("printed"), "tax": F.col("tax")})
    return df.select("l_orderkey", "l_linenumber", F.round("printed", 4).alias("printed"), F.round(made["price"], 4).alias("price"), F.round(made["tax"], 4).alias("tax"))


@query("""
WITH c AS (SELECT c_custkey, low, altitude, 760 * exp(-altitude / 8434.0) AS want FROM (
    SELECT c_custkey, round(abs(c_acctbal) % 250, 2) AS low, CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 1500 END AS altitude FROM customer)),
f AS (SELECT *, list_filter(list_transform(range(0, 1000, 100), lambda h: h + CAST(round(low * 100) AS BIGINT) % 10000 / 100.0), lambda x: x >= want - 30 AND x < want + 30) AS fits FROM c)
SELECT c_custkey, round(CASE WHEN low < 200 AND altitude IS NOT NULL AND len(fits) = 1 THEN fits[1] ELSE low END, 2) AS baro, low < 200 AND altitude IS NOT NULL AND len(fits) <> 1 AS failed FROM f
""")
def altitude_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    altitude = F.when(F.col("c_custkey") % 9 > 0, (F.col("c_custkey") % 1500).cast("double"))
    out = table(spark, sf_dir, "customer").select("c_custkey", publish.altitude_restored(F.round(F.abs("c_acctbal") % 250, 2), altitude).alias("r"))
    return out.select("c_custkey", F.round("r.value", 2).alias("baro"), "r.failed")


@query(r"""
WITH r AS (SELECT p_partkey, concat_ws(' | ', CAST(p_size AS VARCHAR), CASE p_partkey % 4 WHEN 0 THEN 'C-K' WHEN 1 THEN 'C, K' WHEN 2 THEN 'NE' ELSE '3' END, CASE WHEN p_partkey % 3 = 0 THEN 'N' ELSE 'Ç' END,
    CASE WHEN p_partkey % 5 = 0 THEN '2' ELSE 's' END) || ' |' AS raw FROM part),
c AS (SELECT *, list_filter(string_split(lower(replace(regexp_replace(raw, '[\s|]+$', ''), ' ', '')), '|'), lambda c: regexp_matches(c, '^[cknspçć]([-,][cknspçć])*$')) AS hits FROM r)
SELECT p_partkey, len(hits) >= 3 AND len(list_filter(hits, lambda c: length(c) > 1)) > 0 AS clouds FROM c
""")
def cloud_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = [F.col("p_size").cast("string"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'C-K' WHEN 1 THEN 'C, K' WHEN 2 THEN 'NE' ELSE '3' END"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'N' ELSE 'Ç' END"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN '2' ELSE 's' END")]
    return table(spark, sf_dir, "part").select("p_partkey", publish.cloud_forms(F.concat(F.concat_ws(" | ", *said), F.lit(" |"))).alias("clouds"))


@query(f"""
WITH p AS ({LINES}), s AS (
    SELECT *, avg(l_quantity) OVER w AS mean_q, max(l_orderkey % 4) OVER w = 0 AS shifted, pos > 1 AND l_linenumber < lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY pos) AS late
    FROM p WINDOW w AS (PARTITION BY l_orderkey)
)
SELECT l_orderkey, CAST(count_if(l_quantity NOT BETWEEN 1 AND 45 OR shifted OR late) AS BIGINT) AS quantity, CAST(count_if(l_tax > l_discount OR late) AS BIGINT) AS tax,
       CAST(count_if(l_discount NOT BETWEEN 0 AND 0.08 OR l_tax > l_discount OR late) AS BIGINT) AS discount
FROM s GROUP BY 1
""")
def sheet_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain cells of each order by column; every fourth order prints a mean
    that is not that of its quantities."""
    df = lines(spark, sf_dir).withColumn("late", F.coalesce(F.col("l_linenumber") < F.lag("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("pos")), F.lit(False)))
    cells = df.select("l_orderkey", "pos", "late", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"l_{c}").alias("value")) for c in ("quantity", "tax", "discount")])).alias("c")).select("l_orderkey", "pos", "late", "c.*")
    totals = df.groupBy("l_orderkey").agg((F.avg("l_quantity") + F.when(F.col("l_orderkey") % 4 == 0, 1.0).otherwise(0.0)).alias("printed")).select("l_orderkey", F.lit("quantity").alias("column"), F.lit("mean").alias("how"), "printed")
    out = publish.sheet_flags(cells, ["l_orderkey"], "pos", "column", "value", {"quantity": (1, 45), "discount": (0, 0.08)}, ("tax", "discount"), totals, "late")
    n = lambda c: F.count_if((F.col("column") == c) & F.col("uncertain")).alias(c)
    return out.groupBy("l_orderkey").agg(*map(n, ("quantity", "tax", "discount")))


@query(f"""
WITH g AS ({LINES}), c AS (
    SELECT l_orderkey, l_partkey % 29 <> 0 AS there, l_partkey % 19 = 0 AS q, l_partkey % 23 <> 0 AS t, l_partkey % 19 = 0 AND abs(l_discount - 0.5) > 0.05 AS d, l_suppkey % 2 = 0 AS doubt FROM g
), w AS (
    SELECT l_orderkey, doubt AND there AS doubt, CAST(NOT there OR q AS INT) AS q, CAST(NOT there OR NOT t AS INT) AS t, CAST(NOT there OR d AS INT) AS d FROM c
)
SELECT l_orderkey, count(*) * 3 AS n_cells, CAST(sum(q + t + d) AS BIGINT) AS n_wrong, CAST(sum(CASE WHEN doubt THEN q + d ELSE 0 END) AS BIGINT) AS n_flagged_wrong,
       round(CASE WHEN sum(q + t + d) > 0 THEN sum(CASE WHEN doubt THEN q + d ELSE 0 END) / sum(q + t + d) ELSE 0 END, 9) AS flagged_recall
FROM w GROUP BY 1
""")
def flagged_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = lines(spark, sf_dir)
    doubt = F.col("l_suppkey") % 2 == 0
    read = second_read(gold).withColumns({"f_l_quantity": doubt, "f_l_tax": F.lit(False), "f_l_discount": doubt})
    out = publish.flagged_recall(gold, read, ["l_orderkey"], ["pos"], ["l_quantity", "l_tax", "l_discount"], "f_")
    return out.withColumn("flagged_recall", F.round("flagged_recall", 9))


@query(f"""
WITH g AS ({LINES}), r AS (SELECT l_orderkey, pos, l_quantity + CAST(l_partkey % 19 = 0 AS INT) AS q, CASE WHEN l_partkey % 23 <> 0 THEN l_tax END AS t, CASE WHEN l_partkey % 19 = 0 THEN 0.5 ELSE l_discount END AS d FROM g WHERE l_partkey % 29 <> 0),
c AS (SELECT abs(g.l_quantity - q) <= 0.005 AS q, coalesce(abs(g.l_tax - t) <= 0.005, FALSE) AS t, abs(g.l_discount - d) <= 0.005 AS d FROM g JOIN r USING (l_orderkey, pos))
SELECT k AS "column", count(*) AS n_cells, round(avg(CAST(s AS INT)), 9) AS agrees FROM (
    SELECT 'l_quantity' AS k, q AS s FROM c UNION ALL SELECT 'l_tax', t FROM c UNION ALL SELECT 'l_discount', d FROM c) GROUP BY 1
""")
def second_read_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = lines(spark, sf_dir)
    out = publish.agreement(gold, second_read(gold), ["l_orderkey", "pos"], ["l_quantity", "l_tax", "l_discount"])
    return out.withColumn("agrees", F.round("agrees", 9))


@query("""
WITH t AS (SELECT l_orderkey, l_partkey % 13 <> 0 AS five, l_partkey % 19 = 0 AS off FROM lineitem)
SELECT l_orderkey, CAST(sum(CASE WHEN five THEN CASE WHEN off THEN 3 ELSE 4 END ELSE 0 END) AS BIGINT) AS correct, 4 * count(*) AS total, count_if(five) AS whole FROM t GROUP BY 1
""")
def token_order_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read as bare numbers; one in thirteen lacks its last token."""
    gold = [F.col(c).cast("double") for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax")]
    said = F.array(gold[0], gold[1] + F.when(F.col("l_partkey") % 19 == 0, 1.0).otherwise(0.0), *gold[2:])
    said = F.when(F.col("l_partkey") % 13 == 0, F.slice(said, 1, 3)).otherwise(said)
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", said.alias("said"), *[g.alias(f"g{i}") for i, g in enumerate(gold)])
    right = publish.token_score(F.col("said"), [F.col(f"g{i}") for i in range(4)])
    return df.groupBy("l_orderkey").agg(F.sum(right).cast("long").alias("correct"), (4 * F.count("*")).alias("total"), F.count_if(F.size("said") == 4).alias("whole"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_totalprice FROM orders)
SELECT k, count(*) AS n, count_if(CASE k WHEN 0 THEN TRUE WHEN 1 THEN abs(round(o_totalprice, 1) - o_totalprice) < 0.005 WHEN 2 THEN TRUE ELSE FALSE END) AS n_same FROM o GROUP BY 1
""")
def text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as text: as printed, rounded, in other letters and blanks, wrong, missing."""
    a = F.when(F.col("k") == 2, F.lit("S. Paulo")).otherwise(F.col("o_totalprice").cast("string"))
    b = F.when(F.col("k") == 0, a).when(F.col("k") == 1, F.round("o_totalprice", 1).cast("string")).when(F.col("k") == 2, F.lit("s.  PAULO ")).when(F.col("k") == 3, F.lit("x"))
    df = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 5)
    return df.select("k", publish.same_text(a, b).alias("same")).groupBy("k").agg(F.count("*").alias("n"), F.count_if("same").alias("n_same"))


@query("""
SELECT c_custkey AS o_custkey, count(o_orderkey) AS n_dropped FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY 1
""")
def dropped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return publish.dropped(table(spark, sf_dir, "orders"), listed, ["o_custkey"])[1]


@query("SELECT count(*) AS n, count_if(o_totalprice < 100000) AS low FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def kept_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    kept = publish.dropped(table(spark, sf_dir, "orders"), listed, ["o_custkey"])[0]
    return kept.agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") < 100000).alias("low"))


@query("""
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, min(event_id) AS first, count(*) AS n FROM events WHERE event_id % 4 > 0 GROUP BY ALL)
SELECT user_id, d, event_type FROM e QUALIFY row_number() OVER (PARTITION BY user_id, d ORDER BY n DESC, first) = 1
""")
def text_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumns({"d": F.to_date("ts"), "event_type": F.when(F.col("event_id") % 4 > 0, F.col("event_type"))})
    return publish.most_common(df, ["user_id", "d"], "event_type", "event_id")


@query(f"""
WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 > 0 THEN l_quantity END AS x FROM ({LINES})),
n AS (SELECT l_orderkey, l_linenumber, x, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT l_orderkey, l_linenumber, CAST(sum(n) AS BIGINT) AS votes, arg_max(n, n) AS top FROM n GROUP BY 1, 2),
a AS (SELECT n.* FROM n JOIN t USING (l_orderkey, l_linenumber) WHERE 2 * n.n > t.votes),
m AS (SELECT l_orderkey, l_linenumber, median(x) AS middle FROM v GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, CASE WHEN a.n IS NOT NULL THEN a.x ELSE middle END AS value, a.n IS NOT NULL AS agreed, votes
FROM t JOIN m USING (l_orderkey, l_linenumber) LEFT JOIN a USING (l_orderkey, l_linenumber)
""")
def table_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that read a line of an order vote on its quantity; a run without it votes null."""
    votes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity")).alias("x"))
    return evaluate.voted(votes, ["l_orderkey", "l_linenumber"], "x")


@query("""
WITH c AS (SELECT user_id, CAST(ts AS DATE) AS d, list(event_id ORDER BY ts, event_id) AS chain FROM events GROUP BY 1, 2)
SELECT user_id, d, k - 1 AS start, chain[k] AS first, chain[k + 2] AS last FROM (SELECT *, unnest(range(1, len(chain) - 1)) AS k FROM c)
""")
def chain_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"), F.struct("ts", "event_id").alias("e"))
    chains = e.groupBy("user_id", "d").agg(F.sort_array(F.collect_list("e"))["event_id"].alias("chain"))
    out = chains.select("user_id", "d", F.posexplode(publish.windows(F.col("chain"), 3)).alias("start", "w"))
    return out.select("user_id", "d", F.col("start").cast("long").alias("start"), F.get("w", F.lit(0)).alias("first"), F.get("w", F.lit(2)).alias("last"))


@query("""
SELECT o_custkey, count(*) AS n, sha256(string_agg(o_custkey || '/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || o_orderkey || '/' || o_orderstatus || chr(10), '' ORDER BY o_orderdate, o_orderkey)) AS digest FROM orders GROUP BY 1
""")
def manifest_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest for each document of a manifest."""
    df = table(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return publish.group_digest(df, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_custkey", "d", "o_orderkey", "o_orderstatus"])


@query("SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1")
def variant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.concat(F.lit("qwen35-lora-"), F.col("p_brand"), F.lit("-epoch2"))).when(k == 1, F.concat(F.lit("qwen35-"), F.col("p_brand"))).when(k == 2, F.concat(F.col("p_brand"), F.lit("-epoch1"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").groupBy(publish.variant_name(said).alias("name")).agg(F.count("*").alias("n"))


CALENDAR = Layout("calendar", (LayoutColumn("day", "day"),), rows_per_page="days_in_month")


@query("""
WITH p AS (SELECT o_custkey % 10 AS page, strftime(o_orderdate, '%Y-%m') AS period, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days FROM orders GROUP BY 1, 2)
SELECT page, period, n_days, CAST(day(last_day(CAST(period || '-01' AS DATE))) AS INT) AS expected, n_days = day(last_day(CAST(period || '-01' AS DATE))) AS complete FROM p
""")
def expected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10).alias("page"), F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(F.count_distinct(F.to_date("o_orderdate")).alias("n_days"))
    want = CALENDAR.expected_rows(F.col("period"))
    return df.select("page", "period", "n_days", want.alias("expected"), (F.col("n_days") == want).alias("complete"))


#: A page of years whose rows come one cell too long, or with a word for a number.
YEARS = Layout("years", (LayoutColumn("year", "day", low=1000, high=2999), LayoutColumn("quantity", low=0, high=60), LayoutColumn("price", low=0, high=1e6), LayoutColumn("flag", "text")), markers=("Gottas",))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, 1000 + l_linenumber AS y, l_quantity AS q, l_extendedprice AS p, l_returnflag AS f, l_partkey % 6 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, y AS year, CASE WHEN k = 4 THEN NULL ELSE q END AS quantity, CASE WHEN k = 5 THEN NULL ELSE p END AS price, f AS flag,
       CASE WHEN k IN (1, 2, 3) THEN 1 ELSE 0 END AS n_soft, CASE WHEN k = 5 THEN 1 ELSE 0 END AS n_hard, CASE WHEN k = 4 THEN 'gott.' END AS marker
FROM r
""")
def resegment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes read as two tokens, spurious leading cells, ruled blanks, printed
    words and unreadable numbers, read back."""
    y, q, p, f = (F.col("l_linenumber") + 1000).cast("string"), F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string"), F.col("l_returnflag")
    k = F.col("l_partkey") % 6
    said = [F.when(k == 1, F.concat(F.substr(y, F.lit(1), F.lit(2)), F.lit(" | "), F.substr(y, F.lit(3)))).when(k == 2, F.concat(F.lit("» | "), y)).otherwise(y), F.when(k == 4, F.lit("gott.")).otherwise(q), F.when(k == 3, F.concat(F.lit("null | "), p)).when(k == 5, F.lit("1?2")).otherwise(p), f]
    df = spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", F.concat_ws(" | ", *said).alias("raw"))
    df = parse.parse_rows(df, YEARS)
    n = lambda keep: F.size(F.filter("parsed.problems", keep))
    c = F.col("parsed.cells")
    return df.select("l_orderkey", "l_linenumber", c["year"]["num"].cast("int").alias("year"), c["quantity"]["num"].alias("quantity"), c["price"]["num"].alias("price"), c["flag"]["txt"].alias("flag"),
                     n(parse.soft).alias("n_soft"), n(lambda x: ~parse.soft(x)).alias("n_hard"), F.col("parsed.markers")["quantity"].alias("marker"))


#: The order's page as the flagship reads it: an index that may be repeated by a sign, a total at the end, hundreds left out.
SHEET = Layout(
    "sheet",
    (LayoutColumn("line", "day"), LayoutColumn("quantity", low=1, high=45), LayoutColumn("price", low=900, high=1000, elided=True, elided_low=900, elided_high=1000), LayoutColumn("discount", low=0, high=0.1), LayoutColumn("tax")),
    (Check("order", "tax", ("zero", "discount")),), markers=("Mez",), summary_words=("Mez",),
)

REJUDGED = f"""
WITH p AS ({LINES}), s AS (
    SELECT *, l_suppkey % 17 = 0 AS total, l_partkey % 13 = 0 AS hard, CAST(round(l_extendedprice * 100) AS BIGINT) % 10000 / 100.0 + 900 AS price,
           pos > 1 AND l_partkey % 5 = 0 AND l_suppkey % 17 <> 0 AS ditto FROM p
), i AS (
    SELECT *, last_value(CASE WHEN ditto THEN NULL ELSE {{'v': CASE WHEN total THEN NULL ELSE l_linenumber END}} END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING).v AS line FROM s
), w AS (
    SELECT *, lag(line) OVER g AS before, lead(line) OVER g AS after FROM i WINDOW g AS (PARTITION BY l_orderkey ORDER BY pos)
), d AS (
    SELECT *, coalesce(before < line, TRUE) AND coalesce(line < after, TRUE) AS ok FROM w
), e AS (
    SELECT *, row_number() OVER g AS k, first_value(ok) OVER g AS first_ok,
           max(ok) OVER (PARTITION BY l_orderkey, line ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later_ok
    FROM d WINDOW g AS (PARTITION BY l_orderkey, line ORDER BY pos)
), f AS (
    SELECT *, line IS NOT NULL AND (CASE WHEN k = 1 THEN later_ok IS NOT NULL AND (NOT ok OR later_ok) ELSE NOT ok OR first_ok END) AS spurious,
           l_quantity > 45 OR l_discount > 0.1 AS outside, l_tax > l_discount + 0.051 AS broken,
           count(DISTINCT line) OVER (PARTITION BY l_orderkey) = max(line) OVER (PARTITION BY l_orderkey) AS complete
    FROM e
)
"""


@query(REJUDGED + """
SELECT CASE WHEN line IS NULL THEN 'flagged' WHEN NOT outside AND NOT broken AND NOT hard AND NOT spurious THEN 'checks_pass' ELSE 'flagged' END AS verdict, line IS NOT NULL AS is_day, coalesce(complete, FALSE) AS complete,
       count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_pages, count_if(ditto) AS n_repeats, count_if(outside) AS n_outside, count_if(broken) AS n_broken, count_if(spurious) AS n_spurious, round(sum(price), 2) AS prices
FROM f GROUP BY 1, 2, 3
""")
def rejudge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole judgement: rows are read as printed, conventions undone (left-out
    hundreds, repeated indexes), and checked by themselves and within their page
    (one shuffle); totals are no days, and an incomplete page doesn't flag its rows."""
    page, k = ["l_orderkey"], F.col("l_partkey")
    df = pages.positioned(by_page(table(spark, sf_dir, "lineitem"), *page), page, LINE_ORDER)
    total, ditto = F.col("l_suppkey") % 17 == 0, (F.col("pos") > 1) & (k % 5 == 0)
    price = F.format_string("%.2f", F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(10_000)) / 100)
    said = [F.when(total, "Mez.").when(ditto, "»").otherwise(F.col("l_linenumber").cast("string")), F.col("l_quantity").cast("string"), price, F.col("l_discount").cast("string"), F.col("l_tax").cast("string")]
    raw = F.concat(F.concat_ws(" | ", *said), F.when(k % 13 == 0, " | 1 | 2").otherwise(""))
    df = parse.parse_rows(df.select("l_orderkey", "pos", raw.alias("raw")), SHEET)
    cells = F.col("parsed.cells")
    v = publish.from_printed(SHEET, {c.key: cells[c.key]["num"] for c in SHEET.columns}) | {"zero": F.lit(0.0)}
    df = df.select(
        *page, "pos", v["line"].cast("int").alias("line"), (cells["line"]["kind"] == "ditto").alias("repeats"), parse.is_summary(F.col("raw"), SHEET.summary_words).alias("total"), v["price"].alias("price"),
        checks.range_violations(SHEET, v).alias("violations"), checks.check_failures(SHEET, v).alias("failures"), checks.scoreable(SHEET, v).alias("scores"), F.exists("parsed.problems", lambda p: ~parse.soft(p)).alias("hard"),
    )
    df = pages.ditto_filled(df, page, "pos", "line", F.col("repeats"))
    df = pages.spurious_duplicates(df, page, "pos", "line")
    whole = Window.partitionBy(*page)
    df = df.withColumn("complete", F.coalesce(F.size(F.collect_set("line").over(whole)) == F.max("line").over(whole), F.lit(False)))
    is_day = ~F.col("total") & F.col("line").isNotNull()
    verdict = checks.verdict(is_day, F.col("scores"), F.col("failures"), F.col("violations"), F.col("hard") | F.col("spurious"))
    n = lambda c, name: F.count_if(c).alias(name)
    return df.groupBy(verdict.alias("verdict"), is_day.alias("is_day"), "complete").agg(
        F.count("*").alias("n_rows"), F.count_distinct("l_orderkey").alias("n_pages"), n(F.col("repeats"), "n_repeats"), n(F.size("violations") > 0, "n_outside"), n(F.size("failures") > 0, "n_broken"), n(F.col("spurious"), "n_spurious"), F.round(F.sum("price"), 2).alias("prices"),
    )


#: Counts that two tables share are told apart by content; compass points contradict all other tables.
LAYOUT_RULES = [(16, "decimal", "actinometry"), (16, "whole", "cloudiness"), (16, "any", None), (15, "clouds", None), (15, "any", "wind"), (13, "wind", "hourly wind"), (None, "wind", None), (13, "any", "thermometer")]


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'actinometry' WHEN 1 THEN 'cloudiness' END
    WHEN p_size % 4 = 1 THEN CASE p_partkey % 3 WHEN 2 THEN NULL ELSE 'wind' END WHEN p_size % 4 = 2 THEN CASE p_partkey % 3 WHEN 0 THEN 'hourly wind' ELSE 'thermometer' END END AS layout FROM part
""")
def layout_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their cells: counts that two tables share are told apart by content."""
    k = F.col("p_partkey") % 3
    cells = F.expr("CASE p_size % 4 WHEN 0 THEN 16 WHEN 1 THEN 15 WHEN 2 THEN 13 ELSE 40 END")
    shared = F.when(k == 0, "1 | 32.0 | 5").when(k == 1, "2 | 5 | C").otherwise("3 | x | y")
    row = F.when(cells == 16, shared).when(cells == 15, F.when(k == 2, "9 | C-K | N | K").otherwise("9 | NE | 3 | SSE | 2 | N")).when(cells == 13, F.when(k == 0, "1 | N | 2 | NE | 3 | S").otherwise("1 | 20.5 | 21"))
    return table(spark, sf_dir, "part").select("p_partkey", publish.assigned_layout(cells, F.array(F.coalesce(row, F.lit("a"))), LAYOUT_RULES).alias("layout"))


@query(f"""
WITH g AS ({LINES}), d AS (SELECT l_orderkey, pos, 'l_quantity' AS "column", l_quantity AS a, l_quantity + 1 AS b, l_suppkey FROM g WHERE l_partkey % 29 <> 0 AND l_partkey % 19 = 0)
SELECT l_orderkey, pos, "column", a, b, CASE l_suppkey % 3 WHEN 0 THEN a WHEN 1 THEN b END AS corrected, CASE l_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS "right" FROM d
""")
def disagreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = lines(spark, sf_dir)
    cells = evaluate.disagreements(gold, second_read(gold), ["l_orderkey", "pos"], ["l_quantity"], 0.005)
    made = gold.where("l_suppkey % 3 < 2").select("l_orderkey", "pos", F.lit("l_quantity").alias("column"), (F.col("l_quantity") + F.col("l_suppkey") % 3).alias("now"))
    return publish.disagreements_explained(cells, made, ["l_orderkey", "pos"], "column")


@query("SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS o_orderkey, min_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM (SELECT * FROM orders) WHERE TRUE GROUP BY 1")
def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a customer in several files: that of the first file holds."""
    df = table(spark, sf_dir, "orders").select("o_custkey", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("file"), F.lit(0).alias("place"), "o_orderkey", "o_orderstatus")
    return publish.first_file_wins(df, ["o_custkey"], "file", "place").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT count_if(NOT h) AS n_learn, count_if(h) AS n_held, count(DISTINCT CASE WHEN h THEN o_custkey END) AS held_pages FROM (SELECT *, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AS h FROM orders)")
def page_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    learn, held = publish.held_out_pages(table(spark, sf_dir, "orders"), some, ["o_custkey"])
    return learn.withColumn("h", F.lit(False)).unionByName(held.withColumn("h", F.lit(True))).agg(F.count_if(~F.col("h")).alias("n_learn"), F.count_if("h").alias("n_held"), F.count_distinct(F.when(F.col("h"), F.col("o_custkey"))).alias("held_pages"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey DESC LIMIT 10")
def worst_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.worst(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 10, [F.desc("c_custkey")])

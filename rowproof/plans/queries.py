"""Registered queries: the operators bound to the driver's tables, each with the
SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowproof.functions import parse, scalars
from rowproof.layout import Check, Layout, LayoutColumn
from rowproof.operators import checks, evaluate, govern, merge, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"]
#: Rows of lineitem with their place within the order, as rows of a page.
LINES = f"SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS pos FROM lineitem"
#: Rows of events with their place within the user.
EVENTS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events"

#: An order printed as a page: one line per item.
ITEM = Layout(
    "order-item",
    (
        LayoutColumn("line", "day", low=1, high=7),
        LayoutColumn("quantity", low=1, high=45),
        LayoutColumn("price"),
        LayoutColumn("discount", low=0, high=0.08),
        LayoutColumn("tax"),
        LayoutColumn("flag", "text"),
    ),
    (Check("atleast", "price", ("quantity",)), Check("order", "tax", ("zero", "discount"))),
)
FIELDS = {"line": "l_linenumber", "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "flag": "l_returnflag"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def by_page(df: DataFrame, *page: str) -> DataFrame:
    """Deal rows by page for windows that costly work follows: the one shuffle they
    need, in parts that are not merged afterwards."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *page)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.positioned(table(spark, sf_dir, "lineitem"), ["l_orderkey"], LINE_ORDER)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.positioned(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])


def printed(df: DataFrame) -> DataFrame:
    """Adds raw: the row as its page would print it, with repeat signs, decimal
    commas and a trailing blank where the keys say so."""
    raw = parse.target(ITEM, {k: F.col(c) for k, c in FIELDS.items()})
    raw = F.when(F.col("l_partkey") % 11 == 0, F.concat(raw, F.lit(" | "))).otherwise(raw)
    raw = F.when(F.col("l_partkey") % 7 == 0, F.replace(raw, F.lit("."), F.lit(","))).otherwise(raw)
    return df.withColumn("raw", F.when(F.col("l_partkey") % 13 == 0, F.concat(raw, F.lit(" | 1 | 2"))).otherwise(raw))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input with fewer parts than there are cores, for work
    that costs more than the shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_back(df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Rows parsed from raw, and their values by layout key."""
    out = parse.parse_rows(df, ITEM)
    cells = F.col("parsed")["cells"]
    values = {c.key: cells[c.key]["txt" if c.kind == "text" else "num"] for c in ITEM.columns}
    return out, values | {"zero": F.lit(0.0)}


#: The printed rows in SQL, and their tokens read again from the text.
PRINTED_SQL = """
WITH said AS (
    SELECT *, concat_ws(' | ', CAST(l_linenumber AS VARCHAR), n(l_quantity), n(l_extendedprice), n(l_discount), n(l_tax), l_returnflag) AS plain FROM lineitem
), printed AS (
    SELECT *, CASE WHEN l_partkey % 7 = 0 THEN replace(a, '.', ',') ELSE a END || CASE WHEN l_partkey % 13 = 0 THEN ' | 1 | 2' ELSE '' END AS raw
    FROM (SELECT *, plain || CASE WHEN l_partkey % 11 = 0 THEN ' | ' ELSE '' END AS a FROM said)
), cut AS (
    SELECT *, list_transform(string_split(raw, '|'), lambda x: replace(trim(x), ',', '.')) AS t FROM printed
)
"""
for _c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
    PRINTED_SQL = PRINTED_SQL.replace(f"n({_c})", f"regexp_replace(regexp_replace(printf('%.2f', {_c}), '0+$', ''), '[.]$', '')")


@query(PRINTED_SQL + """
SELECT l_orderkey, TRY_CAST(t[1] AS INTEGER) AS line, TRY_CAST(t[2] AS DOUBLE) AS quantity, TRY_CAST(t[3] AS DOUBLE) AS price, TRY_CAST(t[4] AS DOUBLE) AS discount,
       TRY_CAST(t[5] AS DOUBLE) AS tax, t[6] AS flag, CASE WHEN len(t) = 6 OR len(t) = 7 AND t[7] = '' THEN 0 ELSE 1 END AS n_problems
FROM cut
""")
def parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, v = read_back(printed(spread(table(spark, sf_dir, "lineitem"))))
    hard = F.size(F.filter(F.col("parsed")["problems"], lambda p: ~parse.soft(p)))
    return df.select("l_orderkey", v["line"].cast("int").alias("line"), *[v[k].alias(k) for k in ("quantity", "price", "discount", "tax", "flag")], hard.alias("n_problems"))


JUDGED = f"""
WITH p AS ({LINES}), s AS (
    SELECT *, l_partkey % 13 = 0 AS hard,
           lag(l_linenumber) OVER w AS before, lead(l_linenumber) OVER w AS after
    FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos)
), d AS (
    SELECT *, coalesce(before < l_linenumber, TRUE) AND coalesce(l_linenumber < after, TRUE) AS in_order FROM s
), e AS (
    SELECT *, row_number() OVER g AS k, first_value(in_order) OVER g AS first_ok,
           max(in_order) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later_ok
    FROM d WINDOW g AS (PARTITION BY l_orderkey, l_linenumber ORDER BY pos)
), f AS (
    SELECT *, CASE WHEN k = 1 THEN coalesce(NOT in_order OR later_ok, FALSE) AND later_ok IS NOT NULL ELSE NOT in_order OR first_ok END AS spurious,
           l_quantity > 45 OR l_discount > 0.08 AS outside,
           l_extendedprice < l_quantity - 0.051 OR l_tax > l_discount + 0.051 AS broken
    FROM e
)
"""


@query(JUDGED + """
SELECT CASE WHEN NOT hard AND NOT outside AND NOT broken AND NOT spurious THEN 'checks_pass' ELSE 'flagged' END AS verdict,
       count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_pages,
       CAST(sum(CAST(outside AS BIGINT)) AS BIGINT) AS n_outside, CAST(sum(CAST(broken AS BIGINT)) AS BIGINT) AS n_broken, CAST(sum(CAST(spurious AS BIGINT)) AS BIGINT) AS n_spurious
FROM f GROUP BY 1
""")
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: print, parse, check, look at the page, decide, count."""
    df = pages.positioned(by_page(table(spark, sf_dir, "lineitem"), "l_orderkey"), ["l_orderkey"], LINE_ORDER)
    df, v = read_back(printed(df))
    df = df.select("l_orderkey", "pos", "l_linenumber", checks.range_violations(ITEM, v).alias("violations"), checks.check_failures(ITEM, v).alias("failures"), checks.scoreable(ITEM, v).alias("scores"), F.exists(F.col("parsed")["problems"], lambda p: ~parse.soft(p)).alias("hard"))
    df = pages.spurious_duplicates(df, ["l_orderkey"], "pos", "l_linenumber")
    verdict = checks.verdict(F.lit(True), F.col("scores"), F.col("failures"), F.col("violations"), F.col("hard") | F.col("spurious"))
    n = lambda c: F.sum(c.cast("long"))
    return df.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n_rows"), F.count_distinct("l_orderkey").alias("n_pages"), n(F.size("violations") > 0).alias("n_outside"), n(F.size("failures") > 0).alias("n_broken"), n(F.col("spurious")).alias("n_spurious"))


@query("""
SELECT k AS key, count(*) AS n, min(x) AS low, max(x) AS high FROM (
    SELECT 'quantity' AS k, l_quantity AS x FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 45
    UNION ALL SELECT 'discount', l_discount FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.08
) GROUP BY k
""")
def range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    v = {k: F.col(c) for k, c in FIELDS.items()}
    out = df.select(F.explode(F.transform(checks.range_violations(ITEM, v), lambda k: F.struct(k.alias("key"), F.when(k == "quantity", v["quantity"]).otherwise(v["discount"]).alias("x")))).alias("v"))
    return out.groupBy("v.key").agg(F.count("*").alias("n"), F.min("v.x").alias("low"), F.max("v.x").alias("high"))


DAILY = """
SELECT *, hi - lo + CASE WHEN user_id % 17 = 0 THEN 1 ELSE 0 END AS swing
FROM (SELECT user_id, CAST(ts AS DATE) AS day, min(value) AS lo, max(value) AS hi, avg(value) AS mid, sum(value) AS total FROM events GROUP BY ALL)
"""


@query(f"""
SELECT user_id, day, lo - 0.051 > mid OR mid > hi + 0.051 AS order_fails, abs(swing - (hi - lo)) > 0.051 AS diff_fails,
       hi < lo - 0.051 AS atleast_fails, abs(total - (lo + hi)) > 0.051 AS sum_fails, abs(mid - (lo + hi) / 2) > 0.051 AS mean_fails
FROM ({DAILY})
""")
def check_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals are added up in the order of the events, however they are dealt: a mean
    that lies at the tolerance is decided by its last bit.  A day without a value has
    no answers."""
    page, order = ["user_id", "day"], ["ts", "event_id", "value"]
    e = pages.positioned(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), page, order)
    e = e.withColumn("total", F.sum("value").over(Window.partitionBy(*page).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    d = e.groupBy(*page).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"), F.max_by("total", "pos").alias("total"))
    d = d.withColumn("mid", F.when(F.col("n") > 0, F.col("total") / F.col("n")))
    d = d.withColumn("swing", F.col("hi") - F.col("lo") + F.when(F.col("user_id") % 17 == 0, 1).otherwise(0))
    v = {k: F.col(k) for k in ("lo", "hi", "mid", "total", "swing")}
    made = {"order": Check("order", "mid", ("lo", "hi")), "diff": Check("diff", "swing", ("hi", "lo")), "atleast": Check("atleast", "hi", ("lo",)), "sum": Check("sum", "total", ("lo", "hi")), "mean": Check("mean", "mid", ("lo", "hi"))}
    return d.select("user_id", "day", *[F.when(F.col("n") > 0, checks.failed(c, v)).alias(f"{k}_fails") for k, c in made.items()])


@query("""
SELECT user_id, day, len(list_filter([a, b, c, d, e], lambda x: x IS NOT NULL)) >= 3 AND len(list_distinct(list_filter([a, b, c, d, e], lambda x: x IS NOT NULL))) <= 2 AS degenerate
FROM (SELECT user_id, CAST(ts AS DATE) AS day,
    max(CASE WHEN event_type = 'click' THEN floor(value / 200) END) AS a, max(CASE WHEN event_type = 'view' THEN floor(value / 200) END) AS b,
    max(CASE WHEN event_type = 'purchase' THEN floor(value / 200) END) AS c, max(CASE WHEN event_type = 'login' THEN floor(value / 200) END) AS d,
    max(CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'login') THEN floor(value / 200) END) AS e FROM events GROUP BY ALL)
""")
def degenerate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "view", "purchase", "login"]
    x = F.floor(F.col("value") / 200)
    cells = [F.max(F.when(F.col("event_type") == k, x)).alias(k) for k in kinds] + [F.max(F.when(~F.col("event_type").isin(kinds), x)).alias("other")]
    wide = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(*cells)
    return wide.select("user_id", "day", checks.degenerate([F.col(k) for k in (*kinds, "other")], 3).alias("degenerate"))


@query("""
WITH d AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(day(ts) AS BIGINT) END AS day FROM events),
b AS (SELECT *, coalesce(day - lag(day) OVER (PARTITION BY user_id ORDER BY pos) NOT IN (0, 1), TRUE) AS brk FROM d),
r AS (SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY user_id ORDER BY pos) AS run FROM b),
g AS (SELECT user_id, run, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_rows, count(DISTINCT day) AS n_distinct, min(day) AS first_index FROM r WHERE day IS NOT NULL GROUP BY ALL)
SELECT user_id, first_pos, last_pos, n_rows, n_distinct, first_index FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n_rows DESC, first_pos) = 1
""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).withColumn("day", F.when(F.col("event_id") % 29 != 0, F.dayofmonth("ts").cast("long")))
    return pages.longest_runs(d, ["user_id"], "pos", "day")


@query(f"SELECT l_orderkey, pos, l_linenumber, CASE WHEN pos > first THEN first END AS first_pos FROM (SELECT *, min(pos) OVER (PARTITION BY l_orderkey, l_linenumber) AS first FROM ({LINES}))")
def duplicate_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.duplicates(lines(spark, sf_dir), ["l_orderkey"], "pos", "l_linenumber").select("l_orderkey", "pos", "l_linenumber", "first_pos")


@query(JUDGED + "SELECT l_orderkey, pos, l_linenumber, spurious FROM f")
def spurious_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.spurious_duplicates(lines(spark, sf_dir), ["l_orderkey"], "pos", "l_linenumber").select("l_orderkey", "pos", "l_linenumber", "spurious")


@query(f"SELECT l_orderkey, pos, l_linenumber, l_linenumber <> pos OR count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS off_sequence FROM ({LINES})")
def day_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.sequence_violations(lines(spark, sf_dir), ["l_orderkey"], "pos", "l_linenumber").select("l_orderkey", "pos", "l_linenumber", "off_sequence")


@query(f"""
SELECT event_id, (last_value(CASE WHEN event_id % 3 <> 1 THEN struct_pack(v := CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END) END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY pos)).v AS event_type FROM ({EVENTS})
""")
def ditto_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).withColumn("event_type", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    return pages.ditto_filled(d, ["user_id"], "pos", "event_type", F.col("event_id") % 3 == 1).select("event_id", "event_type")


@query(f"""
WITH d AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN round(value, 2) ELSE round(value, 2) - floor(value) END AS v FROM ({EVENTS})),
c AS (SELECT *, last_value(CASE WHEN v BETWEEN 1 AND 1000 THEN floor(v) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carry FROM d)
SELECT event_id, round(CASE WHEN v BETWEEN 1 AND 1000 OR carry IS NULL THEN v ELSE carry + v END, 2) AS value FROM c
""")
def column_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.round("value", 2)
    d = events(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 4 == 0, v).otherwise(v - F.floor("value")))
    return pages.carried(d, ["user_id"], "pos", "v", 1, 1000).select("event_id", F.round("v", 2).alias("value"))


@query(f"""
WITH d AS (SELECT l_orderkey, pos, CASE WHEN l_partkey % 5 = 0 THEN 99 ELSE pos + l_orderkey % 3 END AS idx FROM ({LINES})),
o AS (SELECT *, CASE WHEN idx BETWEEN 1 AND 9 THEN idx - pos END AS off FROM d),
a AS (SELECT *, count(off) OVER p >= 3 AND min(off) OVER p = max(off) OVER p AS agreed, min(off) OVER p AS m FROM o WINDOW p AS (PARTITION BY l_orderkey))
SELECT l_orderkey, pos, CAST(CASE WHEN idx BETWEEN 1 AND 9 THEN idx WHEN agreed AND pos + m BETWEEN 1 AND 9 THEN pos + m ELSE idx END AS BIGINT) AS idx FROM a
""")
def index_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir).withColumn("idx", F.when(F.col("l_partkey") % 5 == 0, 99).otherwise(F.col("pos") + F.col("l_orderkey") % 3).cast("long"))
    return pages.index_filled(d, ["l_orderkey"], "pos", "idx", 1, 9).select("l_orderkey", "pos", "idx")


@query("""
WITH d AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) % 10000 AS cents, 700.0 - p_partkey % 3 * 20 AS lo, 800.0 + p_partkey % 2 * 30 AS hi FROM part),
f AS (SELECT *, list_filter(list_transform(range(0, 1000, 100), lambda h: h + cents / 100), lambda c: c >= lo AND c < hi) AS fits FROM d)
SELECT p_partkey, CASE WHEN len(fits) = 1 THEN CAST(fits[1] AS DOUBLE) END AS restored FROM f
""")
def restore_hundreds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k, scalars.restore_hundreds(F.col("p_retailprice"), 700.0 - k % 3 * 20, 800.0 + k % 2 * 30).alias("restored"))


@query("""
SELECT c_custkey, round(760 * exp(-c_acctbal / 8434), 6) AS expected, abs(720 - 760 * exp(-c_acctbal / 8434)) > 25 AS implausible FROM customer
""")
def altitude_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(scalars.pressure_at(a), 6).alias("expected"), scalars.implausible_pressure(F.lit(720.0), a).alias("implausible"))


COMPASS_SQL = ", ".join(f"'{c}'" for c in scalars.COMPASS)


@query(f"""
WITH d AS (SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'N.E.' WHEN 1 THEN 'calma' WHEN 2 THEN 'SW, ' || event_type WHEN 3 THEN 'n/nno' WHEN 4 THEN CAST(round(value, 1) AS VARCHAR) END AS token FROM events)
SELECT event_id, coalesce(len(list_filter(list_filter(regexp_split_to_array(upper(token), '[,;/\\s]+'), lambda x: x <> ''), lambda p: replace(p, '.', '') NOT IN ({COMPASS_SQL}))) > 0, FALSE) AS invalid FROM d
""")
def compass_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    token = F.when(k == 0, "N.E.").when(k == 1, "calma").when(k == 2, F.concat(F.lit("SW, "), "event_type")).when(k == 3, "n/nno").when(k == 4, F.round("value", 1).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", scalars.invalid_compass(token).alias("invalid"))


@query(f"""
WITH s AS (
    SELECT 0 AS src, * FROM lineitem WHERE l_partkey % 3 <> 0 UNION ALL SELECT 1, * FROM lineitem WHERE l_partkey % 3 <> 1
)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM s
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY src, {', '.join(LINE_ORDER)}) = 1
""")
def merge_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    two = [df.where(F.col("l_partkey") % 3 != k) for k in (0, 1)]
    return merge.merged(two, ["l_orderkey", "l_linenumber"], LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""
SELECT o_orderkey, CASE WHEN touched THEN c_mktsegment ELSE 'own' END AS station, CASE WHEN touched THEN 'worklist' ELSE 'printed' END AS station_source, touched
FROM (SELECT o_orderkey, c_mktsegment, o_orderpriority NOT LIKE '1%' AND c_mktsegment IS NOT NULL AND c_custkey % 10 <> 0 AS touched FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
""")
def station_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), "o_orderpriority", F.lit("own").alias("station"), F.lit("printed").alias("station_source"))
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_mktsegment")).alias("station"), F.lit("worklist").alias("station_source"))
    return merge.enriched(rows, registry, ["key"], "station", "station_source", F.col("o_orderpriority").startswith("1")).select("o_orderkey", "station", "station_source", "touched")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return merge.not_produced(table(spark, sf_dir, "customer"), big, ["c_custkey"]).select("c_custkey", "c_name")


@query("""
WITH o AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS d, count(*) AS r FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1),
n AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS d, count(*) AS r FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1)
SELECT l_orderkey, n.d AS new_days, o.d AS old_days,
       CASE WHEN o.d IS NULL THEN 'unknown' WHEN n.d > o.d OR (n.d = o.d AND n.r / n.d < o.r / o.d - 1e-9) THEN 'replace' ELSE 'keep' END AS decision
FROM n LEFT JOIN o USING (l_orderkey)
""")
def replace_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    out = merge.replaced_pages(df.where("l_partkey % 4 <> 0"), df.where("l_partkey % 3 <> 0"), ["l_orderkey"], "l_linenumber")
    return out.select("l_orderkey", "new_days", "old_days", "decision")


@query("""
SELECT source, CAST(sum(quality) AS BIGINT) AS ok, CAST(sum(1 - quality) AS BIGINT) AS wrong, count(*) AS total, round(1.0 * sum(1 - quality) / count(*), 6) AS error_rate
FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)
""")
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    wrong = F.sum(1 - F.col("quality"))
    return both.rollup("source").agg(F.sum("quality").alias("ok"), wrong.alias("wrong"), F.count("*").alias("total"), F.round(wrong / F.count("*"), 6).alias("error_rate"))


@query("""
WITH v AS (SELECT user_id, event_type, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(round(value / 250) AS DOUBLE) END AS v FROM events),
c AS (SELECT user_id, event_type, v, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT user_id, event_type, sum(n) AS votes, max(n) AS top, arg_max(struct_pack(v := v), n) AS best FROM c GROUP BY ALL),
m AS (SELECT user_id, event_type, median(v) AS middle FROM v GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN 2 * top > votes THEN best.v ELSE middle END AS value, 2 * top > votes AS agreed, CAST(votes AS BIGINT) AS votes FROM t JOIN m USING (user_id, event_type)
""")
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("event_id") % 13 != 0, F.round(F.col("value") / 250)).alias("v"))
    return evaluate.voted(v, ["user_id", "event_type"], "v")


READ = "CASE WHEN l_partkey % 19 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_tax END AS l_tax, CASE WHEN l_partkey % 19 = 0 THEN 0.5 ELSE l_discount END AS l_discount"


def second_read(df: DataFrame) -> DataFrame:
    k = F.col("l_partkey")
    out = df.withColumns({"l_quantity": F.when(k % 19 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")), "l_tax": F.when(k % 23 != 0, F.col("l_tax")), "l_discount": F.when(k % 19 == 0, 0.5).otherwise(F.col("l_discount"))})
    return out.where("l_partkey % 29 <> 0")


@query(f"""
WITH g AS ({LINES}), r AS (SELECT l_orderkey, pos, TRUE AS there, {READ} FROM g WHERE l_partkey % 29 <> 0),
c AS (SELECT g.l_orderkey, g.pos, there, CASE WHEN there THEN
        CAST(abs(g.l_quantity - r.l_quantity) <= 0.05 AS INT) + CAST(coalesce(abs(g.l_tax - r.l_tax) <= 0.05, FALSE) AS INT) + CAST(abs(g.l_discount - r.l_discount) <= 0.05 AS INT) ELSE 0 END AS ok
      FROM g LEFT JOIN r USING (l_orderkey, pos))
SELECT l_orderkey, count(*) * 3 AS n_cells, round(sum(ok) / (count(*) * 3), 9) AS cell_acc, round(avg(CASE WHEN there IS NULL OR ok = 0 THEN 1.0 ELSE 0.0 END), 9) AS structural_err_rate FROM c GROUP BY 1
""")
def score_vs_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = lines(spark, sf_dir)
    out = evaluate.score(gold, second_read(gold), ["l_orderkey"], ["pos"], ["l_quantity", "l_tax", "l_discount"])
    return out.select("l_orderkey", "n_cells", *[F.round(c, 9).alias(c) for c in ("cell_acc", "structural_err_rate")])


@query(f"""
WITH g AS ({LINES}), r AS (SELECT l_orderkey, pos, {READ} FROM g WHERE l_partkey % 29 <> 0),
b AS (SELECT l_orderkey, pos, 'l_quantity' AS "column", g.l_quantity AS a, r.l_quantity AS b FROM g JOIN r USING (l_orderkey, pos)
      UNION ALL SELECT l_orderkey, pos, 'l_tax', g.l_tax, r.l_tax FROM g JOIN r USING (l_orderkey, pos))
SELECT * FROM b WHERE (a IS NULL) <> (b IS NULL) OR abs(a - b) > 0.005
""")
def reconcile_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = lines(spark, sf_dir)
    return evaluate.disagreements(gold, second_read(gold), ["l_orderkey", "pos"], ["l_quantity", "l_tax"], 0.005)


@query("""
WITH s AS (SELECT l_partkey, p_retailprice / avg(l_extendedprice / l_quantity) AS stat FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, p_retailprice),
c AS (SELECT median(stat) AS centre FROM s), m AS (SELECT greatest(median(abs(stat - centre)), 1e-9) AS mad FROM s, c)
SELECT l_partkey, round(stat, 6) AS stat, round(abs(stat - centre) / mad, 4) AS z, abs(stat - centre) / mad <= 6 AS agrees FROM s, c, m
""")
def robust_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    both = per.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    return evaluate.robust_relation(both, F.col("p_retailprice") / F.col("unit")).select("l_partkey", F.round("stat", 6).alias("stat"), F.round("z", 4).alias("z"), "agrees")


@query("""
WITH d AS (SELECT user_id, CASE WHEN user_id % 7 = 0 AND event_id % 50 = 0 THEN NULL ELSE value END AS value FROM events),
s AS (SELECT user_id, CASE WHEN count(value) = count(*) THEN avg(value) END AS computed FROM d GROUP BY 1),
p AS (SELECT user_id, round(avg(value), 2) + user_id % 3 * 0.1 AS printed FROM events GROUP BY 1)
SELECT user_id, 'value' AS "column", round(computed, 6) AS computed, round(printed, 6) AS printed, abs(computed - printed) <= 0.06 AS passes FROM s JOIN p USING (user_id)
""")
def month_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    shown = e.groupBy("user_id").agg((F.round(F.avg("value"), 2) + F.col("user_id") % 3 * 0.1).alias("value"))
    days = e.select("user_id", F.when(~((F.col("user_id") % 7 == 0) & (F.col("event_id") % 50 == 0)), F.col("value")).alias("value"))
    out = evaluate.aggregate_checks(days, shown, ["user_id"], {"value": "mean"})
    return out.select("user_id", "column", F.round("computed", 6).alias("computed"), F.round("printed", 6).alias("printed"), "passes")


LABELS = "SELECT conv_id, turn AS pos, CASE WHEN turn % 4 = 0 THEN 'Mez' ELSE CAST(turn % 4 AS VARCHAR) END AS label, length(text) AS score, role FROM conversations"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", t.alias("pos"), F.when(t % 4 == 0, "Mez").otherwise((t % 4).cast("string")).alias("label"), F.length("text").cast("long").alias("score"), "role")


@query(f"""
WITH b AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY pos) <> role, TRUE) AS new FROM ({LABELS}) WHERE role <> 'system'),
r AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY conv_id ORDER BY pos) AS run FROM b)
SELECT conv_id, pos, role, score FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, run ORDER BY score DESC, pos) = 1
""")
def dedupe_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labels(spark, sf_dir).withColumn("role", F.when(F.col("role") != "system", F.col("role")))
    return pages.deduped_labels(d, ["conv_id"], "pos", "role", "score")


@query(f"""
WITH b AS (SELECT *, coalesce(sum(CAST(label = '1' AS INT)) OVER (PARTITION BY conv_id ORDER BY pos), 0)
                   + coalesce(sum(CAST(label = 'Mez' AS INT)) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ({LABELS}))
SELECT conv_id, min(pos) AS first_pos, max(pos) AS last_pos FROM b GROUP BY conv_id, b HAVING list(label ORDER BY pos) = ['1', '2', '3', 'Mez']
""")
def label_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.label_blocks(labels(spark, sf_dir), ["conv_id"], "pos", "label", ["1", "2", "3", "Mez"])


@query(f"""
SELECT conv_id, pos AS first_pos FROM (SELECT *, lead(label, 1) OVER w AS b, lead(label, 2) OVER w AS c FROM ({LABELS}) WINDOW w AS (PARTITION BY conv_id ORDER BY pos))
WHERE label = '1' AND b = '2' AND c = '3'
""")
def dekad_trios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.trios(labels(spark, sf_dir), ["conv_id"], "pos", "label", ("1", "2", "3"))


@query("""
WITH h AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 5 = 1 THEN '' END AS head FROM conversations),
l AS (SELECT *, last_value(CASE WHEN head <> '' THEN head END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM h)
SELECT conv_id, turn, CASE WHEN head = '' THEN NULL ELSE last END AS resolved,
       CASE WHEN head <> '' THEN 'printed' WHEN head IS NULL AND last IS NOT NULL THEN 'inherited' ELSE 'none' END AS resolved_from FROM l
""")
def inherit_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("turn") % 3 == 0, F.col("role")).when(F.col("turn") % 5 == 1, "")
    d = table(spark, sf_dir, "conversations").withColumn("head", head)
    return pages.inherited(d, ["conv_id"], "turn", "head").select("conv_id", "turn", "resolved", "resolved_from")


@query(f"""
WITH p AS ({LINES})
SELECT a.l_orderkey, a.pos AS a, b.pos AS b FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.pos < b.pos
WHERE abs(a.l_quantity - b.l_quantity) < 2.5 AND abs(a.l_discount - b.l_discount) < 2.5 AND abs(a.l_tax - b.l_tax) < 2.5
""")
def near_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.near_pairs(lines(spark, sf_dir), ["l_orderkey"], "pos", ["l_quantity", "l_discount", "l_tax"], 2.5)


@query("""
SELECT l_suppkey, vbl, stat, year(l_shipdate) AS year, count(*) AS n, CAST(sum(CAST(round(v * 1000) AS BIGINT)) AS BIGINT) AS total_thousandths FROM (
    SELECT l_suppkey, l_shipdate, 'p' AS vbl, 'point' AS stat, round(l_quantity * 1.333224, 3) AS v FROM lineitem
    UNION ALL SELECT l_suppkey, l_shipdate, 'rr', 'sum', round(l_tax * 25.4, 3) FROM lineitem
) GROUP BY ALL
""")
def unpivot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [("p", "point", scalars.convert(F.col("l_quantity"), "mmHg")), ("rr", "sum", scalars.convert(F.col("l_tax"), "in"))]
    long = F.explode(F.array(*[F.struct(F.lit(a).alias("vbl"), F.lit(b).alias("stat"), v.alias("v")) for a, b, v in made])).alias("x")
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").cast("long").alias("year"), long)
    return d.groupBy("l_suppkey", "x.vbl", "x.stat", "year").agg(F.count("*").alias("n"), F.sum(F.round(F.col("x.v") * 1000).cast("long")).alias("total_thousandths"))


@query("""
SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('seed/' || doc_id), doc_id) <= 20
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return govern.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang"], ["doc_id"], 20, "seed")


@query("""
WITH g AS (SELECT * FROM documents WHERE doc_id % 17 = 0), t AS (SELECT * FROM documents WHERE doc_id % 17 <> 1)
SELECT DISTINCT doc_id FROM t WHERE doc_id IN (SELECT doc_id FROM g) OR sha256(text) IN (SELECT sha256(text) FROM g)
""")
def leakage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return govern.leaked(d.where("doc_id % 17 <> 1"), d.where("doc_id % 17 = 0"), ["doc_id"], "text")


@query("""
WITH d AS (SELECT sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS d FROM orders),
s AS (SELECT count(*) AS n, sum(CAST(('0x' || substr(d, 1, 15)) AS BIGINT)) AS s0, sum(CAST(('0x' || substr(d, 17, 15)) AS BIGINT)) AS s1,
             sum(CAST(('0x' || substr(d, 33, 15)) AS BIGINT)) AS s2, sum(CAST(('0x' || substr(d, 49, 15)) AS BIGINT)) AS s3 FROM d)
SELECT n, sha256(concat_ws('|', n, s0, s1, s2, s3)) AS sha256 FROM s
""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return govern.fingerprint(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0 THEN CAST(year(o_orderdate) - 110 AS VARCHAR) || strftime(o_orderdate, '-%m') END AS period FROM orders
""")
def caption_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Captions a century back; every fifth names a second month, and a third of those say which they are of.
    names = F.array(*[F.lit(m[0].capitalize()) for m in scalars.MONTHS])
    k, month, other = F.col("o_orderkey"), F.get(names, F.month("o_orderdate") - 1), F.get(names, F.month("o_orderdate") % 12)
    year = (F.year("o_orderdate") - 110).cast("string")
    of = F.when((k % 5 == 0) & (k % 3 != 0), F.concat(month, F.lit(" e "), other)).otherwise(F.concat(F.lit("mez de "), month))
    text = F.concat(F.lit("Observações: "), of, F.lit(" de "), year, F.when(k % 15 == 0, F.concat(F.lit("; comparar com "), other)).otherwise(", Rio de Janeiro"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.caption_period(text).alias("period"))


@query("""
SELECT s_suppkey, round(CASE WHEN s_suppkey % 2 = 0 THEN -1 ELSE 1 END * (s_suppkey % 90 + (s_suppkey % 60) / 60), 6) + CAST(0 AS DOUBLE) AS degrees FROM supplier
""")
def angle_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat((k % 90).cast("string"), F.lit("°"), (k % 60).cast("string"), F.lit("' "), F.when(k % 2 == 0, "W").otherwise("E"))
    return table(spark, sf_dir, "supplier").select(k, (F.round(scalars.parse_angle(text), 6) + F.lit(0.0)).alias("degrees"))


@query("""
WITH c AS (SELECT source, count(*) AS candidates FROM documents GROUP BY 1), i AS (SELECT source, count(*) AS identified FROM documents JOIN labels USING (doc_id) GROUP BY 1),
p AS (SELECT source, count(*) AS produced FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1)
SELECT source, CAST(sum(candidates) AS BIGINT) AS candidates, CAST(sum(coalesce(identified, 0)) AS BIGINT) AS identified, CAST(sum(coalesce(produced, 0)) AS BIGINT) AS produced,
       CAST(sum(greatest(0, candidates - coalesce(identified, 0))) AS BIGINT) AS unread
FROM c FULL JOIN i USING (source) FULL JOIN p USING (source) GROUP BY ROLLUP (source)
""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = lambda c: F.sum(c.cast("long"))
    per = both.groupBy("source").agg(F.count("*").alias("candidates"), n(F.col("quality").isNotNull()).alias("identified"), n(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("produced"))
    per = per.withColumn("unread", F.greatest(F.lit(0), F.col("candidates") - F.col("identified")))
    return per.rollup("source").agg(*[F.sum(c).alias(c) for c in ("candidates", "identified", "produced", "unread")])


@query("""
WITH h AS (SELECT CAST(least(255, floor(value / 2)) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS w, sum(n * bin) OVER (ORDER BY bin) AS s, sum(n) OVER () AS wt, sum(n * bin) OVER () AS st FROM h)
SELECT bin AS threshold FROM c WHERE w < wt ORDER BY round(CAST(w AS DOUBLE) * (wt - w) * power(s / w - (st - s) / (wt - w), 2), 3) DESC, bin LIMIT 1
""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").select(F.least(F.lit(255), F.floor(F.col("value") / 2)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    # At most 256 rows from here on.
    up, all_ = Window.partitionBy(F.lit(0)).orderBy("bin"), Window.partitionBy(F.lit(0))
    mass = F.col("n") * F.col("bin")
    c = h.select("bin", F.sum("n").over(up).alias("w"), F.sum(mass).over(up).alias("s"), F.sum("n").over(all_).alias("wt"), F.sum(mass).over(all_).alias("st")).where("w < wt")
    between = F.expr("round(double(w) * (wt - w) * power(s / w - (st - s) / (wt - w), 2), 3)")
    return c.orderBy(between.desc(), "bin").limit(1).select(F.col("bin").alias("threshold"))

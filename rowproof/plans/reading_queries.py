"""Registered queries of the reading operators and of captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.functions import captions, scalars
from rowproof.operators import pages, reading, series
from rowproof.sources import sef

from .queries import LINES, events, lines, query, table

CELLS = ["quantity", "discount", "tax"]


def two_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a first reading (a_) and a second one (b_) that swaps, changes or drops cells."""
    k = F.col("l_partkey")
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    swap = k % 5 == 0
    return lines(spark, sf_dir).select(
        "l_orderkey", "pos", q.alias("a_quantity"), d.alias("a_discount"), t.alias("a_tax"),
        F.when(k % 7 == 0, q + 1).otherwise(q).alias("b_quantity"), F.when(swap, t).otherwise(d).alias("b_discount"),
        F.when(k % 11 != 0, F.when(swap, d).otherwise(t)).alias("b_tax"),
    )


def neighbour(k: str, others: list[str]) -> str:
    cases = " ".join(f"WHEN a_{k} = b_{m} OR b_{k} = a_{m} THEN '{k}<->{m}'" for m in others)
    return f"CASE WHEN a_{k} <> b_{k} THEN CASE {cases} ELSE '' END END"


CLASSIFIED = f"""
WITH r AS (
    SELECT l_orderkey, pos, l_quantity AS a_quantity, l_discount AS a_discount, l_tax AS a_tax,
           CASE WHEN l_partkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END AS b_quantity,
           CASE WHEN l_partkey % 5 = 0 THEN l_tax ELSE l_discount END AS b_discount,
           CASE WHEN l_partkey % 11 <> 0 THEN CASE WHEN l_partkey % 5 = 0 THEN l_discount ELSE l_tax END END AS b_tax
    FROM ({LINES})
), k AS (
    SELECT l_orderkey, pos, [{neighbour("quantity", ["discount"])}, {neighbour("discount", ["tax", "quantity"])}, {neighbour("tax", ["discount"])}] AS s FROM r
), c AS (
    SELECT l_orderkey, pos, list_filter(s, lambda x: x <> '') AS shifts,
           list_filter(['quantity', 'discount', 'tax'], lambda x, i: s[i] = '') AS changed FROM k
)
"""


@query(CLASSIFIED + "SELECT l_orderkey, pos, array_to_string(shifts, ',') AS shifts, array_to_string(changed, ',') AS changed FROM c")
def read_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reading.classified(two_reads(spark, sf_dir), CELLS, "a_", "b_")
    return out.select("l_orderkey", "pos", F.array_join("shifts", ",").alias("shifts"), F.array_join("changed", ",").alias("changed"))


@query(CLASSIFIED + """
SELECT l_orderkey, n, n_shift, n_changed, greatest(n_shift, n_changed) / n >= 0.5 AS unstable,
       CASE WHEN greatest(n_shift, n_changed) / n >= 0.5 THEN 0 ELSE odd END AS suspects
FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (len(shifts) > 0) AS n_shift, count(*) FILTER (len(changed) > 0) AS n_changed,
             count(*) FILTER (len(shifts) + len(changed) > 0) AS odd FROM c GROUP BY 1)
""")
def page_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.page_stability(reading.classified(two_reads(spark, sf_dir), CELLS, "a_", "b_"), ["l_orderkey"])


@query("""
WITH log AS (
    SELECT user_id, event_id % 2 AS f, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts DESC, event_id DESC) = 1
), j AS (
    SELECT c.*, a.user_id IS NOT NULL AND c_acctbal IS DISTINCT FROM a.value AS ca, n.user_id IS NOT NULL AND c_nationkey IS DISTINCT FROM CAST(trunc(n.value) AS INT) AS cn,
           a.value AS na, CAST(trunc(n.value) AS INT) AS nn
    FROM customer c LEFT JOIN log a ON a.user_id = c_custkey AND a.f = 0 LEFT JOIN log n ON n.user_id = c_custkey AND n.f = 1
)
SELECT c_custkey, CASE WHEN ca THEN na ELSE c_acctbal END AS c_acctbal, CASE WHEN cn THEN nn ELSE c_nationkey END AS c_nationkey,
       CAST(ca AS INT) + CAST(cn AS INT) AS n_corrections, ca OR cn AS human_verified FROM j
""")
def corrected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.when(F.col("event_id") % 2 == 0, "c_acctbal").otherwise("c_nationkey")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), field.alias("field"), F.col("value").alias("now"), "ts", "event_id")
    out = reading.corrected(table(spark, sf_dir, "customer"), log, ["c_custkey"], "field", "now", ["ts", "event_id"], ["c_acctbal", "c_nationkey"])
    return out.select("c_custkey", "c_acctbal", "c_nationkey", F.size("corrections").alias("n_corrections"), "human_verified")


def spent(n: int, name: str, limit: float) -> str:
    """One expectation: its nearest number is taken out of the pool where it is within the limit."""
    d = f"list_transform(pool, lambda v: abs(v - {name}))"
    at = f"list_position({d}, list_min({d}))"
    hit = f"coalesce(list_min({d}) <= {limit}, FALSE)"
    return f"s{n} AS (SELECT * REPLACE (CASE WHEN {hit} THEN pool[1:{at} - 1] || pool[{at} + 1:] ELSE pool END AS pool, CASE WHEN {hit} THEN missing ELSE missing || ['{name}'] END AS missing) FROM s{n - 1})"


@query(f"""
WITH s0 AS (
    SELECT l_orderkey, quantity, discount, tax, CAST([] AS VARCHAR[]) AS missing,
           list_filter([round(tax, 1), CASE WHEN l_orderkey % 7 <> 0 THEN round(quantity) END, round(discount, 1), CAST(l_orderkey % 50 AS DOUBLE)], lambda v: v IS NOT NULL) AS pool
    FROM (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) / count(*) AS quantity, sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) AS discount, sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) AS tax FROM lineitem GROUP BY 1)
), {spent(1, "quantity", 0.5)}, {spent(2, "discount", 0.06)}, {spent(3, "tax", 0.06)}
SELECT l_orderkey, array_to_string(missing, ',') AS missing FROM s3
""")
def means_unordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a page against its printed numbers, whose order is lost."""
    mean = lambda c: F.sum(c.cast("long")) / F.count("*")
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        mean(F.col("l_quantity")).alias("quantity"), mean(F.round(F.col("l_discount") * 100)).alias("discount"), mean(F.round(F.col("l_tax") * 100)).alias("tax")
    )
    page = F.col("l_orderkey")
    printed = F.array(F.round("tax", 1), F.when(page % 7 != 0, F.round("quantity")), F.round("discount", 1), (page % 50).cast("double"))
    missing = reading.unmatched_means([("quantity", F.col("quantity"), 0.5), ("discount", F.col("discount"), 0.06), ("tax", F.col("tax"), 0.06)], printed)
    return per.select("l_orderkey", F.array_join(missing, ",").alias("missing"))


@query("""
SELECT l_returnflag, count(closes) AS n_checked, count(*) FILTER (closes) AS n_closed FROM (
    SELECT l_returnflag, CASE WHEN l_partkey % 17 <> 0 THEN abs((l_discount + l_tax) / 2 - 0.05) < 0.0201 END AS closes FROM lineitem) GROUP BY 1
""")
def closure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").withColumn("printed", F.when(F.col("l_partkey") % 17 != 0, 0.05))
    out = reading.closure(df, ["l_discount", "l_tax"], "printed", 0.0201)
    return out.groupBy("l_returnflag").agg(F.count("closes").alias("n_checked"), F.count_if("closes").alias("n_closed"))


@query("""
WITH r AS (
    SELECT strftime(ts, '%Y-%m-%d') AS period, CASE WHEN event_id % 13 <> 0 THEN user_id END AS day,
           CASE WHEN event_id % 4 <> 0 THEN value + CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END END AS got,
           CASE WHEN event_id % 6 = 0 THEN 0.0 WHEN event_id % 19 <> 0 THEN value END AS truth FROM events
), g AS (SELECT *, day IS NOT NULL AND truth IS NOT NULL AS known, abs(coalesce(got, 0) - truth) < 0.05 AS good FROM r)
SELECT period, grouping(period) = 1 AS is_total, count(*) AS n_rows, count(*) FILTER (known) AS n_graded, count(*) FILTER (known AND good) AS n_exact,
       count(*) FILTER (known AND truth > 0) AS n_wet, count(*) FILTER (known AND truth > 0 AND good) AS n_wet_exact, count(*) FILTER (day IS NULL) AS n_no_day
FROM g GROUP BY ROLLUP (period)
""")
def period_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    df = table(spark, sf_dir, "events").withColumn("period", F.date_format("ts", "yyyy-MM-dd"))
    got = F.when(e % 4 != 0, v + F.when(e % 9 == 0, 1).otherwise(0))
    truth = F.when(e % 6 == 0, 0.0).when(e % 19 != 0, v)
    return reading.graded(df, "period", F.when(e % 13 != 0, F.col("user_id")), got, truth)


NAMES = ["Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro"]


@query("""
WITH p AS (
    SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) - 110 AS VARCHAR) AS y, month(o_orderdate) AS m FROM orders
), q AS (
    SELECT *, y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') AS stored,
           CASE o_custkey % 5 WHEN 0 THEN 'nocap' WHEN 3 THEN 'ambiguous' WHEN 4 THEN CASE WHEN m = 3 THEN 'agree' ELSE 'fixed' END ELSE 'agree' END AS bucket FROM p
)
SELECT o_orderkey, bucket, bucket = 'agree' AND o_custkey % 5 = 2 AND y <> '1888' AS year_odd,
       CASE WHEN bucket = 'fixed' THEN stored END AS period_as_published, CASE WHEN bucket = 'fixed' THEN y || '-03' ELSE stored END AS period FROM q
""")
def period_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored periods (a century back, as captions name those) against captions."""
    k, y = F.col("o_custkey") % 5, (F.year("o_orderdate") - 110).cast("string")
    name = F.get(F.array(*map(F.lit, NAMES)), F.month("o_orderdate") - 1)
    said = F.when(k == 0, "").when(k == 1, F.concat(F.lit("Observações de "), name, F.lit(" de "), y)).when(k == 2, F.concat(F.lit("mez de "), name, F.lit(" de 1888")))
    said = said.when(k == 3, F.concat(F.lit("Maio e Junho de "), y)).otherwise(F.concat(F.lit("Quadro do mez de Março de "), y))
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(y, F.date_format("o_orderdate", "-MM")).alias("period"), said.alias("caption"))
    return reading.period_audit(df, "period", "caption", scalars.caption_period(F.col("caption"))).drop("caption")


@query("""
SELECT bucket, n_pages, n_spent FROM (
    SELECT CASE WHEN o_totalprice > 400000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority LIKE '1%' THEN 'urgent' ELSE 'other' END AS bucket,
           count(*) AS n_pages, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS n_spent FROM orders GROUP BY 1)
""")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reading.triaged(table(spark, sf_dir, "orders"), [("large", F.col("o_totalprice") > 400000), ("closed", F.col("o_orderstatus") == "F"), ("urgent", F.col("o_orderpriority").startswith("1"))], "other")
    return out.groupBy("bucket").agg(F.count("*").alias("n_pages"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("n_spent"))


FIRST = "CASE p_size % 7 WHEN 0 THEN '1ª' WHEN 1 THEN ' 2 a ' WHEN 2 THEN '3' WHEN 3 THEN 'Mez....' WHEN 4 THEN '.mês.' WHEN 5 THEN '4' ELSE p_name END"


@query(f"""
SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN 'Mez' WHEN 4 THEN 'Mez' END AS label,
       trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug
FROM (SELECT *, {FIRST} AS first FROM part)
""")
def row_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").withColumn("raw", F.concat(F.expr(FIRST), F.lit(" | "), F.col("p_type")))
    return df.select("p_partkey", captions.row_label(F.col("raw")).alias("label"), captions.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'bahia_capital' WHEN 1 THEN 'sao_paulo' WHEN 2 THEN 'ponte_buarque_de_macedo' WHEN 3 THEN replace(lower(replace(c_name, '#', '_')), ' ', '_') WHEN 4 THEN NULL ELSE 'ouro_preto' END AS station,
       CASE c_custkey % 6 WHEN 0 THEN 'station' WHEN 1 THEN 'month_only' WHEN 2 THEN 'month_only' WHEN 3 THEN 'unclear' ELSE 'unclear' END AS heading
FROM customer
""")
def station_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, "Bahia (Capital)").when(k == 1, "Estação de S. Paulo").when(k == 2, "Ponte B. de Macedo").when(k == 3, F.col("c_name")).when(k == 5, "OURO PRETO")
    head = F.when(k == 0, F.concat(F.lit("Estação "), F.col("c_name"))).when(k == 1, "Mez de Julho de 1889").when(k == 2, "Revista do Observatório — mez de Março de 1888, 142").when(k == 3, F.concat(F.lit("Mez de Julho de 1889 "), F.col("c_mktsegment")))
    return table(spark, sf_dir, "customer").select("c_custkey", captions.canonical_station(name).alias("station"), captions.header_kind(head).alias("heading"))


@query(f"""
WITH l AS ({LINES}), p AS (
    SELECT a.l_orderkey, list_distinct(list(struct_pack(d := abs(a.l_quantity - (b.l_quantity + b.pos % 3)), l := a.pos, r := b.pos))) AS pairs FROM l a JOIN l b USING (l_orderkey) GROUP BY 1
), m AS (
    SELECT l_orderkey, list_reduce(list_transform(list_sort(pairs), lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.l = x[1].l OR y.r = x[1].r)) = 0 THEN a || x ELSE a END) AS m FROM p
)
SELECT l_orderkey, u.l AS pos, u.r AS other, u.d AS distance FROM (SELECT l_orderkey, unnest(m) AS u FROM m)
""")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order's two readings matched one to one, nearest first; the
    second reading's lines come in another order."""
    a = lines(spark, sf_dir).select("l_orderkey", "pos", "l_quantity")
    b = a.select("l_orderkey", F.col("pos").alias("other"), (F.col("l_quantity") + F.col("pos") % 3).alias("q"))
    pairs = a.join(b, "l_orderkey").select("l_orderkey", "pos", "other", F.abs(F.col("l_quantity") - F.col("q")).alias("distance"))
    return reading.matched_in_page(pairs, ["l_orderkey"], "pos", "other", "distance")


@query("""
WITH RECURSIVE p AS (
    SELECT user_id, CAST(day(ts) AS DOUBLE) AS x, min(day(ts) * 20 + value / 20) AS y FROM events WHERE value IS NOT NULL GROUP BY ALL
), n AS (SELECT user_id, count(*) AS n FROM p GROUP BY 1), f AS (
    SELECT p.user_id, x, y, 0 AS round, greatest(8, CAST(floor(0.65 * n) AS INTEGER)) AS least FROM p JOIN n USING (user_id) WHERE n >= 8
    UNION ALL
    SELECT user_id, x, y, round + 1, least FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off DESC, x) AS place, max(off) OVER (PARTITION BY user_id) AS worst FROM (
            SELECT *, regr_slope(y, x) OVER w AS b, abs(y - regr_intercept(y, x) OVER w - x * regr_slope(y, x) OVER w) AS off, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY user_id))
    ) WHERE worst > 0.35 * b AND n > least AND place > 1
), d AS (
    SELECT user_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, list(struct_pack(x := x, y := y)) AS held FROM f WHERE round = (SELECT max(round) FROM f g WHERE g.user_id = f.user_id) GROUP BY 1
), m AS (SELECT *, list_max(list_transform(held, lambda q: abs(q.y - a - b * q.x))) AS off FROM d)
SELECT n.user_id, round(b, 6) AS slope, round(a, 6) AS intercept, round(off, 6) AS max_resid, CAST(n AS INTEGER) AS n_days, CASE WHEN held IS NULL THEN -1 ELSE CAST(len(held) AS INTEGER) END AS n_supporting, coalesce(b >= 4 AND off <= 0.35 * b, FALSE) AS accept FROM n LEFT JOIN m USING (user_id)
""")
def robust_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line through each user's days, 20 units apart, that values disturb."""
    e = table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts"))
    out = reading.line_through(e.withColumn("y", F.col("day") * 20 + F.col("value") / 20), ["user_id"], "day", "y", 1, 31)
    return out.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "max_resid")})


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE round(CASE c_custkey % 4 WHEN 1 THEN -0.25 * c_nationkey WHEN 2 THEN 15 * (c_nationkey / 60) ELSE -(c_nationkey + (c_custkey % 60) / 60) END, 6) + CAST(0 AS DOUBLE) END AS longitude,
       CASE WHEN c_custkey % 4 <> 0 THEN 'S' END AS lat_letter, CASE WHEN c_custkey % 4 = 3 THEN c_nationkey END AS barometer_m, c_custkey % 4 = 0 AS moves
FROM customer
""")
def station_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed headings of stations: fields, angles, letters, heights."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    at = F.when(k % 4 == 1, F.concat(n, F.lit("m W"))).when(k % 4 == 2, F.concat(F.lit("0h,"), n, F.lit("m E"))).when(k % 4 == 3, F.concat(n, F.lit("°"), (k % 60).cast("string"), F.lit("' O"))).otherwise("var.")
    line = F.concat(F.lit("Estação de "), F.col("c_mktsegment"), F.lit("; Latit., "), F.when(k % 4 == 0, "Var.").otherwise("S 12°58'27''"), F.lit("; Longitude, "), at, F.when(k % 4 == 3, F.concat(F.lit("; Alt. do bar., "), n, F.lit(" m"))).otherwise(""))
    h = captions.header_fields(line)
    df = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(h)).alias("h"))
    return df.select("c_custkey", (F.round("h.lon_deg", 6) + F.lit(0.0)).alias("longitude"), F.col("h.lat_hemisphere").alias("lat_letter"), F.col("h.barometer_m").alias("barometer_m"), F.col("h.moves").alias("moves"))


@query("""
WITH m AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
n AS (SELECT *, row_number() OVER w AS k, first_value(month) OVER w AS first FROM m WINDOW w AS (PARTITION BY o_custkey ORDER BY month)),
e AS (SELECT *, CAST(first + to_months(CAST(k - 1 AS INT)) AS DATE) AS reconciled FROM n)
SELECT o_custkey, month, reconciled, CASE WHEN k = 1 THEN year(month) NOT IN (1995, 1996) ELSE month <> reconciled END AS flagged FROM e
""")
def period_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("month")).distinct()
    return series.reconciled(m, ["o_custkey"], ["month"], "month", [1995, 1996])


@query(f"""
SELECT l_orderkey, count(*) FILTER (pos <= 3 AND (l_linenumber <= 5 OR l_tax < 0.05)) >= 2 AS passes FROM ({LINES}) GROUP BY 1
""")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.preflight(lines(spark, sf_dir), ["l_orderkey"], "pos", (F.col("l_linenumber") <= 5) | (F.col("l_tax") < 0.05))


@query("""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM p WHERE place IN (floor(n * 0.15), floor(n * 0.35), floor(n * 0.5), floor(n * 0.65), floor(n * 0.85))
""")
def spread_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.spread(events(spark, sf_dir), ["user_id"], "pos", [0.15, 0.35, 0.5, 0.65, 0.85]).select("user_id", "event_id")


TAB = "chr(9)"


@query(f"""
WITH s AS (
    SELECT event_type AS station, CASE WHEN value < 5 THEN NULL WHEN event_id % 3 = 0 THEN floor(value) ELSE value END AS v, ts, event_id FROM events
), t AS (SELECT DISTINCT station FROM s),
h AS (
    SELECT station, CAST(unnest(range(13)) AS BIGINT) AS line_no,
           unnest(['SEF' || {TAB} || '1.0.0', 'ID' || {TAB} || station, 'Name' || {TAB} || upper(station), 'Lat' || {TAB} || CASE WHEN length(station) > 5 THEN '-12.5' ELSE 'NA' END,
                   'Lon' || {TAB} || CASE WHEN length(station) > 5 THEN '-43' ELSE 'NA' END, 'Alt' || {TAB} || 'NA', 'Source' || {TAB} || 'print', 'Link' || {TAB} || 'NA',
                   'Vbl' || {TAB} || 'ta', 'Stat' || {TAB} || 'mean', 'Units' || {TAB} || 'C', 'Meta' || {TAB} || 'NA',
                   array_to_string(['Year', 'Month', 'Day', 'Hour', 'Minute', 'Period', 'Value', 'Meta'], {TAB})]) AS line FROM t
)
SELECT * FROM h UNION ALL
SELECT station, 12 + row_number() OVER (PARTITION BY station ORDER BY ts, event_id),
       concat_ws({TAB}, year(ts), month(ts), day(ts), hour(ts), 'NA', 'p', CASE WHEN v IS NULL THEN 'NA' WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END, '') FROM s
""")
def exchange_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of exchange files, one series for each type of event."""
    v = F.when(F.col("value") >= 5, F.when(F.col("event_id") % 3 == 0, F.floor("value").cast("double")).otherwise(F.col("value")))
    t, name = F.col("ts"), F.col("event_type")
    df = table(spark, sf_dir, "events").select(name.alias("station"), "ts", "event_id", *[f(t).alias(c) for c, f in (("year", F.year), ("month", F.month), ("day", F.day), ("hour", F.hour))], F.lit(None).cast("int").alias("minute"), F.lit("p").alias("period"), v.alias("value"), F.lit("").alias("meta"))
    known = F.length("station") > 5
    head = {"ID": F.col("station"), "Name": F.upper("station"), "Lat": F.when(known, -12.5), "Lon": F.when(known, -43.0), "Source": F.lit("print"), "Vbl": F.lit("ta"), "Stat": F.lit("mean"), "Units": F.lit("C")}
    return sef.lines(df, ["station"], ["ts", "event_id"], head)

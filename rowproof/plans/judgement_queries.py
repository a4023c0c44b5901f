"""The whole judgement of pages: orders printed as monthly pages of a station."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.layout import Check, Layout, LayoutColumn
from rowproof.operators import pages
from rowproof.operators.rejudge import rejudged
from rowproof.plans.queries import LINE_ORDER, LINES, by_page, query, table


def station_sheet(years: bool) -> Layout:
    """A page of days, or one of years whose index is the line, too."""
    return Layout(
        "station-years" if years else "station-days",
        (
            LayoutColumn("line", "day", low=1, high=7), LayoutColumn("pressure", unit="mm", low=705, high=790, elided=True, elided_low=700, elided_high=800), LayoutColumn("level", low=20, high=60, carried=True),
            LayoutColumn("tmax"), LayoutColumn("tmin"), LayoutColumn("tmean", low=0, high=26), LayoutColumn("rain"), LayoutColumn("wind"), LayoutColumn("cloud"), LayoutColumn("wind_dir", "text"),
        ),
        (Check("mean", "tmean", ("tmax", "tmin")),), summary_words=("Mez",), rows_per_page="fixed:7" if years else "days_in_month", index_kind="year" if years else "day_of_month",
        monthly={"aggregate": {"tmax": "max", "tmin": "min", "rain": "sum", "wind": "mean"}, "tolerance": {"wind": 1.5}, "blank_is_zero": ["rain"]},
    )


def judgement_sql(years: bool) -> str:
    carry = "floor(last_value(CASE WHEN lv BETWEEN 20 AND 60 THEN lv END IGNORE NULLS) OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    total = lambda k, how, blank="v": f"CASE WHEN sum(CASE WHEN is_day AND {blank} IS NULL THEN 1 ELSE 0 END) OVER p = 0 AND abs({how}(CASE WHEN is_day THEN {blank} END) OVER p - first_value(CASE WHEN total THEN {k} END IGNORE NULLS) OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) > {1.5 if k == 'wind' else 0.06} THEN '{k}' END".replace("v IS", f"{k} IS").replace("THEN v END", f"THEN {k} END")
    filled = """CASE WHEN shown BETWEEN 1 AND 7 THEN shown WHEN count(off) OVER p >= 3 AND min(off) OVER p = max(off) OVER p AND pos + min(off) OVER p BETWEEN 1 AND 7 THEN pos + min(off) OVER p ELSE shown END""" if years else "shown"
    spurious = "FALSE" if years else """CASE WHEN line IS NULL THEN FALSE WHEN k = 1 THEN later IS NOT NULL AND (NOT ok OR later) ELSE NOT ok OR firstok END"""
    return f"""
WITH l AS ({LINES}), s AS (
    SELECT *, l_partkey AS k, l_suppkey AS s, pos = count(*) OVER (PARTITION BY l_orderkey) AND l_orderkey % 3 = 0 AS total, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM l
), raw AS (
    SELECT l_orderkey, pos, k, s, total, l_shipdate, NOT total AND pos > 1 AND k % 5 = 0 AS ditto, NOT total AND NOT (pos > 1 AND k % 5 = 0) AND k % 23 = 0 AS unread, k % 47 = 0 AS flat,
        CASE WHEN total OR pos > 1 AND k % 5 = 0 OR k % 23 = 0 THEN NULL WHEN k % 37 = 0 AND pos > 1 THEN pos - 1 ELSE pos END AS shown,
        CASE WHEN k % 47 = 0 THEN 725.0 ELSE 700 + (cents % 10000) / 100.0 END AS pressure,
        CASE WHEN k % 47 = 0 THEN 25.0 WHEN l_quantity >= 20 THEN l_quantity + 0.25 WHEN k % 6 = 0 THEN l_quantity * 10 + 4 ELSE l_quantity / 100 END AS lv,
        CASE WHEN k % 47 = 0 THEN 25.0 ELSE 20.0 + s % 10 END AS tmax, CASE WHEN k % 47 = 0 THEN 25.0 ELSE 10.0 + k % 5 END AS tmin,
        CASE WHEN k % 47 = 0 THEN 25.0 ELSE (20.0 + s % 10 + 10 + k % 5) / 2 + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END END AS tmean0,
        CASE WHEN k % 47 = 0 THEN 25.0 WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 3 AS DOUBLE) END AS rain, CASE WHEN k % 47 = 0 THEN 25.0 WHEN k % 59 = 0 THEN NULL ELSE round(l_tax * 100) END AS wind, s % 5 = 3 AS badwind,
        CASE WHEN s % 4 <> 0 THEN s % 5 * 300 END AS alt, CASE WHEN k % 53 = 0 THEN (CASE WHEN k % 47 = 0 THEN 25.0 ELSE (30.0 + s % 10 + k % 5) / 2 END) END AS fix
    FROM s
), o AS (SELECT *, CASE WHEN shown BETWEEN 1 AND 7 THEN shown - pos END AS off FROM raw
), f AS (
    SELECT *, {filled} AS now FROM o WINDOW p AS (PARTITION BY l_orderkey)
), d AS (
    SELECT *, ditto AND now IS NULL AS rep, CASE WHEN now BETWEEN 1 AND 7 THEN now END AS legal FROM f
), e AS (
    SELECT *, CASE WHEN rep THEN last_value(legal IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING) ELSE legal END AS day,
        last_value(CASE WHEN NOT rep THEN {{'v': now}} END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS UNBOUNDED PRECEDING).v AS line FROM d
), r AS (
    SELECT *, sum(CASE WHEN day - before IN (0, 1) THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY pos) AS run FROM (SELECT *, lag(day) OVER (PARTITION BY l_orderkey ORDER BY pos) AS before FROM e)
), n AS (
    SELECT *, CASE WHEN day IS NOT NULL THEN count(*) OVER q * 100 - min(pos) OVER q END AS size FROM r WINDOW q AS (PARTITION BY l_orderkey, run)
), y AS (SELECT *, coalesce(size = max(size) OVER (PARTITION BY l_orderkey), FALSE) AS is_day FROM n
), c AS (
    SELECT *, coalesce(max(CASE WHEN is_day THEN day END) OVER p - min(CASE WHEN is_day THEN day END) OVER p + 1 = 1 + l_orderkey % 7 AND min(CASE WHEN is_day THEN day END) OVER p = 1, FALSE) AS complete,
        {total("tmax", "max")} AS b1, {total("tmin", "min")} AS b2, {total("rain", "sum", "coalesce(rain, 0)")} AS b3, {total("wind", "avg")} AS b4,
        CASE WHEN lv BETWEEN 20 AND 60 OR {carry} IS NULL THEN lv ELSE CASE WHEN lv < 1 THEN round({carry} + lv, 4) WHEN round({carry} + lv / 1000, 4) BETWEEN 20 AND 60 THEN round({carry} + CASE WHEN lv < 10 THEN lv / 10 WHEN lv < 100 THEN lv / 100 ELSE lv / 1000 END, 4) ELSE lv END END AS level,
        coalesce(lag(line) OVER g < line, TRUE) AND coalesce(line < lead(line) OVER g, TRUE) AS ok
    FROM y WINDOW p AS (PARTITION BY l_orderkey), g AS (PARTITION BY l_orderkey ORDER BY pos)
), u AS (
    SELECT * EXCLUDE (k), k AS partkey, row_number() OVER h AS k, first_value(ok) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS firstok, max(ok) OVER (h ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM c WINDOW h AS (PARTITION BY l_orderkey, line ORDER BY pos)
), j AS (
    SELECT *, coalesce({spurious}, FALSE) AS spurious, coalesce(fix, tmean0) AS tmean, CASE WHEN unread OR total THEN 'x' END AS p0, CASE WHEN flat AND level = 25 THEN 'degenerate_row' END AS p1, CASE WHEN badwind THEN 'invalid_compass: wind_dir' END AS p2,
        CASE WHEN pressure BETWEEN 705 AND 790 AND abs(pressure - 760 * exp(-alt / 8434.0)) > 25 THEN 'pressure_implausible: pressure' END AS p3, CASE WHEN strftime(l_shipdate, '%Y-%m') NOT BETWEEN '1993-01' AND '1997-12' THEN 'period_suspect' END AS p5
    FROM u
), k AS (
    SELECT *, CASE WHEN spurious THEN 'duplicate_day' END AS p4, CASE WHEN NOT is_day THEN 'not_a_day_row' END AS q1, CASE WHEN now IS DISTINCT FROM shown THEN 'index_from_page_sequence' END AS q2, CASE WHEN NOT complete THEN 'page_day_sequence_incomplete' END AS q3,
        CASE WHEN line NOT BETWEEN 1 AND 7 THEN 'line' END AS v1, CASE WHEN pressure NOT BETWEEN 705 AND 790 THEN 'pressure' END AS v2, CASE WHEN level NOT BETWEEN 20 AND 60 THEN 'level' END AS v3, CASE WHEN tmean NOT BETWEEN 0 AND 26 THEN 'tmean' END AS v4, CASE WHEN abs(tmean - (tmax + tmin) / 2) > 0.051 THEN 'mean:tmean' END AS failures
    FROM j
)
SELECT l_orderkey, pos, CAST(line AS DOUBLE) AS line, pressure, level, tmean, is_day, complete,
    CASE WHEN is_day AND coalesce(p0, p1, p2, p3, p4, p5, v1, v2, v3, v4, failures) IS NULL THEN 'checks_pass' ELSE 'flagged' END AS verdict,
    concat_ws(',', CASE WHEN unread THEN 'line: unparsable ''xx''' WHEN total THEN 'line: unparsable ''Mez''' END, p1, p2, p3, p4, p5, q1, q2, q3) AS problems, concat_ws(',', v1, v2, v3, v4) AS violations, coalesce(failures, '') AS failures,
    concat_ws(',', b1, b2, b3, b4) AS totals, CASE WHEN fix IS DISTINCT FROM tmean0 AND fix IS NOT NULL THEN 'tmean' ELSE '' END AS corrected
FROM k
"""


def judged_lines(spark: SparkSession, sf_dir: str, years: bool) -> DataFrame:
    """Items of an order as the lines of its page: some indexes are repeat signs,
    unreadable or claimed twice, whole parts are carried, totals stand at the end."""
    page, k, s = ["l_orderkey"], F.col("l_partkey"), F.col("l_suppkey")
    df = pages.positioned(by_page(table(spark, sf_dir, "lineitem"), *page), page, LINE_ORDER)
    n = pages.Window.partitionBy(*page)
    df = df.withColumn("total", (F.col("pos") == F.count("*").over(n)) & (F.col("l_orderkey") % 3 == 0))
    flat = lambda said: F.when(k % 47 == 0, "25").otherwise(said)
    index = F.when(F.col("total"), "Mez").when((F.col("pos") > 1) & (k % 5 == 0), "»").when(k % 23 == 0, "xx").otherwise(F.when((k % 37 == 0) & (F.col("pos") > 1), F.col("pos") - 1).otherwise(F.col("pos")).cast("string"))
    pressure = F.format_string("%.2f", F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(10_000)) / 100)
    level = F.when(F.col("l_quantity") >= 20, F.format_string("%.2f", F.col("l_quantity") + 0.25)).when(k % 6 == 0, F.format_string("%.0f", F.col("l_quantity") * 10 + 4)).otherwise(F.format_string("%.2f", F.col("l_quantity") / 100))
    tmax, tmin = 20 + s % 10, 10 + k % 5
    tmean = F.format_string("%.1f", (tmax + tmin) / 2 + (k % 17 == 0).cast("int"))
    rain = F.when(k % 3 == 0, "null").otherwise((k % 3).cast("string"))
    wind = F.when(k % 59 == 0, "null").otherwise(F.format_string("%.0f", F.col("l_tax") * 100))
    cloud = F.format_string("%.0f", F.col("l_discount") * 100)
    side = F.element_at(F.array(*map(F.lit, ("N", "NE", "SSE", "X9", "NW, S"))), (s % 5 + 1).cast("int"))
    raw = F.concat_ws(" | ", index, *map(flat, (pressure, level, tmax.cast("string"), tmin.cast("string"), tmean, rain, wind, cloud)), side)
    fixed = F.when(k % 47 == 0, 25.0).otherwise((tmax + tmin) / 2)
    corrections = F.when(k % 53 == 0, F.create_map(F.lit("tmean"), fixed.cast("double")))
    df = df.select(*page, "pos", raw.alias("raw"), F.when(s % 4 != 0, s % 5 * 300).alias("altitude"), F.date_format("l_shipdate", "yyyy-MM").alias("period"), corrections.alias("corrections"))
    out = rejudged(df, station_sheet(years), page, "pos", 1 + F.col("l_orderkey") % 7, altitude=F.col("altitude"), period=F.col("period"), span=(F.lit("1993-01"), F.lit("1997-12")), corrections=F.col("corrections"))
    j = F.col("judged")
    said = lambda c: F.array_join(j[c], ",").alias(c)
    return out.select(*page, "pos", *[j["values"][c].alias(c) for c in ("line", "pressure", "level", "tmean")], *[j[c].alias(c) for c in ("is_day", "complete", "verdict")], *map(said, ("problems", "violations", "failures", "totals", "corrected")))


@query(judgement_sql(False))
def rejudge_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of days: duplicates are told by their neighbours."""
    return judged_lines(spark, sf_dir, False)


@query(judgement_sql(True))
def rejudge_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose index is no day: what the page's sequence gives is filled."""
    return judged_lines(spark, sf_dir, True)

"""Registered queries of guards, agreement, ranges, training rows and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.functions import captions, parse, replies
from rowproof.operators import checks, evaluate, govern, pages, publish, reading, records, reports

from .judgement_queries import station_sheet
from .queries import LINES, lines, query, second_read, table


@query("SELECT p_partkey, CAST(p_size % 6 + 2 AS INTEGER) AS cells FROM part")
def pipe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of rows as read, with pipes around some of them."""
    k = F.col("p_partkey")
    raw = F.concat(F.when(k % 3 == 0, "| ").otherwise(""), F.array_join(F.array_repeat(F.col("p_brand"), (F.col("p_size") % 6 + 2).cast("int")), " | "), F.when(k % 2 == 0, " |  ").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", parse.cell_count(raw).alias("cells"))


@query("""
WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k AS l_orderkey, CASE WHEN k % 6 < 4 THEN n END AS n_rows, CASE k % 6 WHEN 4 THEN (n + 1) || ' rows, expected ' || n WHEN 5 THEN 'no valid JSON value found' END AS error FROM n
""")
def reply_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with a table each: one of another number of rows is refused."""
    k = F.col("l_orderkey") % 6
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = F.array_join(F.array_repeat(F.lit('{"day": 1}'), (F.col("n") + F.when(k == 4, 1).otherwise(0)).cast("int")), ", ")
    body = F.concat(F.lit('{"rows": ['), rows, F.lit("]}"))
    said = F.when(k == 5, "I cannot read this page.").when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit('{"rows": [1]} '), body)).otherwise(body)
    df = df.select("l_orderkey", replies.counted(said, "rows array<struct<day: int>>", "rows", F.col("n")).alias("v"))
    return df.select("l_orderkey", F.when(F.col("v.value").isNotNull(), F.size("v.value.rows").cast("long")).alias("n_rows"), "v.error")


@query(f"SELECT l_orderkey, pos, CASE WHEN l_partkey % 4 < 2 THEN l_quantity END AS value, CASE l_partkey % 4 WHEN 2 THEN 'day ' || (pos + 1) || ', expected ' || pos WHEN 3 THEN 'day none, expected ' || pos END AS error FROM ({LINES})")
def reply_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read again: a reply that reports another day is refused."""
    k, p = F.col("l_partkey") % 4, F.col("pos")
    row = lambda day: F.format_string('{"day": %d, "v": %.2f}', day, F.col("l_quantity"))
    said = F.when(k == 0, row(p)).when(k == 1, F.concat(row(p + 1), F.lit("\n"), row(p))).when(k == 2, row(p + 1)).otherwise('{"v": 3.5}')
    df = lines(spark, sf_dir).select("l_orderkey", "pos", replies.of_day(said, "day long, v double", "day", p).alias("v"))
    return df.select("l_orderkey", "pos", F.col("v.value.v").alias("value"), "v.error")


@query(f"""
WITH r AS (
    SELECT l_orderkey, pos, l_partkey % 3 <> 0 AS legal, l_partkey % 47 = 0 AS flat, l_suppkey % 7 = 0 AS hard, CASE WHEN l_partkey % 47 = 0 THEN 725 ELSE 700 + (CAST(round(l_extendedprice * 100) AS BIGINT) % 10000) / 100.0 END AS p FROM ({LINES})
)
SELECT l_orderkey, count_if(pos <= 3 AND (legal OR NOT hard AND p BETWEEN 705 AND 790 AND NOT flat)) >= 2 AS passes FROM r GROUP BY 1
""")
def preflight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which two of the first three rows can be rows, with or without a legible index."""
    sheet, k, s = station_sheet(True), F.col("l_partkey"), F.col("l_suppkey")
    cents = F.format_string("%.2f", F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(10_000)) / 100)
    flat = F.when(k % 47 == 0, "25")
    other = [flat.otherwise(x) for x in ("30", "7", "8", "9", "1", "2", "4")]
    raw = F.concat_ws(" | ", F.when(k % 3 != 0, F.col("pos").cast("string")).otherwise("18"), flat.otherwise(cents), F.when(s % 7 == 0, "??").otherwise(other[0]), *other[1:], F.lit("N"))
    df = parse.parse_rows(lines(spark, sf_dir).select("l_orderkey", "pos", raw.alias("raw")), sheet)
    cells = F.col("parsed.cells")
    v = publish.from_printed(sheet, {c.key: cells[c.key]["txt" if c.kind == "text" else "num"] for c in sheet.columns})
    numbers = [v[c.key] for c in sheet.columns if c.kind == "number"]
    outside = F.filter(checks.range_violations(sheet, v), lambda x: x != "line")
    can = pages.plausible(v["line"], 1, 7, F.exists("parsed.problems", lambda p: ~parse.soft(p)), outside, checks.degenerate(numbers), numbers)
    return pages.preflight(df, ["l_orderkey"], "pos", can)


AGREE = f"WITH l AS ({LINES}), s AS (SELECT l_orderkey, CAST(CASE WHEN l_partkey % 19 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS q FROM l WHERE l_partkey % 29 <> 0)"


@query(AGREE + "SELECT l_orderkey, count(*) AS n_rows, count(*) AS n_cells, round(sum(q) / count(*), 6) AS agrees FROM s GROUP BY 1")
def page_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two readings of a page agree."""
    gold = lines(spark, sf_dir)
    out = evaluate.agreement(gold, second_read(gold), ["l_orderkey", "pos"], ["l_quantity"], ["l_orderkey"])
    return out.withColumn("agrees", F.round("agrees", 6))


@query("""
WITH a AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, avg(l_quantity) AS ours FROM lineitem GROUP BY ALL),
b AS (SELECT year, month, CASE WHEN month % 5 <> 0 THEN avg END AS theirs FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, avg(o_totalprice) AS avg FROM orders GROUP BY ALL))
SELECT year, month, round(ours, 6) AS ours, round(theirs, 4) AS theirs FROM a JOIN b USING (year, month) WHERE ours IS NOT NULL AND theirs IS NOT NULL
""")
def external_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of a series beside those of a published one, where both have a number."""
    by = lambda df, d, v: df.groupBy(F.year(d).alias("year"), F.month(d).alias("month")).agg(v)
    ours = by(table(spark, sf_dir, "lineitem"), "l_shipdate", F.avg("l_quantity").alias("ours"))
    theirs = by(table(spark, sf_dir, "orders"), "o_orderdate", F.avg("o_totalprice").alias("theirs")).withColumn("theirs", F.when(F.col("month") % 5 != 0, F.col("theirs")))
    out = evaluate.external_pairs(ours, theirs, ["year", "month"], "ours", "theirs")
    return out.select("year", "month", F.round("ours", 6).alias("ours"), F.round("theirs", 4).alias("theirs"))


@query(f"""
WITH c AS (SELECT l_orderkey, pos, unnest(['pressure', 'level', 'tmean', 'rain']) AS key, unnest([700 + l_quantity * 2, l_quantity, l_quantity / 2, l_tax]) AS value FROM ({LINES}))
SELECT * FROM c WHERE key = 'pressure' AND value NOT BETWEEN 705 AND 790 OR key = 'level' AND value NOT BETWEEN 20 AND 60 OR key = 'tmean' AND value NOT BETWEEN 0 AND 26
""")
def outside_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells outside the range that their layout declares."""
    q = F.col("l_quantity")
    cell = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("double").alias("value"))
    cells = lines(spark, sf_dir).select("l_orderkey", "pos", F.explode(F.array(cell("pressure", 700 + q * 2), cell("level", q), cell("tmean", q / 2), cell("rain", F.col("l_tax")))).alias("c")).select("l_orderkey", "pos", "c.*")
    return checks.outside_layout(cells, station_sheet(False).table(spark), ["key"], "value").select("l_orderkey", "pos", "key", "value")


@query("SELECT count(*) AS rows, count_if(o_orderstatus IN ('F', 'O')) AS usable, CAST(coalesce(sum(2 + CASE WHEN o_custkey % 4 <> 0 THEN 1 ELSE 0 END) FILTER (o_orderstatus IN ('F', 'O') AND o_orderkey % 3 <> 0), 0) AS BIGINT) AS values_usable FROM orders")
def published_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a published table holds: rows, usable ones, and their values."""
    s = F.col("o_orderstatus")
    df = table(spark, sf_dir, "orders").select("*", F.when(s == "F", "checks_pass").when(s == "O", "qc_clean").otherwise("flagged").alias("verdict"), F.when(F.col("o_custkey") % 4 != 0, 1).alias("some"))
    return govern.published_counts(df, "verdict", F.col("o_orderkey") % 3 != 0, ["o_orderkey", "o_totalprice", "some"])


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL ORDER BY n DESC, c_mktsegment, c_nationkey LIMIT 12")
def top_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.top_groups(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], 12)


@query("""
WITH r AS (SELECT o_orderkey, unnest(range(1, CASE o_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 0 ELSE 1 END + 1)) AS copy FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))
SELECT o_orderkey, CAST(copy AS INTEGER) AS copy, count(*) OVER () AS n FROM r
""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to train on, some repeated, shuffled by a seed; places run from 1 to their number."""
    c = F.col("o_custkey") % 4
    excluded = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    out = reports.training_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], F.when(c == 0, 4).when(c == 1, 0).otherwise(1), excluded, ["o_custkey"], "seed")
    top = out.agg(F.max("place").alias("n"), F.count_distinct("place").alias("__m")).where("n = __m").select("n")
    return out.crossJoin(F.broadcast(top)).select("o_orderkey", "copy", "n")  # one row


@query("""
WITH l AS (SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS i, sha256(o_custkey || '/' || o_orderkey || '/' || o_orderstatus || chr(10)) AS d FROM orders),
a AS (SELECT i // 4096 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM l GROUP BY 1), b AS (SELECT i // 4096 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM a GROUP BY 1)
SELECT (SELECT count(*) FROM l) AS n, CASE WHEN (SELECT count(*) FROM a) > 1 THEN (SELECT d FROM b) ELSE (SELECT min(d) FROM a) END AS sha256
""")
def manifest_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over all lines of a manifest, in order."""
    line = F.concat(F.concat_ws("/", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"), "o_orderstatus"), F.lit("\n"))
    return govern.ordered_digest(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], line)


@query("SELECT c_custkey, c_custkey % 4 < 2 AS astronomy FROM customer")
def astronomy_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of tables of sun and moon, by their terms or their first line."""
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, F.concat(F.lit(" SOL. \nMez de "), F.col("c_name"))).when(k == 1, F.concat(F.col("c_name"), F.lit(" azimuth do Sol"))).when(k == 2, F.concat(F.lit("Sol e chuva\n"), F.col("c_name"))).otherwise(None)
    return table(spark, sf_dir, "customer").select("c_custkey", captions.is_astronomy(said, ["azimuth do sol"]).alias("astronomy"))


@query("""
WITH e AS (
    SELECT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS page, CASE o_orderkey % 3 WHEN 0 THEN 'b.json' ELSE 'a.json' END AS file, o_totalprice, o_orderkey FROM orders
)
SELECT page, file, o_orderkey FROM e QUALIFY row_number() OVER (PARTITION BY page ORDER BY file, o_totalprice, o_orderkey) = 1
UNION ALL SELECT page, file, -o_orderkey FROM e QUALIFY row_number() OVER (PARTITION BY page ORDER BY file DESC, o_totalprice DESC, o_orderkey DESC) = 1
""")
def files_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in several files and several times in one, one of them without a number: the first entry, and the last."""
    k = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("page"), F.when(k % 3 == 0, "b.json").otherwise("a.json").alias("file"), F.col("o_totalprice").alias("place"), k)
    last = publish.first_file_wins(df, ["page"], "file", "place", last=True).withColumn("o_orderkey", -F.col("o_orderkey"))
    return publish.first_file_wins(df, ["page"], "file", "place").unionByName(last).select("page", "file", "o_orderkey")


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END AS page FROM orders), s AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS page FROM customer WHERE c_nationkey IN (3, 4))
SELECT o_orderkey, page, page IS NOT NULL AND page IN (SELECT page FROM s WHERE page IS NOT NULL) AS held FROM o
""")
def page_holdout_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages are held out; a row without a page never is."""
    some = table(spark, sf_dir, "customer").where("c_nationkey in (3, 4)").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("page"))
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("page"))
    learn, held = publish.held_out_pages(df, some, ["page"])
    return learn.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True))).select("o_orderkey", "page", "held")


@query("SELECT c_custkey, s FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS s FROM customer WHERE c_custkey % 3 = 0 OR c_nationkey < 2) ORDER BY s NULLS LAST, c_custkey DESC LIMIT 40")
def worst_of_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst sheets among many equal and unscored ones."""
    df = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0 or c_nationkey < 2").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("s"))
    return publish.worst(df, "s", 40, [F.desc("c_custkey")])


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN CASE p_partkey % 4 WHEN 0 THEN 'actinometry' WHEN 1 THEN NULL WHEN 2 THEN 'cloudiness' END
    WHEN p_size % 5 = 1 THEN CASE p_partkey % 4 WHEN 0 THEN 'hourly wind' ELSE 'thermometer' END WHEN p_size % 5 = 3 THEN CASE p_partkey % 4 WHEN 1 THEN NULL ELSE 'wind' END END AS layout FROM part
""")
def layout_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts by count and content: pages without rows, cells out of place, signs and points that say nothing."""
    k, n = F.col("p_partkey") % 4, F.col("p_size") % 5
    a = F.when(k == 0, F.lit("x | y | 32.5 | 5")).when(k == 1, "1 | -3 | 5").when(k == 2, "2 | Ci | 10 | C")
    b = F.when(k == 0, "1 | N | 2 | NE | 3 | S").when(k == 1, "1 | N | 2 | NE").when(k == 2, "Nada | Sul")
    d = F.when(k == 0, "9 | NE | 3 | SSE | 2 | N").when(k == 1, "9 | c | k,n | s").when(k == 2, "9 | 1 | 2 | 3")
    cells = F.when(n == 0, 16).when(n == 1, 13).when(n == 3, 15).otherwise(40)
    row = F.when(n == 0, a).when(n == 1, b).when(n == 3, d)
    rules = [(16, "decimal", "actinometry"), (16, "whole", "cloudiness"), (16, "any", None), (15, "clouds", None), (15, "any", "wind"), (13, "wind", "hourly wind"), (None, "wind", None), (13, "any", "thermometer")]
    return table(spark, sf_dir, "part").select("p_partkey", publish.assigned_layout(cells, F.array_compact(F.array(row)), rules).alias("layout"))


@query(f"""
WITH l AS ({LINES}), d AS (SELECT l_orderkey, pos - 1 AS row, CASE WHEN l_orderkey % 5 <> 0 THEN '1885-01' END AS period, CASE WHEN l_partkey % 3 <> 0 THEN CAST(l_quantity AS BIGINT) END AS a, CASE WHEN l_suppkey % 3 <> 0 THEN l_linestatus END AS b, l_orderkey % 6 AS n FROM l)
SELECT l_orderkey, row, coalesce(CAST(a AS VARCHAR), 'null') || ' | ' || coalesce(b, 'null') AS target, NULL AS reason FROM d WHERE period IS NOT NULL AND row < n AND (a IS NOT NULL OR b IS NOT NULL)
UNION ALL SELECT DISTINCT l_orderkey, NULL, NULL, CASE WHEN period IS NULL THEN 'no period recorded' ELSE 'no rows located' END FROM d WHERE period IS NULL OR n = 0
""")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows as training examples, and the pages that give none."""
    k = F.col("l_orderkey")
    labels = lines(spark, sf_dir).select("l_orderkey", (F.col("pos") - 1).alias("row"), F.when(k % 5 != 0, "1885-01").alias("period"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity").cast("long")).alias("a"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_linestatus")).alias("b"))
    located = labels.select("l_orderkey").distinct().where(k % 6 > 0).withColumn("n", k % 6)
    target = F.concat_ws(" | ", F.coalesce(F.col("a").cast("string"), F.lit("null")), F.coalesce("b", F.lit("null")))
    entries, skipped = records.manifest_entries(labels, located, ["l_orderkey"], "period", "row", ["a", "b"], target)
    none = F.lit(None)
    return entries.select("l_orderkey", "row", "target", none.cast("string").alias("reason")).unionByName(skipped.select("l_orderkey", none.cast("long").alias("row"), none.cast("string").alias("target"), "reason"))

"""Registered queries of blocks, records, variants, sheets and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.functions import captions, parse, printed, scalars
from rowproof.layout import Layout, LayoutColumn
from rowproof.operators import blocks, records
from rowproof.sources import readers

from .queries import LINES, lines, query, table

BLOCK = Layout("block", (LayoutColumn("label", "text"), LayoutColumn("baro", unit="mm", low=600, high=800), LayoutColumn("a"), LayoutColumn("b")), monthly={"aggregate": {"a": "mean", "b": "max"}, "tolerance": {"a": 12.0, "b": 1.0}})
BLOCKS = f"""
WITH l AS ({LINES}), x AS (
    SELECT l_orderkey, CASE pos WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' ELSE 'Mez' END AS label, l_partkey AS k, CAST(round(l_extendedprice * 100) AS BIGINT) % 10000 / 100.0 AS cents, l_quantity AS a, CAST(round(l_discount * 100) AS BIGINT) AS b,
        CASE WHEN l_orderkey % 11 <> 0 THEN l_orderkey % 5 * 100 END AS alt FROM l WHERE pos <= 4
), p AS (SELECT *, CASE WHEN k % 3 = 0 THEN 700 + cents ELSE cents END AS baro, 760 * exp(-alt / 8434.0) AS want FROM x),
"""


@query(BLOCKS + """
r AS (
    SELECT *, baro < 200 AND alt IS NOT NULL AS asked, list_filter(list_transform(range(10), lambda h: h * 100 + cents), lambda c: c >= want - 30 AND c < want + 30) AS fits FROM p
), v AS (
    SELECT *, CASE WHEN asked AND len(fits) = 1 THEN fits[1] ELSE baro END AS full_baro, asked AND len(fits) <> 1 AS elided FROM r
), t AS (
    SELECT l_orderkey, count_if(label <> 'Mez') AS n, avg(a) FILTER (label <> 'Mez') AS ma, max(b) FILTER (label <> 'Mez') AS mb, max(a) FILTER (label = 'Mez') AS pa, max(b) FILTER (label = 'Mez') AS pb FROM v GROUP BY 1
), m AS (
    SELECT l_orderkey, CASE WHEN n >= 3 THEN CASE WHEN abs(ma - pa) > 12 THEN 'block_arithmetic: a' WHEN abs(mb - pb) > 1 THEN 'block_arithmetic: b' END END AS broken FROM t
), d AS (
    SELECT DISTINCT x.l_orderkey, x.label FROM v x JOIN v y ON x.l_orderkey = y.l_orderkey AND x.label <> y.label AND x.label <> 'Mez' AND y.label <> 'Mez' AND abs(x.a - y.a) < 4 AND abs(x.b - y.b) < 4
)
SELECT v.l_orderkey, v.label, full_baro AS baro, concat_ws(',', CASE WHEN elided THEN 'elided_without_one_value' END, broken, CASE WHEN abs(full_baro - want) > 25 THEN 'pressure_implausible' END, CASE WHEN d.label IS NOT NULL THEN 'near_duplicate_row' END) AS problems
FROM v JOIN m USING (l_orderkey) LEFT JOIN d ON d.l_orderkey = v.l_orderkey AND d.label = v.label
""")
def block_rejudge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three rows and their total, judged as a whole."""
    out = blocks.rejudged_blocks(printed_blocks(spark, sf_dir), ["l_orderkey"], "label", "Mez", ["a", "b"], BLOCK, "baro", "alt", near=4.0)
    return out.select("l_orderkey", "label", "baro", F.array_join("problems", ",").alias("problems"))


def printed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir).where("pos <= 4")
    cents = F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(10_000)) / 100
    label = F.when(F.col("pos") == 4, "Mez").otherwise(F.col("pos").cast("string"))
    k = F.col("l_partkey")
    return df.select("l_orderkey", label.alias("label"), F.when(k % 3 == 0, 700 + cents).otherwise(cents).alias("baro"), F.col("l_quantity").alias("a"), F.round(F.col("l_discount") * 100).alias("b"), F.when(F.col("l_orderkey") % 11 != 0, F.col("l_orderkey") % 5 * 100).alias("alt"), k.alias("k"))


@query(BLOCKS + """
s AS (
    SELECT l_orderkey, abs(max(a) FILTER (label = 'Mez') - (sum(a) FILTER (label <> 'Mez')) / 3) AS a, abs(max(b) FILTER (label = 'Mez') - (sum(b) FILTER (label <> 'Mez')) / 3) AS b
    FROM p GROUP BY 1 HAVING count(*) = 4 AND count_if(k % 13 = 0) = 0 AND count_if(label = 'Mez' AND k % 2 = 0) = 1
), u AS (SELECT 'a' AS "column", list_sort(list(a)) AS v FROM s UNION ALL SELECT 'b', list_sort(list(b)) FROM s)
SELECT "column", CAST(len(v) AS BIGINT) AS n, round((v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2, 6) AS middle, round(v[CAST(least(len(v) - 1, floor(0.9 * len(v))) AS BIGINT) + 1], 6) AS at_share, round(v[-1], 6) AS most,
       round(greatest(0.05, v[CAST(least(len(v) - 1, floor(0.9 * len(v))) AS BIGINT) + 1] * 1.5), 2) AS tolerance FROM u WHERE len(v) > 0
""")
def block_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tolerance that nine in ten sound blocks bear out."""
    out = blocks.calibrated(printed_blocks(spark, sf_dir), ["l_orderkey"], "label", ["1", "2", "3"], "Mez", ["a", "b"], F.col("k") % 13 != 0, F.col("k") % 2 == 0)
    return out.select("column", "n", *[F.round(c, 6).alias(c) for c in ("middle", "at_share", "most")], "tolerance")


@query("""
WITH v AS (
    SELECT o_orderkey, 'v' || (o_custkey % 40) AS name, o_orderkey % 900 AS rows, o_orderkey % 4 AS epochs, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 1000 / 1000.0 END AS trained,
        row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey DESC) AS k FROM orders
), e AS (
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'runs/g4/v' || (p_partkey % 50) || '/epoch2' WHEN 1 THEN 'models//v' || (p_partkey % 50) || '/' WHEN 2 THEN 'v' || (p_partkey % 50) ELSE '' END AS path, CASE WHEN p_partkey % 7 <> 0 THEN p_size / 50.0 END AS acc FROM part
), parts AS (SELECT p_partkey, acc, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM e WHERE acc IS NOT NULL AND path <> ''),
named AS (SELECT p_partkey, acc, unnest(parts[-2:]) AS name, unnest(range(len(parts[-2:]))) AS place FROM parts),
found AS (SELECT name, acc FROM named QUALIFY row_number() OVER (PARTITION BY name ORDER BY p_partkey, place) = 1)
SELECT name, rows, acc AS gold_cell_acc, rpad(name, 16, ' ') || ' ' || lpad(CAST(rows AS VARCHAR), 5, ' ') || ' ' || lpad(CAST(epochs AS VARCHAR), 3, ' ') || ' ' || lpad(coalesce(printf('%.4f', acc), '—'), 11, ' ') || ' ' || lpad(coalesce(printf('%.4f', trained), '—'), 9, ' ') AS line
FROM v LEFT JOIN found USING (name) WHERE k = 1
""")
def variant_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants by one name, with the accuracy of the first file that measured them."""
    k, p = F.col("o_orderkey"), F.col("p_partkey")
    saved = F.concat(F.when(k % 3 == 0, "qwen35-lora-").when(k % 3 == 1, "qwen35-").otherwise(""), F.lit("v"), (F.col("o_custkey") % 40).cast("string"), F.when(k % 3 == 0, "-epoch2").when(k % 3 == 1, "-epoch3").otherwise(""))
    logs = table(spark, sf_dir, "orders").select(F.lpad(k.cast("string"), 12, "0").alias("file"), saved.alias("name"), (k % 900).alias("rows"), (k % 4).alias("epochs"), F.when(k % 5 != 0, k % 1000 / 1000).alias("trained"))
    v = F.concat(F.lit("v"), (p % 50).cast("string"))
    path = F.when(p % 4 == 0, F.concat(F.lit("runs/g4/"), v, F.lit("/epoch2"))).when(p % 4 == 1, F.concat(F.lit("models//"), v, F.lit("/"))).when(p % 4 == 2, v).otherwise("")
    files = table(spark, sf_dir, "part").select(F.lpad(p.cast("string"), 12, "0").alias("file"), path.alias("path"), F.when(p % 7 != 0, F.col("p_size") / 50).alias("acc"))
    out = records.variants(logs, "file", "name", records.evaluations(files, "file", "path", "acc"))
    return out.join(records.variant_lines(out, "name", "rows", "epochs", "trained"), "name").select("name", "rows", "gold_cell_acc", "line")


@query("""
WITH r AS (
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'said' END AS cap, (year(o_orderdate) - 110) || strftime(o_orderdate, '-%m') AS period, o_orderkey % 4 = 0 AS astro FROM orders
), n AS (
    SELECT *, CASE WHEN NOT astro THEN period END AS new_period, CASE WHEN NOT astro AND period NOT BETWEEN '1884' AND '1886-12' THEN 'true' ELSE 'false' END AS suspect,
        CASE WHEN k % 3 = 0 THEN '1885-01' WHEN k % 3 = 1 THEN period END AS old_period, CASE WHEN k % 5 = 0 THEN 'false' END AS old_astro, k % 3 < 2 AS has_period, k % 5 = 0 AS has_astro FROM r
)
SELECT k AS o_orderkey, CASE WHEN cap <> '' THEN concat_ws(';',
    CASE WHEN old_astro IS DISTINCT FROM CAST(astro AS VARCHAR) AND (has_astro OR astro) THEN 'astronomy:' || coalesce(old_astro, '-') || '>' || CAST(astro AS VARCHAR) END,
    CASE WHEN old_period IS DISTINCT FROM new_period AND (has_period OR new_period IS NOT NULL) THEN 'period:' || coalesce(old_period, '-') || '>' || coalesce(new_period, '-') END,
    CASE WHEN suspect = 'true' THEN 'suspect:->true' END) ELSE '' END AS changes FROM n
""")
def rederived_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of records derived again from their captions, and what moved."""
    k = F.col("o_orderkey")
    period = F.concat((F.year("o_orderdate") - 110).cast("string"), F.date_format("o_orderdate", "-MM"))
    names = F.array(*[F.lit(m[0].capitalize()) for m in scalars.MONTHS])
    caption = F.when(k % 13 == 0, "").otherwise(F.concat(F.when(k % 4 == 0, "Observações astronómicas, mez de ").otherwise("Resumo do mez de "), F.get(names, F.month("o_orderdate") - 1), F.lit(" de "), (F.year("o_orderdate") - 110).cast("string")))
    some = lambda c, key, value: F.when(c, F.create_map(F.lit(key), value.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    held = F.map_concat(some(k % 3 == 0, "period", F.lit("1885-01")), some(k % 3 == 1, "period", period), some(k % 5 == 0, "astronomy", F.lit("false")))
    df = table(spark, sf_dir, "orders").select(k, caption.alias("caption"), held.alias("record"))
    astro = captions.names_any(F.col("caption"), ["astronomicas"])
    df = df.withColumn("derived", F.struct(astro.alias("astronomy"), F.when(~astro, scalars.caption_period(F.col("caption"))).alias("period")))
    d = F.col("derived")
    new = {"astronomy": d["astronomy"], "period": d["period"], "suspect": captions.outside_span(d["period"], F.lit("1884"), F.lit("1886-12"))}
    out = records.rederived(df, "record", "caption", new)
    said = F.transform("changes", lambda c: F.concat(c["field"], F.lit(":"), F.when(c["field"] == "suspect", "").otherwise(F.coalesce(c["old"], F.lit("-"))), F.when(c["field"] == "suspect", "->").otherwise(">"), F.coalesce(c["new"], F.lit("-"))))
    return out.select("o_orderkey", F.array_join(said, ";").alias("changes"))


@query(f"""
WITH l AS ({LINES}), c AS (
    SELECT l_orderkey, '1885-01-' || lpad(CAST(pos AS VARCHAR), 2, '0') AS date, 'tmax' AS "column", l_quantity AS v FROM l UNION ALL SELECT l_orderkey, '1885-01-' || lpad(CAST(pos AS VARCHAR), 2, '0'), 'tmin', round(l_tax * 300) FROM l
    UNION ALL SELECT l_orderkey, '1885-01-' || lpad(CAST(pos AS VARCHAR), 2, '0'), 'rain', CASE WHEN l_partkey % 9 <> 0 THEN round(l_discount * 100) END FROM l
), t AS (
    SELECT l_orderkey, unnest(['tmax_mean', 'rain_sum']) AS key, unnest([25.0 + l_orderkey % 3, 10.0]) AS printed FROM (SELECT DISTINCT l_orderkey FROM l) UNION ALL SELECT l_orderkey, 'total', 1.0 FROM (SELECT DISTINCT l_orderkey FROM l WHERE l_orderkey % 7 = 0)
), s AS (SELECT l_orderkey, "column", avg(v) AS mean, sum(v) AS sum FROM c WHERE v IS NOT NULL GROUP BY ALL),
o AS (SELECT t.*, CASE WHEN key LIKE '%_mean' THEN mean ELSE sum END AS calc FROM t JOIN s ON s.l_orderkey = t.l_orderkey AND key = "column" || '_' || regexp_extract(key, '[a-z]*$'))
SELECT l_orderkey, date || ': tmax ' || TXT(a) || ' < tmin ' || TXT(b) AS message FROM (SELECT l_orderkey, date, max(v) FILTER ("column" = 'tmax') AS a, max(v) FILTER ("column" = 'tmin') AS b FROM c GROUP BY ALL) WHERE a < b
UNION ALL SELECT l_orderkey, date || ': ' || "column" || '=' || TXT(v) || ' outside physical range' FROM c WHERE "column" = 'tmax' AND v NOT BETWEEN 2 AND 45 OR "column" = 'rain' AND v NOT BETWEEN 0 AND 9
UNION ALL SELECT l_orderkey, 'printed_totals key ''total'' is malformed (expected <col>_mean or <col>_sum)' FROM t WHERE key = 'total'
UNION ALL SELECT l_orderkey, 'printed ' || key || '=' || TXT(printed) || ' but computed ' || printf('%.2f', round(calc, 2)) || ' (possible row/col shift)' FROM o WHERE abs(calc - printed) > 5
""".replace("TXT(a)", "regexp_replace(printf('%.2f', a), '[.]?0+$', '')").replace("TXT(b)", "regexp_replace(printf('%.2f', b), '[.]?0+$', '')").replace("TXT(v)", "regexp_replace(printf('%.2f', v), '[.]?0+$', '')").replace("TXT(printed)", "regexp_replace(printf('%.2f', printed), '[.]?0+$', '')"))
def sheet_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a sheet, in words."""
    df = lines(spark, sf_dir)
    k = F.col("l_orderkey")
    cell = lambda c, v: F.struct(F.lit(c).alias("column"), v.alias("v"))
    date = F.concat(F.lit("1885-01-"), F.lpad(F.col("pos").cast("string"), 2, "0"))
    cells = df.select("l_orderkey", date.alias("date"), F.explode(F.array(cell("tmax", F.col("l_quantity")), cell("tmin", F.round(F.col("l_tax") * 300)), cell("rain", F.when(F.col("l_partkey") % 9 != 0, F.round(F.col("l_discount") * 100))))).alias("c")).select("l_orderkey", "date", "c.*")
    total = lambda key, v: F.struct(F.lit(key).alias("key"), v.cast("double").alias("printed"))
    totals = df.select("l_orderkey").distinct().select("l_orderkey", F.explode(F.array_compact(F.array(total("tmax_mean", 25 + k % 3), total("rain_sum", F.lit(10.0)), F.when(k % 7 == 0, total("total", F.lit(1.0)))))).alias("t")).select("l_orderkey", "t.*")
    return records.sheet_violations(cells, ["l_orderkey"], "date", "column", "v", {"tmax": (2, 45), "rain": (0, 9)}, ("tmax", "tmin"), totals, 5.0)


SCORED = "SELECT o_orderkey AS k, o_orderkey % 40 + 10 AS n_cells, o_custkey % 21 / 20.0 AS cell_acc, o_custkey % 7 / 10.0 AS structural_err_rate, o_orderkey % 5 / 4.0 AS flagged_recall, o_orderkey % 9 AS flagged_cells, o_orderkey % 40 + 15 AS total_cells, o_custkey % 13 <> 0 AS ok, o_custkey % 3 = 0 AS gold, strftime(o_orderdate, '%Y-%m') AS period FROM orders"


def scored_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), (k % 40 + 10).alias("n_cells"), (c % 21 / 20).alias("cell_acc"), (c % 7 / 10).alias("structural_err_rate"), (k % 5 / 4).alias("flagged_recall"), (k % 9).alias("flagged_cells"),
        (k % 40 + 15).alias("total_cells"), (c % 13 != 0).alias("ok"), (c % 3 == 0).alias("gold"), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
    )


@query(f"""
WITH s AS ({SCORED}), r AS (SELECT *, round_even(n_cells * (1 - cell_acc), 0) AS wrong, round_even(n_cells * (1 - cell_acc) * flagged_recall, 0) AS caught FROM s WHERE ok)
SELECT (SELECT count(*) FROM s) AS n_sheets, count(*) AS n_sheets_scored, (SELECT count(*) FROM s) - count(*) AS n_sheets_errored, round(sum(n_cells * cell_acc) / sum(n_cells), 6) AS cell_acc, round(avg(structural_err_rate), 6) AS structural_err_rate,
    round(avg(flagged_recall), 6) AS flagged_recall_macro, round(sum(caught) / sum(wrong), 6) AS flagged_recall_micro, round(sum(flagged_cells) / sum(total_cells), 6) AS fraction_flagged, CAST(sum(n_cells) AS BIGINT) AS n_cells_total, CAST(sum(wrong) AS BIGINT) AS total_wrong_cells, CAST(sum(caught) AS BIGINT) AS total_flagged_wrong_cells FROM r
""")
def scored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.rolled_up(scored_sheets(spark, sf_dir), F.col("ok"))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"""
WITH s AS (SELECT *, CASE WHEN ok THEN cell_acc END AS acc FROM ({SCORED}))
SELECT count(*) AS n_tables, count_if(gold) AS n_gold, count_if(NOT gold) AS n_fresh, min(period) || '..' || max(period) AS year_span, CAST(sum(flagged_cells) AS BIGINT) AS total_flagged_suspects, CAST(sum(total_cells) AS BIGINT) AS total_zoom_suspects,
    round(sum(acc * n_cells) FILTER (gold AND acc IS NOT NULL) / sum(n_cells) FILTER (gold AND acc IS NOT NULL), 6) AS gold_cell_acc_micro FROM s
""")
def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_sheets(spark, sf_dir).withColumn("cell_acc", F.when(F.col("ok"), F.col("cell_acc")))
    out = records.corpus(s, F.col("gold"), "period", "flagged_cells", "total_cells")
    return out.withColumn("gold_cell_acc_micro", F.round("gold_cell_acc_micro", 6))


@query(f"""
WITH l AS ({LINES}), c AS (
    SELECT l_orderkey, l_quantity AS q, CASE WHEN l_partkey % 10 = 0 THEN l_quantity + 1 WHEN l_partkey % 10 = 1 THEN NULL ELSE l_quantity END AS rq, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_tax END AS t, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_tax END AS rt FROM l
)
SELECT l_orderkey, count(*) AS n_rows, count(*) * 2 AS n_cells, round(sum(CASE WHEN q = rq THEN 1 ELSE 0 END + CASE WHEN t = rt OR t IS NULL AND rt IS NULL THEN 1 ELSE 0 END) / (count(*) * 2), 4) AS cell_acc FROM c GROUP BY 1
""")
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, q, t = F.col("l_partkey") % 10, F.col("l_suppkey"), F.col("l_quantity"), F.col("l_tax")
    read = {"q": F.when(p == 0, q + 1).when(p != 1, q), "t": F.when(s % 4 != 0, t)}
    return records.page_accuracy(table(spark, sf_dir, "lineitem"), ["l_orderkey"], {"q": q, "t": F.when(s % 6 != 0, t)}, read)


@query("""
WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) % 10000 / 100.0 AS a, CASE WHEN o_custkey % 6 <> 0 THEN o_custkey % 100 / 1.0 END AS b FROM orders)
SELECT o_orderkey, 700 + a AS a, CASE WHEN b >= 50 THEN 600 + b WHEN b < 20 THEN 700 + b ELSE b END AS b, CASE WHEN b >= 20 AND b < 50 THEN 'b' ELSE '' END AS flags FROM c
""")
def barometers_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barometer columns of a table with their hundreds; digits that fit none are flagged."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.pmod(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(10_000)) / 100).alias("a"), F.when(F.col("o_custkey") % 6 != 0, F.col("o_custkey") % 100 / 1).alias("b"))
    out = records.restored_barometers(df, {"a": (700.0, 800.0), "b": (650.0, 720.0)}, scalars.restore_hundreds)
    return out.select("o_orderkey", "a", "b", F.array_join("flags", ",").alias("flags"))


@query("""
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 80 + s_suppkey % 60 / 60.0 AS deg FROM supplier)
SELECT 'posto_' || k AS id, k % 9 = 0 AS moves, CASE WHEN k % 9 <> 0 AND k % 4 <> 0 THEN round(-deg, 4) END AS lat, CASE WHEN k % 9 <> 0 AND k % 4 = 0 THEN round(nullif(deg, 0), 4) END AS lat_magnitude, k % 9 <> 0 AND k % 4 = 0 AS hemisphere_missing, CAST(k % 300 AS INTEGER) AS alt FROM s
""")
def printed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations from their headings; a coordinate without its hemisphere is a magnitude."""
    k = F.col("s_suppkey")
    angle = F.concat((k % 80).cast("string"), F.lit("°"), (k % 60).cast("string"), F.lit("'"))
    lat = F.when(k % 9 == 0, "Var.").when(k % 4 == 0, angle).otherwise(F.concat(F.lit("S "), angle))
    line = F.concat(F.lit("Estação de Posto "), k.cast("string"), F.lit("; Latit., "), lat, F.lit("; Longitude, 3° E; Alt. do bar., "), (k % 300).cast("string"), F.lit(" m"))
    heads = table(spark, sf_dir, "supplier").select(line.alias("line"))
    out = records.station_registry(heads, captions.header_fields(F.col("line")), captions.slug)
    return out.select("id", "moves", "lat", "lat_magnitude", "hemisphere_missing", "alt")


@query(f"SELECT l_orderkey, strftime(l_shipdate, '%Y-%m') || '-' || lpad(CAST(pos + 26 AS VARCHAR), 2, '0') AS date FROM ({LINES})")
def assembled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("l_orderkey", records.iso_dates(F.date_format("l_shipdate", "yyyy-MM"), F.col("pos") + 26).alias("date"))


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS item, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE CAST(o_orderkey % 3 AS INTEGER) END AS page FROM orders UNION SELECT DISTINCT CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'None' END, 1 FROM customer")
def produced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 3).alias("page"))
    b = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")).alias("item"), F.lit(1).alias("page"))
    return records.pages_produced([a, b], "item", "page")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN '(no station named)' ELSE substr('Posto de ' || translate(c_name, '#0123456789', ''), 1, 48) END AS station FROM customer")
def station_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, plain = F.col("c_custkey"), F.regexp_replace("c_name", "[#0-9]", "")
    head = F.when(k % 4 == 0, "Revista do  Observatório 12 ").when(k % 4 == 1, "Resumo das observações meteorologicas feitas em ").when(k % 4 == 2, "Observations météorologiques du mois d'avril 1885 ").otherwise("Revista do observatorio")
    return table(spark, sf_dir, "customer").select("c_custkey", records.station_group(F.when(k % 4 == 3, head).otherwise(F.concat(head, F.lit("Posto de "), plain))).alias("station"))


@query(f"""
WITH l AS ({LINES}), v AS (SELECT l_orderkey, pos, l_quantity AS q, round(l_discount * 100) AS d, CASE WHEN l_partkey % 3 <> 0 THEN 'SE' END AS dir, l_partkey % 4 AS cut FROM l)
SELECT l_orderkey, pos, CASE WHEN cut = 3 THEN NULL ELSE q END AS pressure, CASE WHEN cut = 2 THEN NULL ELSE d END AS ozone, CASE WHEN cut < 2 THEN dir END AS wind_dir,
    CASE cut WHEN 1 THEN '' WHEN 2 THEN '13 tokens, expected 14' WHEN 3 THEN '15 tokens, expected 14 (extra ignored),pressure: unparsable ''x1''' ELSE '' END AS problems FROM v
""")
def row_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of fourteen columns written and read again, some cut short or too long."""
    q, d = F.col("l_quantity"), F.round(F.col("l_discount") * 100)
    cut = F.col("l_partkey") % 4
    direction = F.when((F.col("l_partkey") % 3 != 0) & (cut < 2), "SE")
    raw = printed.row_target({c: d if c == "ozone" else q for c in printed.COLUMNS}, direction)
    raw = F.when(cut == 2, F.regexp_replace(raw, r" \| [^|]*$", "")).when(cut == 3, F.concat(F.lit("x1"), F.regexp_replace(raw, r"^[^|]*", " "), F.lit(" | 7"))).otherwise(raw)
    df = lines(spark, sf_dir).select("l_orderkey", "pos", raw.alias("raw")).withColumn("p", printed.row_parsed(F.col("raw")))
    return df.select("l_orderkey", "pos", "p.cells.pressure", "p.cells.ozone", "p.wind_dir", F.array_join("p.problems", ",").alias("problems"))


PRINTED_ROWS = f"WITH l AS ({LINES}) SELECT l_orderkey, pos, CAST(pos AS INTEGER) AS day, l_quantity AS tmax, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 'NE' END AS wind_dir, {{sun}} AS evap_sol, {{shade}} AS evap_sombra, 0 AS n_problems FROM l"
SUN, SHADE = "CASE WHEN l_suppkey % 4 <> 0 THEN round(l_tax * 100) END", "CASE WHEN l_suppkey % 3 <> 0 THEN round(l_discount * 100) END"


def printed_rows(spark: SparkSession, sf_dir: str, of: Layout) -> DataFrame:
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    values = {c: F.col("l_quantity") for c in printed.COLUMNS} | {"day": F.col("pos"), "wind_dir": F.when(k % 3 != 0, "NE"), "evap_sol": F.when(s % 4 != 0, F.round(F.col("l_tax") * 100)), "evap_sombra": F.when(s % 3 != 0, F.round(F.col("l_discount") * 100))}
    df = parse.parse_rows(lines(spark, sf_dir).select("l_orderkey", "pos", printed.printed_target(values, of).alias("raw")), of)
    v = printed.printed_values(F.col("parsed.cells"), of)
    return df.select("l_orderkey", "pos", *[v[c].alias(c) for c in ("day", "tmax", "wind_dir", "evap_sol", "evap_sombra")], F.size("parsed.problems").alias("n_problems"))


@query(PRINTED_ROWS.format(sun=SUN, shade=SHADE))
def printed_rows_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed order with two evaporations."""
    return printed_rows(spark, sf_dir, printed.A)


@query(PRINTED_ROWS.format(sun="CAST(NULL AS DOUBLE)", shade=f"coalesce({SHADE}, {SUN})"))
def printed_rows_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed order with one evaporation, of the shade where there is one."""
    return printed_rows(spark, sf_dir, printed.B)


@query(f"SELECT l_orderkey, pos, CASE l_partkey % 4 WHEN 0 THEN pos WHEN 1 THEN pos * 10 + 3 END AS day FROM ({LINES})")
def first_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day that a row's first cell says; a mark or a rule says none."""
    k, p = F.col("l_partkey") % 4, F.col("pos").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" ·."), p, F.lit(" | 29.5"))).when(k == 1, F.concat(p, F.lit("3a | 1"))).when(k == 2, F.concat(F.lit("Mez | "), p)).otherwise(None)
    return lines(spark, sf_dir).select("l_orderkey", "pos", printed.first_printed_int(raw).alias("day"))


def measured(contents: list[bytes]) -> list[str]:
    """A reader for the query below: it says how many bytes a content has, and fails on some."""
    if any(len(c) % 97 == 0 for c in contents):
        raise ValueError("unreadable")
    return [str(len(c)) for c in contents]


@query("SELECT doc_id, CASE WHEN n % 97 <> 0 THEN CAST(n AS VARCHAR) END AS text, CASE WHEN n % 97 = 0 THEN 'ValueError: unreadable' END AS error FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)")
def read_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of documents through a reader that fails on some of them."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return readers.read(df, ["doc_id"], "content", lambda: measured)

"""Micro-fixtures of the operators that publish."""

import hashlib

from pyspark.sql import functions as F

from rowproof.layout import Layout, LayoutColumn
from rowproof.operators import evaluate, merge, publish, series


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_altitude_restored(spark):
    df = spark.createDataFrame([(56.22, 26.0), (58.83, 26.0), (57.03, 26.0), (98.5, 735.0), (10.0, 26.0), (56.22, None), (756.0, 26.0)], "v double, alt double")
    got = [tuple(r.r) for r in df.select(publish.altitude_restored(F.col("v"), F.col("alt")).alias("r")).collect()]
    assert got == [(756.22, False), (758.83, False), (757.03, False), (698.5, False), (10.0, True), (56.22, False), (756.0, False)]


def test_printed_and_back(spark):
    layout = Layout("x", (LayoutColumn("a", elided=True), LayoutColumn("b")))
    df = spark.createDataFrame([(742.03, 1.0), (95.72, 200.0), (None, None)], "a double, b double")
    v = {c: F.col(c) for c in "ab"}
    assert [tuple(r) for r in df.select(*publish.from_printed(layout, v).values()).collect()] == [(742.03, 1.0), (795.72, 200.0), (None, None)]
    assert [tuple(r) for r in df.select(*publish.to_printed(layout, v).values()).collect()] == [(42.03, 1.0), (95.72, 200.0), (None, None)]


def test_cloud_forms(spark):
    said = ["9 | 6 | C,C-K,N | 10 | K | C-K", "9 | NE | 3 | SSE | 2 | C", "9 | C | N | K", None, ""]
    df = spark.createDataFrame([(x,) for x in said], "r string")
    assert [r[0] for r in df.select(publish.cloud_forms(F.col("r"))).collect()] == [True, False, False, False, False]


def test_flagged_recall(spark):
    gold = spark.createDataFrame([(1, "a", 1.0, 1.0)], "s int, d string, tmax double, tmin double")
    read = spark.createDataFrame([(1, "a", 99.0, 99.0, True, None)], "s int, d string, tmax double, tmin double, f_tmax boolean, f_tmin boolean")
    score = lambda r: tuple(publish.flagged_recall(gold, r, ["s"], ["d"], ["tmax", "tmin"], "f_").first())
    assert score(read) == (1, 2, 2, 1, 0.5) and score(read.where("false")) == (1, 2, 2, 0, 0.0)
    assert score(read.withColumns({"tmax": F.lit(1.0), "tmin": F.lit(1.0)})) == (1, 2, 0, 0, 0.0)


def test_document_order(spark):
    rows = [("16", 1, None, "2", "p"), ("8", 2, None, "Mez.", "p"), ("8", 2, None, "3", "p"), ("14", 1, 1, "1", "p"), ("14", 1, 0, "9", "p"), ("b", 1, 0, "1", "p"), ("14", 1, 0, "9", "a"), (None, 1, 0, "x", "p")]
    df = spark.createDataFrame(rows, "item string, page int, block int, row string, layout string")
    got = [tuple(r) for r in publish.page_first(df, "item", "page", "block", "row", "layout").collect()]
    assert [r for r in got if r[0]] == [rows[i] for i in (2, 1, 6, 4, 3, 0, 5)]
    assert [one(spark, publish.row_ordinal(F.lit(x))) for x in ("1", "Mez", "Dec.", "31", "-1")] == [1, 99, 98, 31, -1] and one(spark, publish.row_ordinal(F.lit(None).cast("string"))) == -1


def test_summarised_and_series(spark):
    df = spark.createDataFrame([(1, "checks_pass", 1.0, None, True), (1, "qc_clean", 2.0, 3.0, False), (2, "flagged", 4.0, 5.0, True)], "page int, verdict string, a double, b double, day boolean")
    got = publish.summarised(df, ["page"], "verdict", [F.col("a"), F.col("b")], F.col("day")).first()
    assert tuple(got) == (2, 3, 1, 1, 1, 2, 1)
    assert tuple(publish.summarised(df.where("false"), ["page"], "verdict", [F.col("a")], F.col("day")).first()) == (0,) * 7
    long = publish.long_form(df.withColumn("layout", F.lit("L")), [("L", "a", "p", "mean", "mmHg", 7, "p"), ("L", "b", "rr", "sum", "", None, "day"), ("M", "a", "x", "x", "", 1, "x")], "layout", ["page"], "verdict")
    assert sorted(tuple(r)[:4] + (r.value,) for r in long.collect()) == sorted([(1, "", "p", "mean", 1.333), (1, "", "p", "mean", 2.666), (1, "", "rr", "sum", 3.0), (2, "uncertain", "p", "mean", 5.333), (2, "uncertain", "rr", "sum", 5.0)])


def test_small_ones(spark):
    assert one(spark, publish.windows(F.array(*map(F.lit, range(4))), 3)) == [[0, 1, 2], [1, 2, 3]] and one(spark, publish.windows(F.array(F.lit(1)), 3)) == []
    names = ["qwen35-lora-smoke4-epoch2", "smoke4", "qwen35-x", "plain-epoch9"]
    assert [one(spark, publish.variant_name(F.lit(n))) for n in names] == ["smoke4", "smoke4", "x", "plain-epoch9"]
    assert one(spark, publish.entry_id(F.lit("p"), F.lit(8), F.lit(3), F.lit("Mez"))) == "p/8/3/Mez"
    rows = spark.createDataFrame([(8, 2, 1, "aa"), (8, 1, 2, "bb")], "doc int, page int, day int, sha string")
    want = hashlib.sha256(b"8/1/2/bb\n8/2/1/aa\n").hexdigest()
    assert publish.group_digest(rows, ["doc"], ["page", "day"], ["doc", "page", "day", "sha"]).first().digest == want
    texts = spark.createDataFrame([(1, "N", 1), (1, "S", 2), (1, "S", 3), (1, "N", 4), (1, "", 5), (1, None, 6), (2, "E", 1)], "k int, t string, o int")
    assert sorted(map(tuple, publish.most_common(texts, ["k"], "t", "o").collect())) == [(1, "N"), (2, "E")]
    kept, lost = publish.dropped(rows, spark.createDataFrame([(8, 1), (9, 9)], "doc int, page int"), ["doc", "page"])
    assert [r.page for r in kept.collect()] == [2] and sorted(map(tuple, lost.collect())) == [(8, 1, 1), (9, 9, 0)]


def test_enriched_takes_the_last_entry(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "own", "page")], "k int, station string, source string")
    registry = spark.createDataFrame([(1, 1, "b", "x"), (1, 2, "a", "y"), (2, 1, "c", "z")], "k int, n int, station string, source string")
    got = sorted(map(tuple, merge.enriched(rows, registry, ["k"], "station", "source", F.col("station").isNotNull(), ["n"]).collect()))
    assert got == [(1, "a", "y", True), (2, "own", "page", False)]


def test_values_at_places_of_groups_over_many_parts(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(None if k % 3 == 0 else k % 3, float(v)) for k, v in enumerate(rng.integers(0, 50, 400))] + [(7, 1.0), (8, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    got = {r.k: (r.value, r.n) for r in series.value_at_share(df, ["k"], "v", 0.9).collect()}
    for k in (None, 1, 2, 7):
        v = sorted(x for a, x in rows if a == k and x is not None)
        assert got[k] == (v[min(len(v) - 1, int(0.9 * len(v)))], len(v))
    assert 8 not in got and series.median(df, "v", "m").first().m == np.median([x for _, x in rows if x is not None])
    assert series.median(df.where("false"), "v", "m").count() == 0


def test_month_checks_by_column(spark):
    days = spark.createDataFrame([(1, 1.0, 5.0), (1, None, 7.0), (1, 0.6, 6.0)], "p int, rr double, t double")
    printed = spark.createDataFrame([(1, 1.6, 6.3)], "p int, rr double, t double")
    how = {"rr": "sum", "t": "mean"}
    got = lambda **kw: {r.column: r.passes for r in evaluate.aggregate_checks(days, printed, ["p"], how, **kw).collect()}
    assert got() == {"rr": None, "t": False} and got(blank_is_zero=True, tolerance={"t": 0.5}) == {"rr": True, "t": True}

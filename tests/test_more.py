"""Guards, agreement, training rows, digests and files on small fixtures."""

import hashlib

from pyspark.sql import functions as F

from rowproof.functions import captions, parse, replies
from rowproof.operators import checks, evaluate, govern, pages, publish, reading, records, reports, series
from rowproof.plans.judgement_queries import station_sheet
from rowproof.sources import files, manifests


def test_cell_counts(spark):
    said = {"| 1 | 2 |": 2, "1 | 2": 2, " || 3 | | 4 ": 3, "": 1, None: 1}
    df = spark.createDataFrame([(k,) for k in said], "r string")
    assert [r.n for r in df.select(parse.cell_count(F.col("r")).alias("n")).collect()] == list(said.values())


def test_guards_refuse_what_was_not_asked_for(spark):
    df = spark.createDataFrame([('{"rows": [1, 2]}', 2), ('{"rows": [1]}', 2), ('{"rows": []}\n{"rows": [1, 2]}', 2), ("no", 2), (None, 2), ('{"other": 1}', 2)], "r string, n int")
    got = [r.v for r in df.select(replies.counted(F.col("r"), "rows array<int>", "rows", F.col("n")).alias("v")).collect()]
    assert [v.value and v.value.rows for v in got] == [[1, 2], None, [1, 2], None, None, None]
    assert [v.error for v in got][:2] == [None, "1 rows, expected 2"] and got[3].error == got[4].error == "no valid JSON value found" and got[5].error
    df = spark.createDataFrame([('{"day": 3}', 3), ('{"day": 4}', 3), ("{}", 3)], "r string, n int")
    assert [r.v.error for r in df.select(replies.of_day(F.col("r"), "day int", "day", F.col("n")).alias("v")).collect()] == [None, "day 4, expected 3", "day none, expected 3"]


def test_agreement_and_pairs(spark):
    a = spark.createDataFrame([(1, 1, 1.0, None), (1, 2, 2.0, 2.0), (2, 1, 3.0, 3.0)], "p int, d int, x double, y double")
    b = spark.createDataFrame([(1, 1, 1.004, None), (1, 2, 2.1, 2.0), (3, 1, 0.0, 0.0)], "p int, d int, x double, y double")
    assert [(r.p, r.n_rows, r.n_cells, r.agrees) for r in evaluate.agreement(a, b, ["p", "d"], ["x", "y"], ["p"]).collect()] == [(1, 2, 4, 0.75)]
    assert evaluate.agreement(a, b, ["p", "d"], ["x"], []).first().agrees == 0.5
    s = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 4.0)], "m int, v double")
    t = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (4, None)], "m int, w int")
    assert [tuple(r) for r in evaluate.external_pairs(s, t, ["m"], "v", "w").collect()] == [(1, 1.0, 5.0)]


def test_plausible_rows(spark):
    df = spark.createDataFrame([(5.0, True, ["a"], True, None), (99.0, False, [], False, 1.0), (99.0, True, [], False, 1.0), (None, False, ["a"], False, 1.0), (None, False, [], True, 1.0), (None, False, [], False, None)], "i double, hard boolean, viol array<string>, flat boolean, x double")
    got = df.select(pages.plausible(F.col("i"), 1, 31, F.col("hard"), F.col("viol"), F.col("flat"), [F.col("x")]).alias("ok")).collect()
    assert [r.ok for r in got] == [True, True, False, False, False, False]


def test_ranges_of_layouts(spark):
    cells = spark.createDataFrame([("pressure", 705.0), ("pressure", 704.9), ("tmax", 1e9), ("other", 1.0), ("level", None)], "key string, value double")
    assert [tuple(r)[:2] for r in checks.outside_layout(cells, station_sheet(False).table(spark), ["key"], "value").collect()] == [("pressure", 704.9)]


def test_training_rows(spark):
    df = spark.range(40).withColumn("page", F.col("id") % 8)
    out = spark.createDataFrame([(3,), (3,), (None,)], "page long")
    make = lambda seed, most=None: [(r.id, r.copy) for r in reports.training_rows(df.repartition(5), ["id"], F.when(F.col("id") < 8, 3).otherwise(1), out, ["page"], seed, most).orderBy("place").collect()]
    every = make("a")
    assert len(every) == len(set(every)) == 35 + 2 * 7 and all(i % 8 != 3 for i, _ in every)
    assert make("a") == every != make("b") and sorted(make("b")) == sorted(every) != every and make("a", 10) == every[:10]


def test_numbers_by_ranges(spark):
    df = spark.createDataFrame([(k, i % 17) for k in (None, 1, 2) for i in range(50 if k == 1 else 3)], "k int, v int").repartition(6)
    got = series.numbered(df, ["k"], ["v"], "n").collect()
    for k in (None, 1, 2):
        rows = sorted((r.n, r.v) for r in got if r.k == k)
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1)) and [v for _, v in rows] == sorted(v for _, v in rows)
    assert series.numbered(df.where("false"), ["k"], ["v"], "n").count() == 0


def test_ordered_digest(spark):
    sha = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    for n, run in ((0, 4), (1, 4), (4, 4), (5, 4), (70, 4)):
        now = [sha(f"line {i}\n") for i in range(n)]
        while len(now) > 1:
            now = [sha(*now[i : i + run]) for i in range(0, len(now), run)]
        got = govern.ordered_digest(spark.range(n).repartition(3), ["id"], F.concat(F.lit("line "), F.col("id").cast("string"), F.lit("\n")), run).collect()
        assert [(r.n, r.sha256) for r in got] == ([(n, now[0])] if n else [])


def test_astronomy(spark):
    said = {"SOL.\nmez de Julho": True, " lua :": True, "Sol e chuva": False, "tempo\nsol": False, "Passagem de Vénus": True, "": False, None: False}
    df = spark.createDataFrame([(k,) for k in said], "c string")
    assert [r.a for r in df.select(captions.is_astronomy(F.col("c"), ["venus"]).alias("a")).collect()] == list(said.values())


def test_files_of_a_pattern(spark, tmp_path):
    for name, rows in {"a": [(1, "x"), (1, "y"), (2, "z")], "b": [(1, "w"), (3, "v")]}.items():
        (tmp_path / f"found-{name}.json").write_text("".join(f'{{"page": {p}, "v": "{v}"}}\n\n' for p, v in rows))
    df = files.read_listed(spark, str(tmp_path / "found-*.json"), "page int, v string").where("page is not null")
    held = lambda last: {r.page: r.v for r in publish.first_file_wins(df, ["page"], "file", "place", last).collect()}
    assert held(False) == {1: "x", 2: "z", 3: "v"} and held(True) == {1: "w", 2: "z", 3: "v"}


def test_top_groups(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",)], "k string")
    assert [tuple(r) for r in reading.top_groups(df, ["k"], 2).collect()] == [("b", 2), ("c", 2)]


def test_training_manifests(spark, tmp_path):
    labels = spark.createDataFrame([("a", 1, 0, "1885-01", "x", None), ("a", 1, 1, "1885-01", "", None), ("a", 1, 2, "1885-01", "y", "z"), ("a", 2, 0, None, "x", "x"), ("b", 1, 0, "1885-01", "x", "x"), ("b", 2, 0, "", "x", "x")], "doc string, page int, row int, period string, u string, v string")
    located = spark.createDataFrame([("a", 1, 2), ("a", 2, 5)], "doc string, page int, n int")
    entries, skipped = records.manifest_entries(labels, located, ["doc", "page"], "period", "row", ["u", "v"], F.concat_ws("|", "u", "v"))
    assert [(r.doc, r.page, r.row, r.target) for r in entries.collect()] == [("a", 1, 0, "x")]
    assert sorted(map(tuple, skipped.collect())) == [("a", 2, "no period recorded"), ("b", 1, "no rows located"), ("b", 2, "no period recorded")]
    every, _ = records.manifest_entries(labels.drop("period").withColumn("period", F.lit("1885-01")), located.withColumn("n", F.lit(9)), ["doc", "page"], "period", "row", ["u", "v"], F.lit("t"))
    manifests.write_training(every, str(tmp_path / "m"), ["doc", "page"], "row", ["u", "v"])
    docs = {(r.doc, r.page): (r.n_examples, r.n_cells) for r in spark.read.json(str(tmp_path / "m")).collect()}
    assert docs == {("a", 1): (2, 3), ("a", 2): (1, 2)}
    back = manifests.read_training(spark, str(tmp_path / "m"), "doc string, page int", "row int, u string, v string, target string")
    assert sorted(map(str, back.collect())) == sorted(map(str, every.select(*back.columns).collect()))

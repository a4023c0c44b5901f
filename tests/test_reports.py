"""Reports and replies on small fixtures."""

from pyspark.sql import functions as F

from rowproof.functions import replies
from rowproof.operators import reports


def test_replies_are_recovered_where_one_value_is_valid(spark):
    said = ['{"day": 1, "rows": [1, 2]}', '```json\n{"day": 1, "rows": [1, 2,],}\n```', '{"title": "x"}\n {"day": 1, "rows": [1, 2]} done', 'no {"day": 1}', '{"day": 2, "rows": [1, 2]}', '{"day": 1, "rows": [1]}', "", None]
    df = spark.createDataFrame([(x,) for x in said], "t string")
    v = replies.recovered(F.col("t"), "day int, rows array<int>", lambda x: (x["day"] == 1) & (F.size(x["rows"]) == 2))
    assert [r.v is not None for r in df.select(v.alias("v")).collect()] == [True] * 3 + [False] * 5
    assert replies.json_values('[1,] "a"') == [] and replies.json_values("1 2 x 3") == ["1", "2"]


def test_words_in_number_cells_become_flags(spark):
    df = spark.createDataFrame([({"precip": "Gottas", "t": "2.5", "u": None}, {"t": "sic", "precip": "old"}), ({}, None)], "c map<string,string>, f map<string,string>")
    cells, flags = replies.numeric_cells(F.col("c"), F.col("f"))
    got = df.select(cells.alias("c"), flags.alias("f")).collect()
    assert [(r.c, r.f) for r in got] == [({"precip": None, "t": 2.5, "u": None}, {"t": "sic", "precip": "Gottas"}), ({}, {})]


def test_worklist_takes_the_last_assignment_with_a_period(spark):
    assigned = spark.createDataFrame([(1, 1, "1889-01"), (1, 2, None), (2, 1, None), (2, 2, "1889-02"), (3, 1, "1889-03")], "page int, file int, period string")
    got = reports.worklist(assigned, spark.createDataFrame([(3,), (3,)], "page int"), ["page"], ["file"], "period")
    assert [tuple(r) for r in got.collect()] == [(2, 2, "1889-02")]


def test_reports_of_nothing(spark):
    sheets = spark.createDataFrame([(2, 1.0, 0.0), (6, 0.5, 0.2)], "n_cells long, cell_acc double, structural_err_rate double")
    assert tuple(reports.benchmark(sheets).first()) == (8, 0.625, 0.1, False)
    assert tuple(reports.benchmark(sheets.limit(0)).first()) == (0, 1.0, 0.0, True)
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (4,)], "k int")
    assert tuple(reports.probe(a, b, ["k"]).first()) == (2, 3, 1, 1 / 3, 0.5)
    assert tuple(reports.probe(a.limit(0), b.limit(0), ["k"]).first()) == (0, 0, 0, None, None)


def test_filled_repeated_and_read_often(spark):
    df = spark.createDataFrame([(1, 1, " ", "x"), (1, 2, None, ""), (2, 1, None, None), (1, 1, "y", None)], "p int, r int, a string, b string")
    assert tuple(reports.filled(df, ["p"], ["r"], ["a", "b"]).first()) == (1, 1)
    n = spark.createDataFrame([(1, 2), (2, 0), (3, None)], "k int, n int")
    assert [tuple(r) for r in reports.repeated(n, F.col("n")).select("k", "copy").collect()] == [(1, 1), (1, 2)]
    reads = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "s string, run int")
    assert reports.read_often(reads, ["s"], "run").count() == 2

"""Series operators, sources and the judgement stream on small fixtures."""

import json

from pyspark.sql import functions as F

from rowproof.operators import series
from rowproof.sources import files
from rowproof.streaming import judgements


def test_value_at_share_takes_the_index_of_the_sorted_list(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(10)] + [("b", 1.0), ("b", 1.0), ("b", None), ("c", None)], "k string, v double")
    assert {tuple(r) for r in series.value_at_share(df, ["k"], "v", 0.9).collect()} == {("a", 9.0, 10), ("b", 1.0, 2)}


def test_modal_count_prefers_known_layouts(spark):
    df = spark.createDataFrame([("a", 7), ("a", 7), ("a", 9), ("b", 2), ("b", 2), ("b", 50), ("c", 90), ("c", 60), ("c", 60)], "k string, n int")
    got = series.modal_count(df, ["k"], F.col("n"), [9], 5, 40)
    assert {tuple(r) for r in got.collect()} == {("a", 9, 1), ("b", 2, 2), ("c", 60, 2)}


def test_within_cap_and_latest(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 4), ("a", 3, None), ("b", 1, 9)], "k string, t int, c int")
    assert {tuple(r) for r in series.within_cap(df, ["k"], ["t"], "c", 5).select("k", "t", "allowed").collect()} == {("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False)}
    assert {tuple(r) for r in series.latest(df, ["k"], ["t"], ["c"]).collect()} == {("a", None), ("b", 9)}


def test_oversampled_repeats_what_there_is(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "k string, t int")
    assert sorted(tuple(r) for r in series.oversampled(df, ["k"], [F.col("t")], 2, 2).collect()) == [("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", 2, 2), ("b", 1, 1), ("b", 1, 2)]


def test_files(spark, tmp_path):
    (tmp_path / "y.csv").write_text("A banner\n1850,1\n1851,1.5,x, 2\n\n1999,3\n")
    assert sorted(tuple(r) for r in files.read_yearly(spark, str(tmp_path / "y.csv"), 1851, 1900).collect()) == [(1851, 1, 1.5), (1851, 3, 2.0)]
    (tmp_path / "p.json").write_text(json.dumps({"pages": [{"item": "3", "page": 1}, {"item": "3", "page": 2}]}, indent=1))
    assert files.read_pages(spark, str(tmp_path / "p.json"), "item:string,page:int").count() == 2
    df = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a"), ("t", 1, None)], "k string, d int, v string")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, files.read_jsonl(spark, str(tmp_path / "j"), df.schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    files.write_series(df, str(tmp_path / "s"), ["k"], ["d"], F.concat_ws("\t", "d", F.coalesce("v", F.lit("NA"))))
    (part,) = (tmp_path / "s/k=s").glob("part-*")
    assert part.read_text() == "1\ta\n2\tb\n"


def test_stream_keeps_the_latest_judgement(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    (src / "1.json").write_text('{"id": "x", "n": 1, "verdict": "ok"}\n{"id": "y", "n": 2, "verdict": "ok"}\n')
    (src / "2.json").write_text('{"id": "x", "n": 3, "verdict": "wrong"}\n')
    log = judgements.judgements(spark, str(src), "id string, n long, verdict string")
    q = judgements.latest(log, ["id"], "n", ["verdict"]).writeStream.format("memory").queryName("latest_judgements").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("latest_judgements").collect()} == {("x", "wrong"), ("y", "ok")}

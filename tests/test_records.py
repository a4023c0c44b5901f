"""Blocks, records, readers, sources and streams of pages on small fixtures."""

import json
import shutil

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rowproof.functions import printed
from rowproof.layout import Layout, LayoutColumn
from rowproof.operators import blocks, records
from rowproof.operators.rejudge import day_rows
from rowproof.sources import files, manifests, readers
from rowproof.streaming import pages as streamed

BLOCK = Layout("b", (LayoutColumn("label", "text"),), monthly={"aggregate": {"a": "mean"}})


def test_blocks(spark):
    rows = [
        (1, "1", 55.5, 10.0, 1.0, 0.0), (1, "2", 760.0, 20.0, 5.0, 0.0), (1, "3", 750.0, 30.0, 9.0, 0.0), (1, "Mez", 755.0, 20.0, 0.0, 0.0),  # closes; 55.5 becomes 755.5
        (2, "1", 760.0, 10.0, 1.0, 0.0), (2, "2", 760.0, 10.2, 1.2, 0.0), (2, "3", 700.0, 30.0, 9.0, 0.0), (2, "Mez", None, 21.0, 0.0, None),  # open, near rows, 700 at sea level
        (3, "1", 20.0, None, 1.0, 0.0), (3, "2", 760.0, 1.0, 1.0, None), (3, "Mez", 700.0, 9.0, 1.0, None),  # two rows only; 20 fits nothing
    ]
    df = spark.createDataFrame(rows, "page int, label string, baro double, a double, b double, alt double").repartition(3)
    out = {(r.page, r.label): r for r in blocks.rejudged_blocks(df, ["page"], "label", "Mez", ["a", "b"], BLOCK, "baro", "alt").collect()}
    assert out[1, "1"].baro == 755.5 and not any(out[1, x].flagged for x in ("1", "2", "3", "Mez"))
    assert out[2, "1"].problems == ["block_arithmetic: a", "near_duplicate_row"] and out[2, "3"].problems == ["block_arithmetic: a", "pressure_implausible"] and out[2, "Mez"].problems == ["block_arithmetic: a"]
    assert out[3, "1"].problems == ["elided_without_one_value", "pressure_implausible"] and out[3, "2"].problems == []
    plan = blocks.rejudged_blocks(df, ["page"], "label", "Mez", ["a", "b"], BLOCK, "baro", "alt")._jdf.queryExecution().executedPlan().toString()
    assert plan.partition("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    assert blocks.rejudged_blocks(df.where("false"), ["page"], "label", "Mez", ["a", "b"], BLOCK, "baro", "alt").count() == 0


def test_calibration(spark):
    rows = [(k, x, 10.0 if x != "Mez" else 10.0 + k, k != 7) for k in range(10) for x in ("1", "2", "3", "Mez") if (k, x) != (8, "2")]
    df = spark.createDataFrame(rows, "page int, label string, a double, sound boolean")
    (r,) = blocks.calibrated(df, ["page"], "label", ["1", "2", "3"], "Mez", ["a"], F.col("sound"), F.lit(True)).collect()
    # pages 7 (unsound) and 8 (a row short) say nothing: 0..6 and 9 are left
    assert (r["column"], r.n, r.middle, r.at_share, r.most, r.tolerance) == ("a", 8, 3.5, 9.0, 9.0, 13.5)


def test_rederived(spark):
    df = spark.createDataFrame([(1, "cap", {"period": "1885-01", "other": "x"}), (2, "cap", {"astronomy": "false", "period": "1886-02"}), (3, "", {"period": "?"}), (4, None, {}), (5, "cap", {})], "id int, caption string, record map<string,string>")
    new = {"astronomy": F.lit(False), "period": F.when(F.col("id") < 5, "1886-02"), "suspect": F.lit(None).cast("string")}
    got = {r.id: r for r in records.rederived(df, "record", "caption", new).collect()}
    assert [tuple(c) for c in got[1].changes] == [("period", "1885-01", "1886-02")] and got[1].record == {"other": "x", "astronomy": "false", "period": "1886-02", "suspect": None}
    assert got[2].changes == got[3].changes == got[4].changes == got[5].changes == [] and got[3].record == {"period": "?"}


def test_variants_by_either_part_of_a_path(spark):
    found = records.evaluations(spark.createDataFrame([("b.json", "runs/g4/smoke4/epoch2", 0.5), ("a.json", "models/smoke4", 0.9), ("c.json", "", 0.1), ("d.json", "x/none", None), ("e.json", "/one", 0.3)], "file string, path string, acc double"), "file", "path", "acc")
    assert {r.name: r.accuracy for r in found.collect()} == {"smoke4": 0.9, "models": 0.9, "epoch2": 0.5, "one": 0.3}
    logs = spark.createDataFrame([("1", "qwen35-lora-smoke4-epoch2", 10, 2, 0.95), ("2", "smoke4", 11, None, None), ("3", "other", 5, 1, 0.1)], "file string, name string, rows int, epochs int, trained double")
    out = records.variants(logs, "file", "name", found)
    assert {r.name: (r.rows, r.gold_cell_acc) for r in out.collect()} == {"smoke4": (11, 0.9), "other": (5, None)}
    assert [r.line for r in records.variant_lines(out, "name", "rows", "epochs", "trained").orderBy("name").collect()] == ["other                5   1           —    0.1000", "smoke4              11 None      0.9000         —"]


def test_rollups_of_nothing(spark):
    s = spark.createDataFrame([(1, 10, 0.5, 0.1, 0.5, 2, 10, False)], "k int, n_cells int, cell_acc double, structural_err_rate double, flagged_recall double, flagged_cells int, total_cells int, ok boolean")
    (r,) = records.rolled_up(s, F.col("ok")).collect()
    assert (r.n_sheets, r.n_sheets_scored, r.n_sheets_errored, r.cell_acc, r.flagged_recall_micro) == (1, 0, 1, 0.0, 0.0)
    (r,) = records.corpus(s.withColumn("period", F.lit(None).cast("string")), F.lit(False), "period", "flagged_cells", "total_cells").collect()
    assert (r.n_tables, r.n_gold, r.year_span, r.gold_cell_acc_micro) == (1, 0, None, None)


def test_station_group(spark):
    said = {"Revista do Observatório 3 Ouro  Preto!": "Ouro Preto", "RESUMO DAS OBSERVAÇÕES METEOROLÓGICAS feitas em Belém 1886": "Belém", "": "(no station named)", None: "(no station named)", "x" * 60: "x" * 48}
    df = spark.createDataFrame([(k,) for k in said], "c string")
    assert [r.g for r in df.select(records.station_group(F.col("c")).alias("g")).collect()] == list(said.values())


def test_first_printed_int(spark):
    said = {"13 | 29.5": 13, "·.7a | 2": 7, " 4": 4, "Mez | 3": None, "": None, None: None, "| 8": None, "٣ | 1": None}
    df = spark.createDataFrame([(k,) for k in said], "c string")
    assert [r.n for r in df.select(printed.first_printed_int(F.col("c")).alias("n")).collect()] == list(said.values())


def test_reader_halves_a_batch_that_fails(spark):
    calls = []

    def reader(contents):
        calls.append(len(contents))
        if b"bad" in contents:
            raise RuntimeError("out of memory")
        if b"short" in contents and len(contents) > 1:
            return []
        return [c.decode().upper() for c in contents]

    items = [b"a", b"b", b"bad", b"c", b"d", b"e", b"f", b"g", b"short", b"h"]
    got = list(readers.attempts(reader, items, 8))
    assert [t for t, _ in got] == ["A", "B", None, "C", "D", "E", "F", "G", "SHORT", "H"]
    assert [e for _, e in got if e] == ["RuntimeError: out of memory"] and calls == [8, 4, 2, 2, 1, 1, 4, 2, 1, 1]
    df = spark.createDataFrame([(i, "k", bytearray(c) if c else None) for i, c in enumerate([*items, None])], "id int, tag string, content binary").repartition(2)
    out = {r.id: r for r in readers.read(df, ["id", "tag"], "content", lambda: reader).collect()}
    assert len(out) == 11 and out[2].error == "RuntimeError: out of memory" and out[2].text is None and out[0].text == "A" and (out[10].text, out[10].error) == (None, None)
    assert readers.read(df.where("false"), ["id"], "content", lambda: reader).count() == 0


def test_worklists_of_three_forms(spark, tmp_path):
    p = [{"doc": "a", "page": 1}, {"doc": "b", "page": 2}]
    for name, d in {"pages": {"pages": p, "note": "x"}, "bare": p, "dicts": {"x": p[:1], "y": p[1:]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=1))
        assert sorted(map(tuple, files.read_worklist(spark, str(tmp_path / f"{name}.json"), "doc string, page int").collect())) == [("a", 1), ("b", 2)]


def test_daily_values(spark, tmp_path):
    (tmp_path / "d.txt").write_text("banner, of words\n 27, 1,19030101,  12,0\n27,1,19030102,-9999,9\n27,1,xx,5,0\n27,1,19030103\n27,1,19030104,-31,0\n")
    got = files.read_daily(spark, str(tmp_path / "d.txt")).orderBy("date").collect()
    assert [(str(r.date), r.value) for r in got] == [("1903-01-01", 1.2), ("1903-01-02", None), ("1903-01-04", -3.1)]


def test_summary_beside_rows(spark, tmp_path):
    df = spark.range(5)
    files.write_with_summary(df, str(tmp_path / "rows"), df.groupBy().count())
    assert spark.read.json(str(tmp_path / "rows")).count() == 5 and spark.read.json(str(tmp_path / "rows.summary")).first()["count"] == 5


def test_versions(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    manifests.write_version(df, ["id", "x"], "v1", str(tmp_path / "v"))
    assert manifests.version_problems(df.repartition(7), ["id", "x"], str(tmp_path / "v")).count() == 0
    (r,) = manifests.version_problems(df.where("id > 0"), ["id", "x"], str(tmp_path / "v")).collect()
    assert r.problem.startswith("changed since v1 was frozen (50 rows then, 49 now; sha256 ")


def judge(rows):
    return day_rows(rows, ["page"], "pos", "day", F.lit(False), 1, 31, F.lit(6), 1)


def test_stream_of_pages_replays_without_loss(spark, tmp_path):
    src, store, out, check = (str(tmp_path / x) for x in ("src", "store", "out", "check"))
    rows = [(p, i, i if (p, i) != (2, 4) else 9) for p in (1, 2, 3) for i in range(1, 7)]
    parts = [rows[:4], rows[4:11], rows[11:] + [(2, 4, 4)]]  # page 1 in two batches, page 2 in two, a row that comes again mended
    (tmp_path / "src").mkdir()
    read = spark.readStream.schema("page int, pos int, day int").option("maxFilesPerTrigger", 1).json(src)

    def arrive(part, name):
        (tmp_path / "src" / name).write_text("".join(json.dumps({"page": p, "pos": i, "day": d}) + "\n" for p, i, d in part))

    for k, part in enumerate(parts):
        arrive(part, f"{k}.json")
        streamed.judged(read, store, out, check, ["page"], ["pos"], judge).awaitTermination()
    whole = spark.createDataFrame([r for r in rows if r != (2, 4, 9)] + [(2, 4, 4)], "page int, pos int, day int")
    want = sorted(map(tuple, judge(whole).select("page", "pos", "day", "is_day", "complete").collect()))
    got = lambda: sorted(map(tuple, streamed.latest(spark, out, ["page"]).select("page", "pos", "day", "is_day", "complete").collect()))
    assert got() == want and all(x[3] and x[4] for x in want)
    # A batch that was taken, lost its judgements and is replayed; and one that is replayed whole.
    batch = spark.createDataFrame(parts[2], "page int, pos int, day int")
    shutil.rmtree(f"{out}/batch=2")
    streamed.step(batch, 2, store, out, ["page"], ["pos"], judge)
    streamed.step(batch, 2, store, out, ["page"], ["pos"], judge)
    assert got() == want and spark.read.parquet(store).count() == len(rows) + 1
    streamed.judged(read, store, out, check, ["page"], ["pos"], judge).awaitTermination()  # nothing new
    assert got() == want


@pytest.mark.parametrize("of", [printed.A, printed.B])
def test_printed_orders_have_a_cell_for_every_column(of):
    assert of.index.key == "day" and {c.key for c in of.columns} >= {"wind_dir", "ozone"}

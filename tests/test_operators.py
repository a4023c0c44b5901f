"""Micro-fixtures of the table operators."""

import datetime
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rowproof.functions import parse, scalars
from rowproof.layout import Check, Layout, LayoutColumn
from rowproof.operators import checks, evaluate, govern, merge, pages
from rowproof.plans import queries


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize(
    ("low", "lo", "hi", "want"),
    [(42.03, 700, 800, 742.03), (742.03, 700, 800, 742.03), (0.0, 700, 800, 700.0), (95.72, 700, 800, 795.72), (50.0, 700, 720, None), (10.5, 300, 400, 310.5)],
)
def test_restore_hundreds(spark, low, lo, hi, want):
    assert spark.range(1).select(scalars.restore_hundreds(F.lit(low), lo, hi)).first()[0] == want


def parsed(spark, layout, raw):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    return [r.p for r in parse.parse_rows(df, layout, "raw", "p").orderBy("i").collect()]


def test_parse_row_conventions(spark):
    layout = Layout("x", (LayoutColumn("day", "day"), LayoutColumn("a"), LayoutColumn("d", "text")), markers=("Inap.",))
    raw = ["1 | + 0.35 | N", "2 | — 1.23 | SW", "3 | 29·969 | null", "» | 4,5 | IDEM |", "5 | 1", "6 | Gottas | E", "1 | 2 | 3 | 4 | 5", None, "`7 | 1‧5 | x` <|im_end|> 9 | 9", "8 | inapr. | NULL | ", "9.7 | 1d | ,,", "9 | it's | a"]
    got = parsed(spark, layout, raw)
    assert [g.cells.day.num for g in got] == [1, 2, 3, None, 5, 6, 1, None, 7, 8, 9, 9]
    assert [g.cells.a.num for g in got] == [0.35, -1.23, 29.969, 4.5, 1.0, None, 2.0, None, 1.5, None, None, None]
    assert [g.cells.d.kind for g in got] == ["txt", "txt", "null", "ditto", "null", "txt", "txt", "null", "txt", "null", "ditto", "txt"]
    assert got[4].problems == [parse.PADDED] and got[5].problems == ["a: unparsable 'Gottas'"]
    assert got[6].problems == ["5 cells, expected 3"] and got[7].problems == ["1 cells, expected 3"] and got[8].problems == []
    assert got[9].markers == {"a": "inapr."} and got[9].problems == [] and got[10].problems == ["a: unparsable '1d'"] and got[11].problems == ["a: unparsable \"it's\""]


def test_parse_mends_a_ranged_index(spark):
    layout = Layout("y", (LayoutColumn("year", "day", low=1850, high=1880), LayoutColumn("a", low=0, high=50), LayoutColumn("b", low=0, high=50), LayoutColumn("c", carried=True, low=28, high=31)))
    raw = ["18 | 56 | 1 | 2 | ·404", "» | 1857 | 1 | 2 | 3", "1858 | 1 | null | 2 | ·787", "1859 | 1 | null | 99 | 3", "1860 | 1 | 2 | 3 | 4", "x | 1861 | 1 | 2 | 3", "1862 | null | null | 2 | 3", "1863 | 1 | 2 | 3 | - "]
    got = parsed(spark, layout, raw)
    assert [[g.cells[k].num for k in ("year", "a", "b", "c")] for g in got[:3]] == [[1856, 1, 2, 0.404], [1857, 1, 2, 3], [1858, 1, 2, 0.787]]
    assert got[0].problems == ["index cell read as two tokens '18' '56', joined to '1856'"] and got[1].problems == ["dropped a spurious leading cell '»'"]
    assert got[2].problems == ["dropped an empty cell at position 2 (the page rules a line there, it is not a column)"]
    assert [g.problems for g in got[3:5]] == [["5 cells, expected 4"]] * 2 and got[7].problems == [] and got[7].cells.c.num == 3
    assert all(len(g.problems) == 1 + (i == 5) for i, g in enumerate(got[5:7], 5))
    soft = spark.createDataFrame([(p,) for g in got for p in g.problems], "p string").select(parse.soft(F.col("p"))).collect()
    assert [r[0] for r in soft] == [True, True, True, False, False, False, False, False]


def test_layouts(spark, tmp_path):
    made = Layout.blank("b-1", ["Dia", "Barômetro (mm)", "Vento"])
    assert [c.key for c in made.columns] == ["dia", "barometro_mm", "vento"] and made.index.key == "dia"
    made.save(str(tmp_path))
    assert Layout.available(str(tmp_path)) == {"b-1": made}
    df = spark.createDataFrame([("1888-02",), ("1887-02",), ("x",), (None,)], "p string")
    days = lambda kind: [r[0] for r in df.select(Layout("x", (), rows_per_page=kind).expected_rows(F.col("p"))).collect()]
    assert (days("days_in_month"), days("days_in_month_x2"), days("fixed:25")) == ([29, 28, None, None], [58, 56, None, None], [25] * 4)
    assert [r[0] for r in spark.createDataFrame([("Mez. | 1",), (" mois|2",), ("3 | 4",), (None,)], "r string").select(parse.is_summary(F.col("r"), ("Mez", "Mois."))).collect()] == [True, True, False, False]


def test_checks(spark):
    layout = Layout("x", (LayoutColumn("a", low=0, high=5), LayoutColumn("b"), LayoutColumn("s")), (Check("sum", "s", ("a", "b")), Check("order", "b", ("a", "s"))))
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (9.0, 2.0, 3.0), (1.0, None, 3.0)], "a double, b double, s double")
    v = {c: F.col(c) for c in df.columns}
    got = {tuple(map(tuple, r)) for r in df.select(checks.range_violations(layout, v), checks.check_failures(layout, v)).collect()}
    assert got == {((), ()), (("a",), ("sum:s", "order:b"))}


def page(spark, values, kind="int"):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], f"page int, pos int, v {kind}")


def test_longest_run(spark):
    assert tuple(pages.longest_runs(page(spark, [10, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11]), ["page"], "pos", "v").first())[1:4] == (2, 10, 9)


@pytest.mark.parametrize(("days", "want"), [([*range(1, 32), 28], [31]), ([5, 5], [0, 1]), ([5, 9, 5, 2], [2]), ([10, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11], [0])])
def test_spurious_duplicates(spark, days, want):
    out = pages.spurious_duplicates(page(spark, days), ["page"], "pos", "v").where("spurious")
    assert [r.pos for r in out.orderBy("pos").collect()] == want


@pytest.mark.parametrize(("given", "want"), [([1855, 18, 1857, 1858, 18], [1855, 1856, 1857, 1858, 1859]), ([1855, 18, 1860, 1858], [1855, 18, 1860, 1858]), ([1855, 18], [1855, 18])])
def test_index_filled(spark, given, want):
    out = pages.index_filled(page(spark, given), ["page"], "pos", "v", 1800, 1900)
    assert [r.v for r in out.orderBy("pos").collect()] == want


def test_carry_and_ditto(spark):
    out = pages.carried(page(spark, [29.969, 0.404, 404.0, 0.589, None], "double"), ["page"], "pos", "v", 28, 31)
    assert [r.v for r in out.orderBy("pos").collect()] == [29.969, 29.404, 29.404, 29.589, None]
    d = page(spark, ["»", "a", "»", None, "»"], "string")
    out = pages.ditto_filled(d, ["page"], "pos", "v", F.coalesce(F.col("v") == "»", F.lit(False)))
    assert [r.v for r in out.orderBy("pos").collect()] == [None, "a", "a", None, None]


def test_labels(spark):
    d = page(spark, ["1", "2", "3", "Mez", "1", "2", "3", "Mez", "1", "3"], "string")
    assert rows(pages.label_blocks(d, ["page"], "pos", "v", ["1", "2", "3", "Mez"]), "first_pos") == [(1, 0, 3), (1, 4, 7)]
    assert [r.first_pos for r in pages.trios(d, ["page"], "pos", "v", ("1", "2", "3")).orderBy("first_pos").collect()] == [0, 4]


def test_near_pairs(spark):
    d = spark.createDataFrame([(1, 0, 765.67, 24.9), (1, 1, 767.09, 24.8), (1, 2, 767.00, 24.6)], "page int, pos int, x double, y double")
    assert rows(pages.near_pairs(d, ["page"], "pos", ["x", "y"], 0.5), "a") == [(1, 1, 2)]


def test_near_pairs_of_unread_cells(spark):
    cells = [(None, 24.9, 1.0), (None, 25.0, 1.2), (765.0, 24.8, None), (765.2, None, 1.1), (765.1, 24.9, 1.1), (None, None, 1.0), (None, 25.4, 1.6), (765.3, 24.7, 1.2), (-0.1, -0.1, None), (0.1, 0.1, None)]
    table = [(p, i, *c) for p in (1, 2) for i, c in enumerate(cells)]
    d = spark.createDataFrame(table, "page int, pos int, x double, y double, z double")
    for least in (1, 2, 3):
        want = []
        for p, i, *a in table:
            for q, j, *b in table:
                gaps = [abs(x - y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
                if p == q and i < j and len(gaps) >= least and max(gaps) < 0.5:
                    want.append((p, i, j))
        assert want and rows(pages.near_pairs(d, ["page"], "pos", ["x", "y", "z"], 0.5, least), "page", "a", "b") == sorted(want)


def test_vote(spark):
    d = spark.createDataFrame([(1, 20.0), (1, 20.0), (1, 25.0), (2, 10.0), (2, 20.0), (2, 30.0), (3, None), (3, None), (3, 1.0)], "k int, v double")
    assert rows(evaluate.voted(d, ["k"], "v"), "k") == [(1, 20.0, True, 3), (2, 20.0, False, 3), (3, None, True, 3)]


def test_merge_and_fingerprint(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(merge.merged([a, b], ["k"], ["v"]), "k") == [(1, "a"), (2, "b"), (3, "d")]
    one, two = govern.fingerprint(a, ["k", "v"]).first(), govern.fingerprint(a.orderBy(F.desc("k")), ["k", "v"]).first()
    assert one == two and one.n == 2 and one != govern.fingerprint(b, ["k", "v"]).first()


@pytest.mark.parametrize(("text", "want"), [("Mez de Agosto de 1886, Rio", "1886-08"), ("Maio e Junho de 1886", None), ("du mois de Mars 1883", "1883-03"), ("Agosto", None), (None, None)])
def test_caption_period(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(scalars.caption_period(F.col("t"))).first()[0] == want


def test_flagship_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_check_rules_adds_up_in_the_order_of_events(spark, tmp_path):
    """Days whose mean lies at the tolerance to the cent, one event in each of five
    files; the later ones are larger, so they are read first."""
    rng, files = random.Random(5), [[] for _ in range(5)]
    for user in range(2000):
        while True:
            lo, hi = sorted(rng.sample(range(20_000), 2))
            rest, odd = divmod(3 * (lo + hi) + rng.choice([-51, 51]), 2)
            a, b = rng.randint(lo, hi), rng.randint(lo, hi)
            if not odd and lo <= rest - a - b <= hi:
                break
        values = [lo, hi, a, b, rest - a - b]
        rng.shuffle(values)
        for k, cents in enumerate(values):
            files[k].append((user, cents / 100))
    for k, made in enumerate(files):
        made += [(10_000 + i, None if i % 3 else 1.0) for i in range(k * 500)]
        start = datetime.datetime(2024, 1, 1, k)
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        ids = [k * 10_000 + i for i in range(len(made))]
        pq.write_table(pa.table({"event_id": ids, "ts": pa.array([start] * len(made), pa.timestamp("us")), "user_id": [u for u, _ in made], "value": pa.array([v for _, v in made], pa.float64())}), tmp_path / "events.parquet" / f"{k}.parquet")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet({[str(tmp_path / 'events.parquet' / f'{k}.parquet') for k in range(5)]})")
    want = con.sql(queries.ORACLES["check_rules"])
    got = queries.check_rules(spark, str(tmp_path)).select(*want.columns).collect()
    assert {r.mean_fails for r in got if r.user_id < 2000} == {True, False}
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))

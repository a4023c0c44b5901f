"""Positions of rows and columns: small pages by hand, and every query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from rowproof.operators import lattice
from rowproof.plans import lattice_queries
from rowproof.plans.queries import ORACLES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["series_periods", "series_peaks", "busy_runs", "mark_grid", "mark_chains", "rule_bounds", "gap_bounds", "claimed_days"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    want = con.sql(ORACLES[name])
    got = getattr(lattice_queries, name)(spark, SMALL).select(*want.columns).collect()
    assert len(got) > 0 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def one(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.out for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_boundaries(spark):
    pages = {
        (0, 100, 200, 300, 303, 400): [0, 100, 200, 301, 400],  # a double rule
        (0, 100, 200, 220, 300, 400): [0, 100, 200, 300, 400],  # a sliver
        (10, 12, 14): [12],  # merged one after another, no page of four
        (): [],
    }
    assert one(spark, [(list(k),) for k in pages], "xs array<int>", lattice.merged_boundaries(F.col("xs"), F.lit(1000))) == list(pages.values())
    gaps = [([(0, 10), (50, 54), (90, 94), (130, 160), (200, 210)], 5), ([(0, 10), (50, 54), (200, 210)], 5), ([(0, 10), (50, 54)], 1), ([], 0)]
    assert one(spark, gaps, "g array<struct<start: bigint, end: bigint>>, n int", lattice.boundaries_of_gaps(F.col("g"), F.col("n"))) == [[10, 52, 92, 140, 150, 200], None, None, None]


def test_runs_above(spark):
    rows = [([0.9, 0.9, 0.9, 0.1, 0.9, 0.9, 0.1, 0.9, 0.9, 0.9, 0.9],), ([0.5] * 9,), ([],), ([None, 0.9, 0.9, 0.9],)]
    got = one(spark, rows, "v array<double>", lattice.runs_above(F.col("v"), 0.5, 3))
    assert [[tuple(x) for x in r] for r in got] == [[(0, 3), (7, 11)], [], [], [(1, 4)]]


def test_periods_and_peaks(spark):
    rows = [([20 if i % 7 < 2 else 0 for i in range(100)],), ([1] * 40,), ([0] * 30 + [5] + [0] * 30,)]
    got = one(spark, rows, "v array<int>", lattice.periods(F.col("v"), 3, 14))
    assert got[0] == [7] and got[1] == [3] and len(got[2]) >= 1
    hill = [0] * 10 + [4, 9, 4] + [0] * 3 + [3, 5, 3] + [0] * 20 + [1, 2, 1] + [0] * 5
    assert one(spark, [(hill, 12), (hill, 5), ([], 5), ([1], 5)], "v array<int>, p int", F.transform(lattice.peaks(F.col("v"), F.col("p")), lambda x: x["y"])) == [[12, 41], [12, 18, 41], [], []]  # the last of a plateau; 18 is too near in the first


def test_grid(spark):
    rows = [
        ([40, 57, 74, 108, 125], 6, None),  # a row that was not seen
        ([40, 57, 74, 83, 108, 125], 6, 17.0),  # and a mark between two rows
        ([40, 57, 74], 6, None),  # too few
        ([40, 57, 74, 91], 9, 17.0),  # too little of the grid explained
        ([1, 2, 3, 4, 5], 5, None),  # no step
    ]
    whole = [40, 57, 74, 91, 108, 125]
    assert one(spark, rows, "ys array<int>, n int, p double", lattice.grid(F.col("ys"), F.col("n"), F.col("p"))) == [whole, whole, None, None, None]


def test_chains(spark):
    rows = [
        ([0, 20, 40, 60, 130, 150], [], 9),  # two chains
        ([0, 20, 40, 75, 110, 130], [], 9),  # a summary line between them
        ([0, 20, 40, 75, 110, 130], [90], 9),  # and a rule, which keeps them apart
        ([0, 20, 40, 60, 80, 102], [110], 4),  # the last row is the rule's shadow
        ([0, 24, 43, 62, 81], [], 3),  # the first row stands apart
        ([5], [], 3), ([], [], 3),
    ]
    found = lattice.chain(F.col("ys"), F.lit(20), F.col("r"))
    chains = [[0, 20, 40, 60], [0, 20, 40, 110, 130], [0, 20, 40], [0, 20, 40, 60, 80, 102], [0, 24, 43, 62, 81], [], []]
    assert one(spark, rows, "ys array<int>, r array<int>, m int", found) == chains
    trimmed = one(spark, rows, "ys array<int>, r array<int>, m int", lattice.trimmed(found, F.col("m"), F.lit(20), F.col("r")))
    assert trimmed == [*chains[:3], [0, 20, 40, 60, 80], [24, 43, 62, 81], [], []]


def test_claimed_days(spark):
    at = lambda d: 100 + 20 * d
    page = {
        1: [(d, at(d)) for d in range(1, 11) if d not in (4, 7)] + [(3, at(3) + 9), (9, at(9) + 200)],  # one row proposed twice, a claim far off
        2: [(d, at(d)) for d in range(1, 11) if d != 5] + [(5, at(8) + 3)],  # out of order
        3: [(d, at(d)) for d in range(3, 11)],  # the ends are not claimed
        4: [(d, at(d)) for d in range(1, 5)],  # too few for anything
        5: [(d, at(d)) for d in range(1, 11) if d != 6] + [(6, at(5) + 3)],  # on top of another: the line holds
        6: [(None, 5), (99, 7)],
    }
    df = spark.createDataFrame([(p, d, y, 20.0, 10) for p, claims in page.items() for d, y in claims], "page int, day int, y int, pitch double, n int")
    got = {}
    for r in lattice.resolved_days(df.repartition(4), ["page"], "day", "y", "pitch", "n").collect():
        got.setdefault(r.page, {})[r.day] = (r.y, r.how)
    assert set(got) == {1, 2, 3, 5}
    assert got[1] == {d: (at(d), "read") for d in range(1, 11)} | {3: (164, "read"), 4: (182, "interpolated"), 7: (at(7), "interpolated")}
    assert got[2][5][1] == "interpolated" and sorted(got[3]) == list(range(3, 11))
    assert {h for _, h in got[5].values()} == {"line"} and sorted(got[5]) == list(range(1, 11))
    assert lattice.resolved_days(df.where("false"), ["page"], "day", "y", "pitch", "n").count() == 0


def test_claimed_days_where_the_line_lies_half_way(spark, tmp_path):
    """Users of sf0.1, of the table itself and of copies with shifted keys, whose lines
    pass half-way between two positions: the last bit of the fit decides."""
    con = duckdb.connect()
    con.sql("CREATE TABLE half (base INT, k INT)")
    con.sql("INSERT INTO half VALUES (1065, 0), (1193, 2), (532, 4), (641, 5)")
    con.sql(f"COPY (SELECT e.* REPLACE (event_id + 100000 * k AS event_id, user_id + 1500 * k AS user_id) FROM '/root/testdata/sf0.1/events.parquet' e JOIN half ON user_id = base ORDER BY k, event_id) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(lattice_queries.CLAIMS)
    got = lattice_queries.claimed_days(spark, str(tmp_path)).select(*want.columns).collect()
    assert len(got) == 4 * 28 and {r.how for r in got} == {"line"}
    assert sorted(map(tuple, got)) == sorted(want.fetchall())

"""Reading operators, captions and manifests on small fixtures and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from rowproof.functions import captions, scalars
from rowproof.operators import pages, reading, series
from rowproof.sources import manifests, sef


def test_classified_tells_moved_cells_from_changed_ones(spark):
    df = spark.createDataFrame(
        [(1, 21.3, 16.75, 3.0, 21.3, 16.75, 3.0), (2, 21.3, 16.75, 3.0, 16.75, 21.3, 3.0), (3, 21.3, 16.75, 3.0, 21.3, 16.7, None)],
        "r int, a_x double, a_y double, a_z double, b_x double, b_y double, b_z double",
    )
    out = reading.classified(df, ["x", "y", "z"], "a_", "b_")
    assert [(r.shifts, r.changed) for r in out.orderBy("r").collect()] == [([], []), (["x<->y", "y<->x"], []), ([], ["y"])]
    got = reading.page_stability(out.withColumn("p", F.lit(1)), ["p"]).first()
    assert (got.n, got.n_shift, got.n_changed, got.unstable, got.suspects) == (3, 1, 1, False, 2)


def test_corrected_takes_the_last_correction_and_keeps_problems_apart(spark):
    rows = spark.createDataFrame([(1, 2.0, 7), (2, 3.0, None), (3, 4.0, 9)], "id int, t double, d int")
    log = spark.createDataFrame([(1, "t", 5.0, 1), (1, "t", 6.0, 2), (2, "t", 3.0, 3), (2, "d", 4.0, 4), (3, "d", None, 5), (9, "t", 1.0, 6)], "id int, field string, now double, line int")
    out = reading.corrected(rows, log, ["id"], "field", "now", ["line"], ["t", "d"])
    assert [(r.id, r.t, r.d, r.human_verified, len(r.corrections)) for r in out.orderBy("id").collect()] == [(1, 6.0, 7, True, 1), (2, 3.0, 4, True, 1), (3, 4.0, None, True, 1)]
    none = reading.corrected(rows, log.limit(0), ["id"], "field", "now", ["line"], ["t", "d"])
    assert [r.human_verified for r in none.collect()] == [False] * 3


def test_unmatched_means_spends_each_number_once(spark):
    df = spark.createDataFrame([([20.0, None, 10.0], 10.0, 10.01), ([], 1.0, None), ([3.0, 3.0], 3.0, 3.0), (None, 1.0, 2.0)], "p array<double>, a double, b double")
    got = df.select(reading.unmatched_means([("a", F.col("a"), 0.06), ("b", F.col("b"), 0.06)], F.coalesce("p", F.array().cast("array<double>"))).alias("m")).collect()
    assert [r.m for r in got] == [["b"], ["a"], [], ["a", "b"]]


def test_matched_once_is_the_greedy_matching(spark):
    rng = random.Random(3)
    rows = [(p, a, b, float(rng.randint(0, 6))) for p in range(12) for a in range(rng.randint(1, 6)) for b in range(rng.randint(1, 6))]
    rows += [(99, 0, 0, None), (99, 1, 1, float("nan")), rows[0]]
    df = spark.createDataFrame(rows, "p int, a int, b int, d double")
    want, left, right = set(), set(), set()
    for d, p, a, b in sorted({(d, p, a, b) for p, a, b, d in rows if d is not None and d == d}):
        if (p, a) not in left and (p, b) not in right:
            want.add((p, a, b, d))
            left.add((p, a))
            right.add((p, b))
    got = reading.matched_once(df, ["p", "a"], ["p", "b"], "d").select("p", "a", "b", "d").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert reading.matched_once(df.limit(0), ["p", "a"], ["p", "b"], "d").count() == 0


def robust(points, least=8, share=0.65, residual=0.35):
    if len(points) < least:
        return None
    kept, floor = dict(sorted(points.items())), max(least, int(share * len(points)))
    while True:
        mx, my = sum(kept) / len(kept), sum(kept.values()) / len(kept)
        slope = sum((x - mx) * (y - my) for x, y in kept.items()) / sum((x - mx) ** 2 for x in kept)
        off = {x: abs(y - (my + slope * (x - mx))) for x, y in kept.items()}
        worst = max(off, key=off.get)
        if off[worst] <= residual * slope or len(kept) <= floor:
            return slope, off[worst], len(kept), slope >= 4 and off[worst] <= residual * slope
        del kept[worst]


def test_line_through_drops_the_worst_rows(spark):
    rng = random.Random(5)
    pages = {}
    for p in range(30):
        pages[p] = {x: x * 20.0 + rng.uniform(-5, 5) + (rng.uniform(30, 90) if rng.random() < p / 60 else 0) for x in rng.sample(range(1, 32), rng.randint(5, 31))}
    rows = [(p, x, y) for p, points in pages.items() for x, y in points.items()] + [(0, 99, 1.0), (0, None, 2.0), (0, 3, None)]
    got = {r.p: r for r in reading.line_through(spark.createDataFrame(rows, "p int, x int, y double"), ["p"], "x", "y", 1, 31).collect()}
    for p, points in pages.items():
        want = robust(points)
        if want is None:
            assert (got[p].slope, got[p].accept) == (None, False)
        else:
            assert got[p].slope == pytest.approx(want[0]) and got[p].max_resid == pytest.approx(want[1])
            assert (got[p].n_supporting, got[p].accept, got[p].n_days) == (want[2], want[3], len(points))


def test_graded_and_closure_skip_what_cannot_be_judged(spark):
    df = spark.createDataFrame([("1903-01", 1, None, 0.0), ("1903-01", 2, 1.0, 1.2), ("1903-02", None, 1.0, 1.0), ("1903-02", 3, 4.0, 4.0)], "period string, day int, got double, truth double")
    got = {r.period: r for r in reading.graded(df, "period", F.col("day"), F.col("got"), F.col("truth")).collect()}
    assert [got[None][k] for k in ("is_total", "n_rows", "n_graded", "n_exact", "n_wet", "n_wet_exact", "n_no_day")] == [True, 4, 3, 2, 2, 1, 1]
    rows = spark.createDataFrame([(1.0, 3.0, 2.0), (1.0, 3.0, 2.1), (None, 3.0, 2.0)], "a double, b double, m double")
    assert [r.closes for r in reading.closure(rows, ["a", "b"], "m", 0.1).collect()] == [True, False, None]


def test_period_audit_changes_the_month_only(spark):
    df = spark.createDataFrame([("1883-01", "x", "1883-03"), ("1883-03", "x", "1893-03"), ("1883-03", "x", None), ("1883-03", None, None)], "period string, caption string, found string")
    got = reading.period_audit(df, "period", "caption", F.col("found")).collect()
    assert [(r.bucket, r.period, r.period_as_published, r.year_odd) for r in got] == [
        ("fixed", "1883-03", "1883-01", False), ("agree", "1883-03", None, True), ("ambiguous", "1883-03", None, False), ("nocap", "1883-03", None, False),
    ]


def test_captions(spark):
    df = spark.createDataFrame([("1ª | 2",), (" Mez.... | 3",), ("mês|",), ("2º",), ("Tempo | 1",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(captions.row_label(F.col("t"))).collect()] == ["1", "Mez", "Mez", "2", None, None, None]
    df = spark.createDataFrame([("Estação de Ouro Preto",), ("Mez de Julho de 1889",), ("Mez de Julho de 1889 CRUZADOR",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(captions.header_kind(F.col("t"))).collect()] == ["station", "month_only", "unclear", "unclear", "unclear"]
    df = spark.createDataFrame([("Bahia, Capital",), ("Bahia (Capital)",), ("Ponte B. de Macedo",), ("Algum Lugar Novo",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(captions.canonical_station(F.col("t"))).collect()] == ["bahia_capital", "bahia_capital", "ponte_buarque_de_macedo", "algum_lugar_novo", None, None]
    df = spark.createDataFrame([("Observações em Ouro Preto, thermometro",), ("OURO PRETO XII",), ("Passagem de Vénus, Ouro Preto thermometro",), ("nada",), (None,)], "t string")
    got = df.select(captions.named_layout(F.col("t"), [("ouro preto", "op-daily")], captions.names_any(F.col("t"), ["venus"]))).collect()
    assert [r[0] for r in got] == ["op-daily", None, None, None, None]
    assert [r[0] for r in spark.sql("select '1883-03' p, '1880-01' a, '1883-02' b union all select '1883-03', null, null").select(captions.outside_span(F.col("p"), F.col("a"), F.col("b"))).collect()] == [True, False]


def test_frozen_folders_fail_where_a_file_changed(spark, tmp_path):
    (tmp_path / "sheets").mkdir()
    for k in (1, 2):
        (tmp_path / "sheets" / f"{k}.json").write_text(f'{{"page": {k}}}')
    folder, manifest = str(tmp_path / "sheets"), str(tmp_path / "manifest")
    manifests.freeze(spark, folder, manifest, "*.json")
    assert {r.page for r in manifests.read_frozen(spark, folder, manifest, "page int", "*.json").collect()} == {1, 2}
    (tmp_path / "sheets" / "2.json").write_text('{"page": 3}')
    (tmp_path / "sheets" / "4.json").write_text("{}")
    with pytest.raises(ValueError, match="2.json: changed; 4.json: not in the manifest"):
        manifests.read_frozen(spark, folder, manifest, "page int", "*.json")


def test_angles_as_they_are_printed(spark):
    said = ["3°28' W", "2m W", "0h,30m E", "9°,38'", "23°36' S", "S 12°58'27''", "var.", "", None, "sem"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in said], "t string").select(F.round(scalars.parse_angle(F.col("t")), 4)).collect()]
    assert got == [-3.4667, -0.5, 7.5, 9.6333, -23.6, -12.9742, None, None, None, None]
    line = "Estação de Ouro Preto; Observador, J. Silva.; Latit., S 20°23'; Longitude, 0°20' O; Alt. do bar., 1145 m"
    h = spark.createDataFrame([(line,), (None,)], "t string").select(captions.header_fields(F.col("t")).alias("h")).collect()
    assert (h[0].h.station, h[0].h.observer, h[0].h.lat_hemisphere, h[0].h.barometer_m, h[0].h.moves) == ("Ouro Preto", "J. Silva", "S", 1145, False)
    assert (round(h[0].h.lat_deg, 4), h[0].h.lon_greenwich) == (-20.3833, -43.5058)
    assert (h[1].h.station, h[1].h.lat_deg, h[1].h.moves) == (None, None, False)


def test_periods_of_captions_with_a_town_or_two_months(spark):
    said = {
        "Observations météorologiques du mois de Mars 1883. DE RIO DE JANEIRO": "1883-03", "Observations du mois d'Avril 1883. Rio de Janeiro": "1883-04", "mois d'Août 1883": "1883-08",
        "CUYABÁ NO MEZ DE JANEIRO DE 1889": "1889-01", "Maio e Junho de 1886, Rio de Janeiro": None, "Observações do mez de Agosto de 1886; comparar com Julho": "1886-08", "Agosto de 1786": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r[0]: r[1] for r in df.select("t", scalars.caption_period(F.col("t"))).collect()} == said


def test_reconciled_follows_the_first_sheet(spark):
    df = spark.sql("select * from values (1, date'1886-12-01'), (2, date'1886-01-01'), (3, null), (4, date'1887-03-01') t(k, m)").withColumn("g", F.lit(1))
    got = series.reconciled(df, ["g"], ["k"], "m", [1885, 1886, 1887]).orderBy("k").collect()
    assert [(str(r.reconciled)[:7], r.flagged) for r in got] == [("1886-12", False), ("1887-01", True), ("1887-02", True), ("1887-03", False)]


def test_spread_and_preflight(spark):
    df = spark.createDataFrame([("a", k) for k in range(1, 11)] + [("b", 1)], "p string, pos int")
    assert sorted(tuple(r) for r in pages.spread(df, ["p"], "pos", [0.15, 0.35, 0.5, 0.65, 0.85]).select("p", "pos").collect()) == [("a", 2), ("a", 4), ("a", 6), ("a", 7), ("a", 9), ("b", 1)]
    assert {tuple(r) for r in pages.preflight(df, ["p"], "pos", F.col("pos") != 2).collect()} == {("a", True), ("b", False)}


def test_exchange_files(spark, tmp_path):
    df = spark.createDataFrame([("x", 1889, 2, 1, 16.0, None), ("x", 1889, 1, 1, 15.25, "m"), ("y", 1889, 1, 1, None, None)], "id string, year int, month int, day int, value double, meta string")
    df = df.withColumns({"hour": F.lit(7), "minute": F.lit(None).cast("int"), "period": F.lit("0")})
    sef.write(df, str(tmp_path / "out"), ["id"], ["year", "month", "day"], {"ID": F.col("id"), "Lat": F.lit(-43.0)})
    said = "".join(p.read_text() for p in sorted((tmp_path / "out" / "id=x").glob("*.txt"))).split("\n")
    assert said[:4] == ["SEF\t1.0.0", "ID\tx", "Name\tNA", "Lat\t-43"]
    assert said[12:] == ["Year\tMonth\tDay\tHour\tMinute\tPeriod\tValue\tMeta", "1889\t1\t1\t7\tNA\t0\t15.25\tm", "1889\t2\t1\t7\tNA\t0\t16\t", ""]

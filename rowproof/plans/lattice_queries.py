"""Registered queries of the positions of a page: a user's events stand for its marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowproof.operators import lattice, pages
from rowproof.plans.queries import EVENTS, by_page, query, table

#: Parts of three hours in the 30 days of the events.
SLOTS = 240
SERIES = f"""
WITH c AS (SELECT user_id, CAST(floor(date_diff('hour', TIMESTAMP '2024-01-01', ts) / 3) AS BIGINT) AS slot, count(*) AS n FROM events GROUP BY ALL),
v AS (SELECT u.user_id, r.slot, coalesce(n, 0) AS v FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range({SLOTS})) AS slot) r LEFT JOIN c USING (user_id, slot))
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their place within the user, dealt by user for the folds that follow."""
    return pages.positioned(by_page(table(spark, sf_dir, "events"), "user_id"), ["user_id"], ["ts", "event_id"])


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, v): a user's counts of events, part by part."""
    slot = F.floor((F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")) / 3)
    counts = by_page(table(spark, sf_dir, "events"), "user_id").groupBy("user_id", slot.alias("slot")).agg(F.count("*").alias("n"))
    held = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"))
    return held.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("bigint")), F.lit(0))).alias("v"))


def marks(spark: SparkSession, sf_dir: str, y: Column, there: Column) -> DataFrame:
    """(user_id, n, ys): the positions of a user's marks in order; n is how many events there are."""
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(there, y))).alias("ys"))


@query(SERIES + f"""
, x AS (SELECT *, {SLOTS} * v - sum(v) OVER (PARTITION BY user_id) AS x FROM v),
ac AS (SELECT a.user_id, b.slot - a.slot AS lag, sum(a.x * b.x) AS ac FROM x a JOIN x b ON a.user_id = b.user_id AND b.slot - a.slot BETWEEN 2 AND 24 GROUP BY ALL),
top AS (SELECT *, lag(ac) OVER w AS l, lead(ac) OVER w AS r FROM ac WINDOW w AS (PARTITION BY user_id ORDER BY lag)),
pick AS (SELECT user_id, lag, ac FROM top WHERE ac >= l AND ac > r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ac DESC, lag) <= 6),
every AS (SELECT * FROM pick UNION ALL (SELECT user_id, lag, ac FROM ac ANTI JOIN pick USING (user_id) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ac DESC, lag) = 1))
SELECT user_id, string_agg(CAST(lag AS VARCHAR), ',' ORDER BY ac DESC, lag) AS lags FROM every GROUP BY user_id
""")
def series_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lags at which a user's activity repeats, best first."""
    return series(spark, sf_dir).select("user_id", F.array_join(lattice.periods(F.col("v"), 2, 24).cast("array<string>"), ",").alias("lags"))


PEAKS = SERIES + """
, sm AS (SELECT user_id, slot, avg(v) OVER (PARTITION BY user_id ORDER BY slot ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h FROM v),
top AS (SELECT * FROM (SELECT *, lag(h) OVER w AS l, lead(h) OVER w AS r FROM sm WINDOW w AS (PARTITION BY user_id ORDER BY slot)) WHERE h >= l AND h > r AND h > 0),
held AS (
    SELECT user_id, list_reduce(list([slot] ORDER BY h DESC, slot), lambda a, x: CASE WHEN len(list_filter(a, lambda c: abs(c - x[1]) < 0.6 * 12)) = 0 THEN a || x ELSE a END) AS ys FROM top GROUP BY user_id
)
"""


@query(PEAKS + "SELECT k.user_id, y, round(h, 6) AS height FROM (SELECT user_id, unnest(ys) AS y FROM held) k JOIN sm ON sm.user_id = k.user_id AND slot = y")
def series_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's busiest times, no two within 0.6 of a pitch."""
    found = series(spark, sf_dir).select("user_id", F.explode(lattice.peaks(F.col("v"), F.lit(12))).alias("p"))
    return found.select("user_id", "p.y", F.round("p.height", 6).alias("height"))


@query(SERIES + """
, d AS (SELECT user_id, slot, slot - row_number() OVER (PARTITION BY user_id ORDER BY slot) AS island FROM v WHERE v > 0)
SELECT user_id, min(slot) AS start, max(slot) + 1 AS "end" FROM d GROUP BY user_id, island HAVING count(*) >= 2
""")
def busy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of two or more parts with events."""
    return series(spark, sf_dir).select("user_id", F.explode(lattice.runs_above(F.col("v"), 0.0, 2)).alias("r")).select("user_id", "r.start", "r.end")


@query(f"""
WITH e AS ({EVENTS}), m AS (
    SELECT user_id, count(*) AS n, list_sort(list_distinct(list(40 + pos * 17 + event_id % 3 - 1 + CASE WHEN event_id % 16 = 0 THEN 8 ELSE 0 END) FILTER (event_id % 9 <> 0))) AS ys FROM e GROUP BY user_id
), g AS (
    SELECT user_id, n, ys, median(gap) FILTER (gap > 2) AS step FROM (SELECT user_id, n, ys, unnest(list_transform(range(1, len(ys)), lambda i: ys[i + 1] - ys[i])) AS gap FROM m) GROUP BY ALL
), r AS (
    SELECT *, list_transform(range(1, len(ys) + 1), lambda i: list_reduce(list_transform(ys[i:], lambda y: [y]), lambda a, x: CASE WHEN round_even((x[1] - a[-1]) / step, 0) >= 1 AND abs(x[1] - a[-1] - round_even((x[1] - a[-1]) / step, 0) * step) <= 0.3 * step THEN a || x ELSE a END)) AS runs FROM g
), b AS (
    SELECT *, list_sort(list_transform(runs, lambda x: [-len(x), x[1]]))[1] AS best FROM r
), s AS (
    SELECT *, best[2] - greatest(0, round_even((best[2] - ys[1]) / step, 0)) * step AS start FROM b WHERE -best[1] >= 3
), p AS (SELECT *, list_transform(range(n), lambda i: CAST(round_even(start + i * step, 0) AS BIGINT)) AS grid FROM s)
SELECT user_id, array_to_string(grid, ',') AS grid FROM p WHERE len(list_filter(grid, lambda x: len(list_filter(ys, lambda y: abs(x - y) <= 0.3 * step)) > 0)) >= 0.8 * n
""")
def mark_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid on which a user's marks stand, where they stand on one."""
    k = F.col("event_id")
    y = 40 + F.col("pos") * 17 + k % 3 - 1 + F.when(k % 16 == 0, 8).otherwise(0)
    found = marks(spark, sf_dir, y, k % 9 != 0).select("user_id", lattice.grid(F.col("ys"), F.col("n")).alias("g"))
    return found.where("g is not null").select("user_id", F.array_join(F.col("g").cast("array<string>"), ",").alias("grid"))


@query(f"""
WITH e AS ({EVENTS}), m AS (
    SELECT user_id, list(pos * 20 + event_id % 3 - 1 ORDER BY pos) FILTER (event_id % 10 <> 0) AS ys, coalesce(list(pos * 20 + 10) FILTER (event_id % 37 = 0), []) AS rules FROM e GROUP BY user_id
), c AS (
    SELECT *, list_reduce(list_transform(ys, lambda y: [[y]]), lambda a, x: CASE WHEN x[1][1] - a[-1][-1] BETWEEN 16 AND 24 AND len(list_filter(rules, lambda r: a[-1][-1] < r AND r < x[1][1])) = 0 THEN a[:-2] || [a[-1] || x[1]] ELSE a || x END) AS chains FROM m
), b AS (
    SELECT *, list_reduce(list_transform(chains, lambda c: [c]), lambda a, x: CASE WHEN len(a) >= 2 AND len(a[-1]) = 1 AND a[-1][1] - a[-2][-1] > 24 AND a[-1][1] - a[-2][-1] < 3.4 * 20 AND x[1][1] - a[-1][1] > 24 AND x[1][1] - a[-1][1] < 3.4 * 20
        AND len(list_filter(rules, lambda r: a[-2][-1] < r AND r < x[1][1])) = 0 THEN a[:-3] || [a[-2] || x[1]] ELSE a || x END) AS joined FROM c
)
SELECT user_id, array_to_string(list_sort(list_transform(joined, lambda c: struct_pack(n := -len(c), y := c[1], c := c)))[1].c, ',') AS chain FROM b
""")
def mark_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest chain of a user's marks a pitch apart, with no rule in it."""
    k, y = F.col("event_id"), F.col("pos") * 20 + F.col("event_id") % 3 - 1
    rows = events(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.when(k % 10 != 0, y))).alias("ys"), F.collect_list(F.when(k % 37 == 0, F.col("pos") * 20 + 10)).alias("rules"))
    return rows.select("user_id", F.array_join(lattice.chain(F.col("ys"), F.lit(20), F.col("rules")).cast("array<string>"), ",").alias("chain"))


@query(f"""
WITH e AS ({EVENTS}), m AS (
    SELECT user_id, list_sort(list(pos // 2 * 120 + pos % 2 * (event_id % 60))) AS xs FROM e WHERE pos <= 16 GROUP BY user_id
), j AS (
    SELECT *, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] < 8 THEN a[:-2] || [(a[-1] + x[1]) // 2] ELSE a || x END) AS b FROM m
), w AS (SELECT *, list_sort(list_transform(range(1, len(b)), lambda i: b[i + 1] - b[i])) AS ws FROM j)
SELECT user_id, array_to_string(CASE WHEN len(b) > 3 AND ws[len(ws) // 2 + 1] > 0 THEN list_reduce(list_transform(b, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 0.4 * ws[len(ws) // 2 + 1] THEN a || x ELSE a END) ELSE b END, ',') AS bounds FROM w
""")
def rule_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column boundaries: double rules merged, slivers dropped."""
    x = F.floor(F.col("pos") / 2) * 120 + F.col("pos") % 2 * (F.col("event_id") % 60)
    rows = events(spark, sf_dir).where("pos <= 16").groupBy("user_id").agg(F.sort_array(F.collect_list(x)).alias("xs"))
    return rows.select("user_id", F.array_join(lattice.merged_boundaries(F.col("xs"), F.lit(1000)).cast("array<string>"), ",").alias("bounds"))


@query(f"""
WITH e AS ({EVENTS}), m AS (
    SELECT user_id, list(struct_pack(s := pos * 50 + event_id % 20, e := pos * 50 + event_id % 20 + CASE WHEN event_id % 17 = 0 THEN 25 ELSE 4 + event_id % 5 END) ORDER BY pos) AS g FROM e WHERE pos <= 12 GROUP BY user_id
), i AS (SELECT *, g[2:len(g) - 1] AS inn FROM m), t AS (SELECT *, list_sort(list_transform(inn, lambda x: x.e - x.s)) AS ws FROM i),
b AS (SELECT user_id, [g[1].e] || flatten(list_transform(inn, lambda x: CASE WHEN x.e - x.s > 2.6 * ws[len(ws) // 2 + 1] THEN [x.s + (x.e - x.s) // 3, x.e - (x.e - x.s) // 3] ELSE [(x.s + x.e) // 2] END)) || [g[-1].s] AS b FROM t)
SELECT user_id, CASE WHEN len(b) = 13 THEN array_to_string(b, ',') END AS bounds FROM b
""")
def gap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column boundaries from empty stretches, a wide one being a blank column."""
    start = F.col("pos") * 50 + F.col("event_id") % 20
    gap = F.struct(start.alias("start"), (start + F.when(F.col("event_id") % 17 == 0, 25).otherwise(4 + F.col("event_id") % 5)).alias("end"))
    rows = events(spark, sf_dir).where("pos <= 12").groupBy("user_id").agg(F.sort_array(F.collect_list(gap)).alias("g"))
    return rows.select("user_id", F.array_join(lattice.boundaries_of_gaps(F.col("g"), F.lit(12)).cast("array<string>"), ",").alias("bounds"))


CLAIMS = f"""
WITH RECURSIVE e AS ({EVENTS}), c AS (
    SELECT user_id, CASE WHEN event_id % 31 = 0 THEN 1 + event_id % 28 ELSE pos END AS d, 100 + pos * 24 + event_id % 3 - 1 AS y FROM e WHERE pos <= 28 AND event_id % (3 + user_id % 4) <> 1
    UNION ALL SELECT user_id, pos, 100 + pos * 24 + CASE WHEN event_id % 2 = 0 THEN 9 ELSE 201 END FROM e WHERE pos <= 28 AND event_id % 7 = 0
), g AS (
    SELECT *, sum(CASE WHEN y - before > 21.6 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, d ORDER BY y ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(y) OVER (PARTITION BY user_id, d ORDER BY y) AS before FROM c)
), r AS (
    SELECT user_id, d, CAST(round_even(avg(y), 0) AS BIGINT) AS y, count(*) OVER (PARTITION BY user_id, d) AS n FROM g GROUP BY user_id, d, k
), l AS (
    SELECT *, count_if(n = 1) OVER w AS singles, abs(y - (regr_intercept(y, d) FILTER (n = 1) OVER w + d * regr_slope(y, d) FILTER (n = 1) OVER w)) AS off FROM r WINDOW w AS (PARTITION BY user_id)
), a AS (
    SELECT user_id, d, y FROM l WHERE n = 1 UNION ALL
    (SELECT user_id, d, y FROM (SELECT * FROM l WHERE n > 1 AND singles >= 3 QUALIFY row_number() OVER (PARTITION BY user_id, d ORDER BY off, y) = 1) WHERE off <= 36)
), o AS (
    SELECT user_id, d, y FROM a WINDOW w AS (PARTITION BY user_id ORDER BY d) QUALIFY coalesce(y > lag(y) OVER w, TRUE) AND coalesce(y < lead(y) OVER w, TRUE)
), s AS (
    SELECT user_id, count(*) AS k, CASE WHEN min(d) = 1 AND max(d) = 28 THEN 1 ELSE min(d) END AS first, CASE WHEN min(d) = 1 AND max(d) = 28 THEN 28 ELSE max(d) END AS last FROM o GROUP BY user_id
), t AS (
    SELECT user_id, unnest(range(first, last + 1)) AS t FROM s WHERE k >= 0.7 * 28
), i AS (
    SELECT user_id, t, max(struct_pack(d := a.d, y := a.y)) FILTER (a.d <= t) AS lo, min(struct_pack(d := a.d, y := a.y)) FILTER (a.d >= t) AS hi FROM t JOIN o a USING (user_id) GROUP BY ALL
), m AS (
    SELECT user_id, t, CASE WHEN lo.d = t THEN lo.y ELSE CAST(round_even(lo.y + (hi.y - lo.y) * (t - lo.d) / (hi.d - lo.d), 0) AS BIGINT) END AS y, CASE WHEN lo.d = t THEN 'read' ELSE 'interpolated' END AS how FROM i
), bad AS (
    SELECT user_id FROM (SELECT user_id, y - lag(y) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM m) GROUP BY user_id HAVING min(gap) < 12 UNION SELECT user_id FROM s WHERE k < 0.7 * 28
), fit AS (
    SELECT o.user_id, o.d, o.y, 0 AS round, greatest(8, CAST(floor(0.65 * k) AS INTEGER)) AS least FROM o JOIN bad USING (user_id) JOIN s USING (user_id) WHERE k >= 8
    UNION ALL
    SELECT user_id, d, y, round + 1, least FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY off DESC, d) AS place, max(off) OVER (PARTITION BY user_id) AS worst FROM (
            SELECT *, regr_slope(y, d) OVER w AS b, abs(y - regr_intercept(y, d) OVER w - d * regr_slope(y, d) OVER w) AS off, count(*) OVER w AS n FROM fit WINDOW w AS (PARTITION BY user_id))
    ) WHERE worst > 0.35 * b AND n > least AND place > 1
), done AS (
    SELECT user_id, regr_slope(y, d) AS b, regr_intercept(y, d) AS a, list(struct_pack(d := d, y := y)) AS held FROM fit f WHERE round = (SELECT max(round) FROM fit x WHERE x.user_id = f.user_id) GROUP BY user_id
), line AS (
    SELECT user_id, unnest(range(1, 29)) AS t, a, b FROM done WHERE b >= 4 AND len(list_filter(held, lambda p: abs(p.y - a - b * p.d) > 0.35 * b)) = 0 AND round_even(a + b, 0) >= 0
)
SELECT user_id, t AS day, y, how FROM m ANTI JOIN bad USING (user_id)
UNION ALL SELECT user_id, t, CAST(round_even(a + b * t, 0) AS BIGINT), 'line' FROM line
"""


@query(CLAIMS)
def claimed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each day of a page stands, when some are read twice, wrongly or not at all."""
    k, pos, df = F.col("event_id"), F.col("pos"), events(spark, sf_dir).where("pos <= 28")
    claims = df.where(k % (3 + F.col("user_id") % 4) != 1).select("user_id", F.when(k % 31 == 0, 1 + k % 28).otherwise(pos).alias("day"), (100 + pos * 24 + k % 3 - 1).alias("y"))
    claims = claims.unionByName(df.where(k % 7 == 0).select("user_id", pos.alias("day"), (100 + pos * 24 + F.when(k % 2 == 0, 9).otherwise(201)).alias("y")))
    return lattice.resolved_days(by_page(claims, "user_id").withColumns({"pitch": F.lit(24.0), "n": F.lit(28)}), ["user_id"], "day", "y", "pitch", "n")

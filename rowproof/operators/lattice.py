"""Where the rows and columns of a page stand: periods, peaks, grids, chains and
boundaries of positions, and days that several readings claim.

A page's positions are an array in order, and each operator is a fold over it,
so one row is one page and nothing is shuffled but by page.  Positions are whole
numbers; what lies half-way goes to the even neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowproof.functions.scalars import once

LONGS = "array<bigint>"


def last(xs: Column) -> Column:
    return F.element_at(xs, -1)


def median_of(sorted_values: Column) -> Column:
    """The upper median of a sorted array."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) / 2).cast("int"))


def gaps(xs: Column) -> Column:
    """Differences of neighbours."""
    return F.zip_with(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))), lambda b, a: b - a)


def merged_boundaries(xs: Column, width: Column, merge: float = 0.008, sliver: float = 0.4) -> Column:
    """Sorted boundaries, those closer than a share of the width merged to their
    middle, and then those dropped that would cut off less than a share of the
    median column (of four boundaries or more)."""
    none = F.array().cast(LONGS)
    joined = F.aggregate(xs.cast(LONGS), none, lambda out, x: F.when((F.size(out) > 0) & (x - last(out) < merge * width), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.floor((last(out) + x) / 2)))).otherwise(F.concat(out, F.array(x))))

    def kept(out: Column) -> Column:
        typical = median_of(F.array_sort(gaps(out)))
        wide = once(typical, lambda m: F.aggregate(F.slice(out, F.lit(2), F.size(out)), F.slice(out, F.lit(1), F.lit(1)), lambda held, x: F.when(x - last(held) >= sliver * m, F.concat(held, F.array(x))).otherwise(held)))
        return F.when((F.size(out) > 3) & (typical > 0), wide).otherwise(out)

    return once(joined, kept)


def boundaries_of_gaps(empty: Column, cells: Column, split: float = 2.6) -> Column:
    """Column boundaries from the empty stretches (array of struct(start, end)) of a
    line: the inner ends of the outer two, the middle of each inner one, and two
    thirds of one much wider than the median, which is a blank column.  Null
    unless that gives ``cells`` columns."""
    inner = F.slice(empty, F.lit(2), F.greatest(F.size(empty) - 2, F.lit(0)))
    half = lambda a, b: F.floor((a + b) / 2)

    def cut(typical: Column) -> Column:
        def of(g: Column) -> Column:
            third = F.floor((g["end"] - g["start"]) / 3)
            return F.when((typical > 0) & (g["end"] - g["start"] > split * typical), F.array(g["start"] + third, g["end"] - third)).otherwise(F.array(half(g["start"], g["end"])))

        return F.concat(F.array(F.get(empty, F.lit(0))["end"]), F.flatten(F.transform(inner, of)), F.array(last(empty)["start"]))

    bounds = once(median_of(F.array_sort(F.transform(inner, lambda g: g["end"] - g["start"]))), cut)
    return F.when(F.size(empty) >= 3, once(bounds, lambda b: F.when(F.size(b) == cells + 1, b)))


def runs_above(values: Column, floor: float, least: int) -> Column:
    """Stretches (start, end without) of ``least`` or more values above ``floor``."""
    marks = F.transform(F.concat(values.cast("array<double>"), F.array(F.lit(None).cast("double"))), lambda v, i: F.struct(i.cast("bigint").alias("i"), F.coalesce(v > floor, F.lit(False)).alias("on")))
    start = F.struct(F.array().cast("array<struct<start: bigint, end: bigint>>").alias("out"), F.lit(None).cast("bigint").alias("since"))

    def step(s: Column, m: Column) -> Column:
        ended = ~m["on"] & s["since"].isNotNull() & (m["i"] - s["since"] >= least)
        out = F.when(ended, F.concat(s["out"], F.array(F.struct(s["since"].alias("start"), m["i"].alias("end"))))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.when(m["on"], F.coalesce(s["since"], m["i"])).alias("since"))

    return F.aggregate(marks, start, step, lambda s: s["out"])


def periods(values: Column, lo: int, hi: int, most: int = 6) -> Column:
    """Lags strictly between ``lo`` and ``hi`` at which the series (array of whole
    numbers) agrees with itself best: local maxima of its autocorrelation, best
    first, ``most`` at most; the best lag of all where there is none.  Values are
    taken times their number less their sum, so all sums are whole."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0).cast("double"), lambda s, v: s + v)
    centred = F.transform(values, lambda v: n * v - total)

    def lags(x: Column) -> Column:
        shifted = lambda k: F.zip_with(F.slice(x, F.lit(1), F.greatest(n - k, F.lit(0))), F.slice(x, k + 1, F.greatest(n - k, F.lit(0))), lambda a, b: a * b)
        return F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda k: F.struct(F.aggregate(shifted(k), F.lit(0).cast("double"), lambda s, v: s + v).alias("ac"), (-k).alias("back")))

    def best(c: Column) -> Column:
        rising = F.filter(c, lambda x, i: (i > 0) & (i < hi - lo) & (x["ac"] >= F.get(c, F.greatest(i - 1, F.lit(0)))["ac"]) & (x["ac"] > F.get(c, F.least(i + 1, F.lit(hi - lo)))["ac"]))
        order = lambda xs: F.transform(F.slice(F.sort_array(xs, asc=False), 1, most), lambda x: -x["back"])
        return F.when(F.size(rising) > 0, order(rising)).otherwise(F.slice(order(c), 1, 1))

    return once(once(centred, lags), best)


def smooth(values: Column, radius: Column) -> Column:
    """Means over ``radius`` neighbours on either side, fewer at the ends."""
    n = F.size(values)
    sums = F.aggregate(values, F.array(F.lit(0).cast("double")), lambda s, v: F.concat(s, F.array(last(s) + v)))

    def means(s: Column) -> Column:
        def mean(i: Column) -> Column:
            a, b = F.greatest(i - radius, F.lit(0)), F.least(i + radius + 1, n)
            return (F.get(s, b) - F.get(s, a)) / (b - a)

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), mean)).otherwise(F.array().cast("array<double>"))

    return once(sums, means)


def peaks(values: Column, pitch: Column) -> Column:
    """Local maxima (array of struct(y, height)) of the smoothed series, of which the
    higher one holds where two are less than 0.6 of the pitch apart."""
    def found(sm: Column) -> Column:
        n = F.size(sm)
        spots = F.transform(sm, lambda h, i: F.struct(h.alias("height"), (-i).cast("bigint").alias("back")))
        tops = F.filter(spots, lambda x, i: (i > 0) & (i < n - 1) & (x["height"] >= F.get(sm, F.greatest(i - 1, F.lit(0)))) & (x["height"] > F.get(sm, F.least(i + 1, n - 1))) & (x["height"] > 0))
        free = lambda held, x: F.forall(held, lambda y: F.abs(x["back"] - y["back"]) >= 0.6 * pitch)
        held = F.aggregate(F.sort_array(tops, asc=False), F.array().cast("array<struct<height: double, back: bigint>>"), lambda s, x: F.when(free(s, x), F.concat(s, F.array(x))).otherwise(s))
        return F.array_sort(F.transform(held, lambda x: F.struct((-x["back"]).alias("y"), x["height"].alias("height"))))

    return once(smooth(values, F.greatest(F.lit(2), F.bround(pitch / 5).cast("int"))), found)


def grid(ys: Column, want: Column, pitch: Column | None = None, tolerance: float = 0.3, explained: float = 0.8) -> Column:
    """``want`` evenly spaced positions through the peaks, or null: a step (the pitch or
    the median gap), the longest run of peaks at whole multiples of it, and the
    grid through its first one, if peaks lie near enough to enough of it."""
    ys = F.array_sort(F.array_distinct(ys.cast(LONGS)))

    def fitted(y: Column) -> Column:
        wide = F.array_sort(F.filter(gaps(y), lambda g: g > 2))
        m = F.size(wide)
        middle = F.when(m > 0, (F.get(wide, F.floor((m - 1) / 2).cast("int")) + F.get(wide, F.floor(m / 2).cast("int"))) / 2)
        step = F.when(m > 0, F.coalesce(F.nullif(pitch.cast("double"), F.lit(0.0)), middle) if pitch is not None else middle)

        def on_step(step: Column) -> Column:
            def run(k: Column) -> Column:
                fits = lambda d: once(F.greatest(F.bround(d / step), F.lit(1.0)), lambda times: F.abs(d - times * step) <= tolerance * step) & (F.bround(d / step) >= 1)
                return F.aggregate(F.slice(y, k + 2, F.size(y)), F.slice(y, k + 1, F.lit(1)), lambda held, x: F.when(fits(x - last(held)), F.concat(held, F.array(x))).otherwise(held))

            runs = F.transform(F.sequence(F.lit(0), F.size(y) - 1), lambda k: once(run(k), lambda r: F.struct(F.size(r).alias("n"), (-k).alias("back"), F.get(r, F.lit(0)).alias("anchor"))))

            def placed(best: Column) -> Column:
                start = best["anchor"] - F.greatest(F.lit(0.0), F.bround((best["anchor"] - F.get(y, F.lit(0))) / step)) * step
                made = F.transform(F.sequence(F.lit(0), want.cast("int") - 1), lambda i: F.bround(start + i * step).cast("bigint"))
                near = lambda g: F.exists(y, lambda x: F.abs(g - x) <= tolerance * step)
                return F.when(best["n"] >= 3, once(made, lambda g: F.when(F.size(F.filter(g, near)) >= explained * want, g)))

            return once(F.array_max(runs), placed)

        enough = F.size(y) >= F.greatest(F.lit(4), F.floor(want / 4).cast("int"))
        return once(step, lambda s: F.when(enough & (s > 2), on_step(s)))

    return once(ys, fitted)


def chain(ys: Column, pitch: Column, rules: Column, near: tuple[float, float] = (0.8, 1.2), lone: float = 3.4) -> Column:
    """The longest chain of positions about a pitch apart with no rule between.  A
    single position between two chains, with wider gaps (up to ``lone`` pitches) on
    both sides and no rule, is a summary line: it goes, and the chains are one.
    The first of the longest chains holds."""
    lo, hi = near[0] * pitch, near[1] * pitch
    ruled = lambda a, b: F.exists(rules, lambda r: (a < r) & (r < b))
    kind = "array<array<bigint>>"

    def link(out: Column, y: Column) -> Column:
        tail = last(out)
        joins = (F.size(out) > 0) & (y - last(tail)).between(lo, hi) & ~ruled(last(tail), y)
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(tail, F.array(y))))).otherwise(F.concat(out, F.array(F.array(y))))

    def bridge(out: Column, c: Column) -> Column:
        single, before = last(out), F.element_at(out, -2)
        up, down = F.get(single, F.lit(0)) - last(before), F.get(c, F.lit(0)) - F.get(single, F.lit(0))
        wide = (up > hi) & (up < lone * pitch) & (down > hi) & (down < lone * pitch) & ~ruled(last(before), F.get(c, F.lit(0)))
        return F.when((F.size(out) >= 2) & F.coalesce((F.size(single) == 1) & wide, F.lit(False)), F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 2, F.lit(0))), F.array(F.concat(before, c)))).otherwise(F.concat(out, F.array(c)))

    def longest(chains: Column) -> Column:
        sized = F.transform(chains, lambda c, i: F.struct(F.size(c).alias("n"), (-i).alias("back"), c.alias("c")))
        return F.array_max(sized)["c"]

    linked = F.aggregate(ys.cast(LONGS), F.array().cast(kind), link)
    return F.when(F.size(ys) >= 2, once(F.aggregate(linked, F.array().cast(kind), bridge), longest)).otherwise(F.array().cast(LONGS))


def trimmed(held: Column, most: Column, pitch: Column, rules: Column) -> Column:
    """A chain of more than ``most`` positions without the ends that are no rows: those
    in the shadow of a rule, last ones first, then those behind a blank line."""
    shadow = lambda y: F.exists(rules, lambda r: F.abs(y - r) < 0.55 * pitch)
    turns = F.sequence(F.lit(0), F.size(held))
    head, rest = (lambda c: F.slice(c, F.lit(1), F.size(c) - 1)), (lambda c: F.slice(c, F.lit(2), F.size(c)))
    end = lambda c: F.when((F.size(c) > most) & shadow(last(c)), head(c)).otherwise(c)
    begin = lambda c: F.when((F.size(c) > most) & shadow(F.get(c, F.lit(0))), rest(c)).otherwise(c)

    def blank(c: Column) -> Column:
        def cut(g: Column) -> Column:
            m = F.size(g)
            s = F.array_sort(g)
            typical = (F.get(s, F.floor((m - 1) / 2).cast("int")) + F.get(s, F.floor(m / 2).cast("int"))) / 2
            first, final = F.get(g, F.lit(0)), last(g)
            return F.when((final > 1.25 * typical) & (final >= first), head(c)).when(first > 1.25 * typical, rest(c)).otherwise(c)

        return F.when((F.size(c) > most) & (F.size(c) > 1), once(gaps(c), cut)).otherwise(c)

    out = F.aggregate(turns, held, lambda c, _: end(c))
    out = once(out, lambda c: F.aggregate(turns, c, lambda x, _: begin(x)))
    return once(out, lambda c: F.aggregate(turns, c, lambda x, _: blank(x)))


#: A line through positions and the days that it rests on.
FIT = "struct<slope: double, intercept: double>"


def line_through(points: Column) -> Column:
    """Least squares (slope, intercept) of struct(day, y), by running means in the
    order of the points; null where days don't vary."""
    none, long = F.lit(0.0), lambda x: x.cast("long")
    start = F.struct(F.lit(0).alias("n"), none.alias("d"), none.alias("y"), none.alias("dy"), none.alias("dd"), long(F.lit(0)).alias("days"), long(F.lit(0)).alias("ys"))

    def add(s: Column, p: Column) -> Column:
        n, away = s["n"] + 1, p["day"] - s["d"]
        d, y = s["d"] + away / n, s["y"] + (p["y"] - s["y"]) / n
        return F.struct(n.alias("n"), d.alias("d"), y.alias("y"), (s["dy"] + away * (p["y"] - y)).alias("dy"), (s["dd"] + away * (p["day"] - d)).alias("dd"), (s["days"] + p["day"]).alias("days"), (s["ys"] + p["y"]).alias("ys"))

    def fit(s: Column) -> Column:
        n = s["n"]
        slope = (s["dy"] / n) / (s["dd"] / n)
        return F.when((n > 1) & (s["dd"] > 1e-9), F.struct(slope.alias("slope"), (s["ys"] / n - slope * (s["days"] / n)).alias("intercept")))

    return once(F.aggregate(points, start, add), fit)


def robust_days(points: Column, off: float = 0.35, least: int = 8, share: float = 0.65) -> Column:
    """struct(slope, intercept, accepted): days are sorted by their distance from the
    line, and the worst one is dropped and the line fitted again while it lies more
    than ``off`` of a step beside it and enough days are left."""
    floor = F.greatest(F.lit(least), F.floor(share * F.size(points)).cast("int"))
    away = lambda p, f: F.abs(p["y"] - f["intercept"] - p["day"] * f["slope"])

    def drop(held: Column) -> Column:
        def without(f: Column) -> Column:
            worst_first = F.array_sort(F.transform(held, lambda p: F.struct((-away(p, f)).alias("near"), p["day"].alias("day"), p["y"].alias("y"))))
            rest = lambda x: F.transform(F.slice(x, 2, F.size(x)), lambda p: F.struct(p["day"].alias("day"), p["y"].alias("y")))
            return once(worst_first, lambda x: F.when((-F.get(x, F.lit(0))["near"] > off * f["slope"]) & (F.size(x) > floor), rest(x)).otherwise(held))

        return once(line_through(held), lambda f: F.when(f.isNotNull(), without(f)).otherwise(held))

    def judged(held: Column) -> Column:
        def said(f: Column) -> Column:
            most = F.array_max(F.transform(held, lambda p: away(p, f)))
            return F.when(f.isNotNull(), F.struct(f["slope"].alias("slope"), f["intercept"].alias("intercept"), ((f["slope"] >= 4.0) & (most <= off * f["slope"])).alias("accepted")))

        return once(line_through(held), said)

    kept = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(points) - floor, F.lit(0)) + 1), points, lambda held, _: drop(held))
    return F.when(F.size(points) >= least, once(kept, judged))


def resolved_days(claims: DataFrame, page: list[str], day: str, y: str, pitch: str, n_days: str, direct: float = 0.7) -> DataFrame:
    """Where each day of a page stands, from claims (rows of a page, day and position;
    the page's pitch and number of days beside them).

    Claims of a day within 0.9 of the pitch are one row, at their middle.  A day
    with one such row is settled; of several, that nearest to the line through
    the settled days (three or more) holds if it is within one and a half
    pitches.  A day that stands out of order between its neighbours is dropped.
    If enough days are left, the others between them are interpolated; where that
    puts rows on top of each other, or too few days are left, the rows are those
    of the line through the days, if it is straight, and want reading again.

    Per page and day: position and how it was found (read, interpolated, line).
    Pages of which nothing can be told have no rows."""
    at, d, p = Window.partitionBy(*page, day), F.col(day), F.col(pitch)
    rows = claims.where(d.between(1, F.col(n_days)) & F.col(y).isNotNull()).select(*page, d.cast("int").alias(day), F.col(y).cast("bigint").alias(y), p, n_days)
    new = F.coalesce(F.col(y) - F.lag(y).over(at.orderBy(y)) > 0.9 * p, F.lit(True))
    rows = rows.withColumn("__new", new).withColumn("__row", F.sum(F.col("__new").cast("int")).over(at.orderBy(y).rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy(*page, day, "__row").agg(F.bround(F.avg(y)).cast("bigint").alias(y), F.first(pitch).alias(pitch), F.first(n_days).alias(n_days))
    rows = rows.withColumn("__n", F.count("*").over(at))
    whole, one = Window.partitionBy(*page), F.col("__n") == 1
    s = lambda c: F.sum(F.when(one, c)).over(whole)
    rows = rows.withColumns({"__k": F.count_if(one).over(whole), "__d": s(d), "__y": s(F.col(y)), "__dy": s(d * F.col(y)), "__dd": s(d * d)})
    k = F.col("__k")
    var = F.col("__dd") - F.col("__d") * F.col("__d") / k
    slope = (F.col("__dy") - F.col("__d") * F.col("__y") / k) / F.when(var > 1e-9, var)
    rows = rows.withColumn("__off", F.abs(F.col(y) - ((F.col("__y") + slope * (k * d - F.col("__d"))) / k)))
    nearest = F.struct("__off", y) == F.min(F.struct("__off", y)).over(at)
    rows = rows.withColumn("__holds", one | F.coalesce((k >= 3) & nearest & (F.col("__off") <= 1.5 * p), F.lit(False))).where("__holds")
    order = whole.orderBy(day)
    in_order = F.coalesce(F.col(y) > F.lag(y).over(order), F.lit(True)) & F.coalesce(F.col(y) < F.lead(y).over(order), F.lit(True))
    rows = rows.withColumn("__ok", in_order)
    # collect_list skips what is null; a page's days bound the array.
    point = F.when(F.col("__ok"), F.struct(d.cast("int").alias("day"), F.col(y).alias("y")))
    sheets = rows.groupBy(*page).agg(F.sort_array(F.collect_list(point)).alias("known"), F.first(pitch).alias("pitch"), F.first(n_days).cast("int").alias("n"))
    known, n = F.col("known"), F.col("n")
    days = F.transform(known, lambda x: x["day"])
    both_ends = F.array_contains(days, 1) & F.array_contains(days, n)
    first, final = F.when(both_ends, 1).otherwise(F.get(days, F.lit(0))), F.when(both_ends, n).otherwise(last(days))
    row = lambda t, at, how: F.struct(t.cast("int").alias("day"), at.cast("bigint").alias("y"), how.alias("how"))

    def between(t: Column) -> Column:
        a, b = last(F.filter(known, lambda x: x["day"] <= t)), F.get(F.filter(known, lambda x: x["day"] >= t), F.lit(0))
        return once(F.struct(a.alias("a"), b.alias("b")), lambda e: F.when(e["a"]["day"] == t, row(t, e["a"]["y"], F.lit("read"))).otherwise(row(t, F.bround(e["a"]["y"] + (e["b"]["y"] - e["a"]["y"]) * (t - e["a"]["day"]) / (e["b"]["day"] - e["a"]["day"])), F.lit("interpolated"))))

    computed = lambda df, name, x: df.withColumn(name, F.explode_outer(F.array(x)))  # noqa: E731  here, once a page
    enough = (F.size(known) > 0) & (F.size(known) >= direct * n)
    sheets = computed(sheets, "made", F.when(enough, F.transform(F.sequence(first, final), between)))
    sheets = computed(sheets, "overlap", F.coalesce(F.exists(gaps(F.transform("made", lambda x: x["y"])), lambda g: g < 0.5 * F.col("pitch")), F.lit(True)))
    overlap = F.col("overlap")  # also where nothing was made
    sheets = computed(sheets, "fit", F.when(overlap, robust_days(known)))
    f = F.col("fit")
    on_line = F.when(f["accepted"], F.transform(F.sequence(F.lit(1), n), lambda t: row(t, F.bround(f["intercept"] + f["slope"] * t), F.lit("line"))))
    on_line = F.when(F.get(on_line, F.lit(0))["y"] >= 0, on_line)
    return sheets.select(*page, F.explode(F.when(~overlap, F.col("made")).otherwise(on_line)).alias("r")).select(*page, "r.day", "r.y", "r.how")

"""Two readings of one page, people's corrections, printed arithmetic whose order
is lost, and the geometry of rows: everything that judges a reading by another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions.scalars import once

from .lineage import cut


def classified(df: DataFrame, columns: list[str], a: str, b: str) -> DataFrame:
    """Adds shifts (``k<->m``: a value of column k stands in its neighbour m in
    the other reading) and changed (columns that differ without that).
    ``a`` and ``b`` are the prefixes of the two readings; a cell that only one
    of them has is no evidence."""
    shifts, changed = [], []
    for i, k in enumerate(columns):
        va, vb = F.col(a + k), F.col(b + k)
        moved = F.lit(None).cast("string")
        for j in (i - 1, i + 1):  # the right neighbour is asked first, so it is the outer condition
            if 0 <= j < len(columns):
                there = F.coalesce(va == F.col(b + columns[j]), F.lit(False)) | F.coalesce(vb == F.col(a + columns[j]), F.lit(False))
                moved = F.when(there, F.lit(f"{k}<->{columns[j]}")).otherwise(moved)
        differ = va != vb
        shifts.append(F.when(differ, moved))
        changed.append(F.when(differ & moved.isNull(), F.lit(k)))
    there = lambda cells: F.filter(F.array(*cells), lambda x: x.isNotNull())
    return df.withColumns({"shifts": there(shifts), "changed": there(changed)})


def page_stability(df: DataFrame, page: list[str], unstable: float = 0.5) -> DataFrame:
    """Per page of classified rows: n, n_shift, n_changed, unstable (most rows
    disagree one way) and suspects (disagreeing rows of a stable page)."""
    odd_s, odd_c = F.size("shifts") > 0, F.size("changed") > 0
    per = df.groupBy(*page).agg(F.count("*").alias("n"), F.count_if(odd_s).alias("n_shift"), F.count_if(odd_c).alias("n_changed"), F.count_if(odd_s | odd_c).alias("__odd"))
    bad = F.greatest("n_shift", "n_changed") / F.col("n") >= unstable
    return per.withColumn("unstable", bad).withColumn("suspects", F.when(bad, 0).otherwise(F.col("__odd"))).drop("__odd")


def corrected(rows: DataFrame, log: DataFrame, key: list[str], field: str, now: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows with the cells that a person set; adds corrections (a note for each
    cell that changed, apart from a row's problems) and human_verified.

    Of several corrections of a cell the last in ``order`` holds, also a null
    one.  The log is reduced to a row a key before it is joined."""
    last = lambda c: F.max(F.when(F.col(field) == c, F.struct(*order, F.col(now).alias("__now")))).alias(f"__log_{c}")
    out = rows.join(log.groupBy(*key).agg(*map(last, columns)), key, "left")
    kinds = dict(rows.dtypes)
    value = {c: F.col(f"__log_{c}")["__now"].cast(kinds[c]) for c in columns}
    change = {c: F.col(f"__log_{c}").isNotNull() & ~F.col(c).eqNullSafe(value[c]) for c in columns}
    said = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    notes = [F.when(change[c], F.concat(F.lit(f"human correction: {c} was "), said(F.col(c)), F.lit(", set to "), said(value[c]))) for c in columns]
    out = out.withColumn("corrections", F.filter(F.array(*notes), lambda x: x.isNotNull()))
    out = out.withColumns({c: F.when(change[c], value[c]).otherwise(F.col(c)) for c in columns})
    return out.withColumn("human_verified", F.size("corrections") > 0).drop(*[f"__log_{c}" for c in columns])


def unmatched_means(wants: list[tuple[str, Column, float]], printed: Column) -> Column:
    """Names of the expected values, in order, that no printed number is near.
    Each takes the nearest number left, the first of ties; a number is spent
    once, and only where it is within the tolerance.  Null expectations are
    skipped.  ``printed`` is the one printed row's numbers, in any order."""
    names = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), w.cast("double").alias("want"), F.lit(float(t)).alias("limit")) for n, w, t in wants]), lambda w: w["want"].isNotNull())
    start = F.struct(F.filter(printed.cast("array<double>"), lambda v: v.isNotNull()).alias("pool"), F.array().cast("array<string>").alias("out"))

    def spend(state: Column, w: Column) -> Column:
        def with_nearest(near: Column) -> Column:
            hit = F.coalesce(near["d"] <= w["limit"], F.lit(False))
            pool = F.when(hit, F.filter(state["pool"], lambda _v, i: i != near["i"])).otherwise(state["pool"])
            return F.struct(pool.alias("pool"), F.when(hit, state["out"]).otherwise(F.concat(state["out"], F.array(w["name"]))).alias("out"))

        return once(F.array_min(F.transform(state["pool"], lambda v, i: F.struct(F.abs(v - w["want"]).alias("d"), i.alias("i")))), with_nearest)

    return F.aggregate(names, start, spend)["out"]


def closure(df: DataFrame, readings: list[str], printed: str, tolerance: float) -> DataFrame:
    """Adds closes: whether the mean of a row's readings is the printed one; null where one is missing."""
    mean = sum((F.col(c) for c in readings[1:]), F.col(readings[0])) / len(readings)
    return df.withColumn("closes", F.abs(mean - F.col(printed)) < tolerance)


def graded(df: DataFrame, period: str, day: Column, got: Column, truth: Column, within: float = 0.05) -> DataFrame:
    """Per period, and in total (is_total), how many rows give the true value: on
    all days and on those with any. A row without a day, or a day without a true
    value, is not graded; a blank reading is zero."""
    known = day.isNotNull() & truth.isNotNull()
    good = F.coalesce(F.abs(F.coalesce(got, F.lit(0.0)) - truth) < within, F.lit(False))
    n = lambda c: F.count_if(c)
    out = df.rollup(period).agg(F.grouping(period).cast("boolean").alias("is_total"), F.count("*").alias("n_rows"), n(known).alias("n_graded"), n(known & good).alias("n_exact"), n(known & (truth > 0)).alias("n_wet"), n(known & (truth > 0) & good).alias("n_wet_exact"), n(day.isNull()).alias("n_no_day"))
    return out


def period_audit(pages: DataFrame, period: str, caption: str, found: Column) -> DataFrame:
    """Adds bucket (agree, fixed, ambiguous, nocap), year_odd, and the period as
    the caption's month has it; the year is never changed and the published
    period is kept.  ``found`` is the period read from ``caption``."""
    pages = pages.withColumn("__found", F.explode_outer(F.array(found)))  # computed once
    found = F.col("__found")
    want = F.concat(F.substring_index(F.col(period), "-", 1), F.lit("-"), F.substring_index(found, "-", -1))
    bucket = F.when(F.coalesce(F.col(caption), F.lit("")) == "", "nocap").when(found.isNull(), "ambiguous").when(want != F.col(period), "fixed").otherwise("agree")
    out = pages.withColumn("bucket", bucket).withColumn("year_odd", F.col("bucket").isin("fixed", "agree") & (F.substring_index(found, "-", 1) != F.substring_index(F.col(period), "-", 1)))
    return out.withColumn("period_as_published", F.when(F.col("bucket") == "fixed", F.col(period))).withColumn(period, F.when(F.col("bucket") == "fixed", want).otherwise(F.col(period))).drop("__found")


def triaged(df: DataFrame, buckets: list[tuple[str, Column]], rest: str) -> DataFrame:
    """Adds bucket: the first whose condition holds."""
    out = F
    for name, condition in buckets:
        out = out.when(condition, name)
    return df.withColumn("bucket", out.otherwise(rest))


def matched_once(pairs: DataFrame, left: list[str], right: list[str], distance: str) -> DataFrame:
    """Greedy one-to-one matching: the nearest pair first, then the nearest of
    those whose sides are both free, and so on; ties by the sides.

    A pair that is the nearest of both its sides is in the greedy result
    whatever else is, so each round takes all such pairs at once.  Rounds are
    as many as the longest chain of displaced choices.  Nearest pairs are
    aggregated before they are joined back, so a side with many candidates
    costs no task of its own; null and NaN distances match nothing."""
    keys = list(dict.fromkeys([*left, *right]))
    place = F.struct(distance, *keys)
    rest = cut(pairs.where(F.col(distance).isNotNull() & ~F.isnan(F.col(distance).cast("double"))).select(*keys, distance).distinct())
    found = []
    while True:
        near = lambda side, name: rest.groupBy(*side).agg(F.min(place).alias(name))  # noqa: E731, B023
        best = rest.join(near(left, "__l"), left).join(near(right, "__r"), right).where((F.col("__l") == place) & (F.col("__r") == place))
        best = cut(best.select(*keys, distance))
        if best.isEmpty():
            break
        found.append(best)
        rest = cut(rest.join(best.select(*left), left, "left_anti").join(best.select(*right), right, "left_anti"))
    out = found[0] if found else rest
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def matched_in_page(pairs: DataFrame, page: list[str], left: str, right: str, distance: str) -> DataFrame:
    """``matched_once`` where both sides are rows of one page: a fold over the page's
    pairs from near to far, so it takes one shuffle and no rounds."""
    near = F.struct(F.col(distance).alias("d"), F.col(left).alias("l"), F.col(right).alias("r"))
    there = pairs.where(F.col(distance).isNotNull() & ~F.isnan(F.col(distance).cast("double")))
    held = there.groupBy(*page).agg(F.sort_array(F.collect_set(near)).alias("__pairs"))
    kind = dict(held.dtypes)["__pairs"]
    free = lambda out, p: ~F.exists(out, lambda x: (x["l"] == p["l"]) | (x["r"] == p["r"]))
    picked = F.aggregate("__pairs", F.array().cast(kind), lambda out, p: F.when(free(out, p), F.concat(out, F.array(p))).otherwise(out))
    out = held.select(*page, F.explode(picked).alias("p"))
    return out.select(*page, F.col("p.l").alias(left), F.col("p.r").alias(right), F.col("p.d").alias(distance))


def line_through(df: DataFrame, page: list[str], x: str, y: str, low: int, high: int, residual: float = 0.35, least: int = 8, share: float = 0.65, slope: float = 4.0) -> DataFrame:
    """Per page a line through its rows' places that no misread row can drag: the
    worst row is dropped and the line fitted again while it is off by more than
    ``residual`` of the spacing and enough rows remain.

    Adds slope, intercept, max_resid, n_days, n_supporting and accept (null and
    false under ``least`` rows).  One place an index is kept (the smallest), and
    only indexes in [low, high], so a page is at most that many points."""
    one = df.where(F.col(x).between(low, high) & F.col(y).isNotNull()).groupBy(*page, F.col(x).cast("double").alias("x")).agg(F.min(F.col(y).cast("double")).alias("y"))
    points = one.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("__p"))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, p: s + f(p))

    def fitted(kept: Column) -> Column:
        n = F.size(kept)
        means = F.struct((total(kept, lambda p: p["x"]) / n).alias("x"), (total(kept, lambda p: p["y"]) / n).alias("y"))

        def with_means(m: Column) -> Column:
            var = total(kept, lambda p: (p["x"] - m["x"]) * (p["x"] - m["x"]))
            k = F.when(var > 0, total(kept, lambda p: (p["x"] - m["x"]) * (p["y"] - m["y"])) / var)
            return once(k, lambda s: F.struct(s.alias("slope"), (m["y"] - s * m["x"]).alias("intercept")))

        def with_worst(f: Column) -> Column:
            worst = F.array_max(F.transform(kept, lambda p: F.struct(F.abs(p["y"] - (f["intercept"] + f["slope"] * p["x"])).alias("off"), (-p["x"]).alias("x"))))
            return F.struct(f["slope"].alias("slope"), f["intercept"].alias("intercept"), worst.alias("worst"))

        return once(once(means, with_means), with_worst)

    floor = F.greatest(F.lit(least), F.floor(F.lit(share) * F.size("__p")).cast("int"))

    def drop(kept: Column, _step: Column) -> Column:
        def of(f: Column) -> Column:
            bad = (F.size(kept) > floor) & (f["worst"]["off"] > residual * f["slope"])
            return F.when(bad, F.filter(kept, lambda p: p["x"] != -f["worst"]["x"])).otherwise(kept)

        return once(fitted(kept), of)

    n = F.size("__p")
    kept = F.when(n >= least, F.aggregate(F.sequence(F.lit(1), n), F.col("__p"), drop))
    out = points.withColumn("__k", F.explode_outer(F.array(kept))).withColumn("__f", F.explode_outer(F.array(F.when(F.col("__k").isNotNull(), fitted(F.col("__k"))))))
    f = F.col("__f")
    accept = F.coalesce((f["slope"] >= slope) & (f["worst"]["off"] <= residual * f["slope"]), F.lit(False))
    return out.select(*page, f["slope"].alias("slope"), f["intercept"].alias("intercept"), f["worst"]["off"].alias("max_resid"), n.alias("n_days"), F.size("__k").alias("n_supporting"), accept.alias("accept"))


def top_groups(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The ``n`` most frequent keys (a top-n report; ties by name)."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *key).limit(n)

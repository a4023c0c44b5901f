"""The whole judgement of rows as printed: by themselves and within their page.

Rows are parsed against a layout and the conventions of print undone: hundreds
that are left out, repeat signs, whole parts carried down a column, indexes that
the page's own sequence gives.  Which rows are days, and whether a page is
complete, follows from the longest run of indexes; printed totals are compared
with the days; duplicates are told by their neighbours.  What a page tells goes
back to its rows in the same partitioning: all windows are by page, so the plan
has one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowproof.functions import captions, parse, scalars
from rowproof.layout import Layout
from rowproof.operators import checks, pages, publish


def day_value(page: list[str], pos: str, index: str, is_ditto: Column, lo: float, hi: float) -> Column:
    """A row's index where it is legal; a repeat sign takes the last legal one above."""
    above = Window.partitionBy(*page).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    legal = F.when(F.col(index).between(lo, hi) & ~is_ditto, F.floor(index))
    return F.when(is_ditto, F.last(legal, ignorenulls=True).over(above)).otherwise(legal)


def longest_run(df: DataFrame, page: list[str], pos: str, day: str, **more: Column) -> DataFrame:
    """Adds is_day: days are the rows of the first longest run whose next ``day`` is
    the same or one more; a row without one ends a run.  A run is known by where it
    begins, so the rows stay in their order.  ``more`` columns are added in the
    first pass over the page."""
    by_pos, whole = Window.partitionBy(*page).orderBy(pos), Window.partitionBy(*page)
    goes_on = F.coalesce((F.col(day) - F.lag(day).over(by_pos)).isin(0, 1), F.lit(False))
    out = df.withColumns({"__goes_on": goes_on, "__at": F.row_number().over(by_pos)} | more)
    begins = F.when(~F.col("__goes_on"), F.struct(F.col("__at").alias("at"), F.col(pos).alias("pos")))
    out = out.withColumn("__begins", F.last(begins, ignorenulls=True).over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    begins = F.col("__begins")
    so_far = F.when(F.col(day).isNotNull(), F.struct((F.col("__at") - begins["at"]).alias("n"), (-begins["pos"]).alias("start")))
    longest = F.max(so_far).over(whole)
    out = out.withColumn("is_day", F.coalesce(F.col(day).isNotNull() & (-begins["pos"] == longest["start"]), F.lit(False)))
    return out.drop("__goes_on", "__at", "__begins")


def complete(page: list[str], day: str, expected: Column, first: float) -> Column:
    """Whether the days of a page are as many different indexes as expected and begin
    with the first one."""
    there, whole = F.when(F.col("is_day"), F.col(day)), Window.partitionBy(*page)
    low, high = F.min(there).over(whole), F.max(there).over(whole)
    return F.coalesce((high - low + 1 == expected) & (low == first), F.lit(False))


def day_rows(df: DataFrame, page: list[str], pos: str, index: str, is_ditto: Column, lo: float, hi: float, expected: Column, first: float) -> DataFrame:
    """Adds is_day and complete."""
    out = longest_run(df.withColumn("__day", day_value(page, pos, index, is_ditto, lo, hi)), page, pos, "__day")
    return out.withColumn("complete", complete(page, "__day", expected, first)).drop("__day")


def totals_broken(layout: Layout, page: list[str], pos: str, is_day: Column, summary: Column, values: dict[str, Column], tolerance: float = 0.06) -> Column:
    """Columns whose printed total (the page's first summary row) is not that of its
    days.  A column with a blank among the days is not judged, unless its blanks
    are zeros."""
    whole = Window.partitionBy(*page)
    made = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}
    keys = list(layout.monthly.get("aggregate", {}))
    printed = F.min(F.when(summary, F.struct(F.col(pos).alias("pos"), F.struct(*[values[k].alias(k) for k in keys]).alias("said")))).over(whole)["said"]
    out = []
    for k in keys:
        v = F.coalesce(values[k], F.lit(0.0)) if k in layout.monthly.get("blank_is_zero", ()) else values[k]
        full = F.count_if(is_day & v.isNull()).over(whole) == 0
        want = made[layout.monthly["aggregate"][k]](F.when(is_day, v)).over(whole)
        limit = float(layout.monthly.get("tolerance", {}).get(k, tolerance))
        out.append(F.when(full & (F.abs(want - printed[k]) > limit), F.lit(k)))
    return scalars.named(out)


def rejudged(
    df: DataFrame, layout: Layout, page: list[str], pos: str, expected: Column, raw: str = "raw", altitude: Column | None = None,
    period: Column | None = None, span: tuple[Column, Column] | None = None, corrections: Column | None = None,
) -> DataFrame:
    """``df`` (rows with their page, place and text) with ``judged``, a struct of

    values (by column, conventions undone and corrections applied), is_day,
    complete, verdict, problems (codes, soft ones of the parser included),
    violations, failures, totals (columns whose printed total is broken) and
    corrected (columns that a correction changed).

    ``expected``: indexes that the page should have; ``altitude`` of the station,
    ``period`` and ``span`` of the volume, and ``corrections`` (map of numbers by
    column) are columns of ``df`` and judge nothing where they are null."""
    index = layout.index
    lo, hi = (index.low, index.high) if index.low is not None else (1.0, 31.0)
    own = df.columns
    out = parse.parse_rows(df, layout, raw)
    cells = F.col("parsed")["cells"]
    printed = publish.from_printed(layout, {c.key: cells[c.key]["txt" if c.kind == "text" else "num"] for c in layout.columns})
    value = {c.key: f"__v_{i}" for i, c in enumerate(layout.columns)}
    out = out.withColumns({value[k]: v for k, v in printed.items()} | {"__ditto": cells[index.key]["kind"] == "ditto", "__summary": parse.is_summary(F.col(raw), layout.summary_words), "__problems": F.col("parsed")["problems"], "__filled": F.lit(False)})
    i = value[index.key]
    if layout.index_kind != "day_of_month":
        out = out.withColumn("__printed", F.col(i))
        out = pages.index_filled(out, page, pos, i, lo, hi)
        out = out.withColumn("__filled", ~F.col("__printed").eqNullSafe(F.col(i)))
        out = out.withColumn("__ditto", F.col("__ditto") & ~F.col("__filled")).drop("__printed")
    first = 1.0 if layout.index_kind == "day_of_month" else lo
    ditto, days = F.col("__ditto"), layout.rows_per_page == "days_in_month"
    carries = {value[c.key]: pages.carried_value(page, pos, value[c.key], c.low, c.high) for c in layout.columns if c.carried}
    # Totals are printed of values as they stand, so what is filled and carried has names of its own until then.
    out = out.withColumns({"__day": day_value(page, pos, i, ditto, lo, hi), "__index": pages.ditto_value(page, pos, i, ditto)} | {f"{k}_full": x for k, x in carries.items()})
    out = longest_run(out, page, pos, "__day", **({"__ok": pages.in_order(page, pos, "__index")} if days else {}))
    v = {k: F.col(c) for k, c in value.items()}
    out = out.withColumns({"complete": complete(page, "__day", expected, first), "__totals": totals_broken(layout, page, pos, F.col("is_day"), F.col("__summary"), v)})
    out = out.withColumns({i: F.col("__index")} | {k: F.col(f"{k}_full") for k in carries})
    out = pages.spurious_duplicates(out, page, pos, i, F.col("__ok")) if days else out.withColumn("spurious", F.lit(False))
    none = F.lit(None).cast("array<string>")
    corrected = none
    if corrections is not None:
        numbers = [c.key for c in layout.columns if c.kind != "text"]
        changed = {k: F.coalesce(corrections[k].isNotNull() & ~corrections[k].eqNullSafe(v[k]), F.lit(False)) for k in numbers}
        out = out.withColumn("__corrected", scalars.named([F.when(changed[k], F.lit(k)) for k in numbers]))
        out = out.withColumns({value[k]: F.coalesce(corrections[k], v[k]) for k in numbers})
        corrected = F.col("__corrected")
    v |= {"zero": F.lit(0.0)}
    by_key = {c.key: c for c in layout.columns}
    code = lambda bad, said: F.when(bad, F.lit(said))
    hard = [code(checks.degenerate([v[c.key] for c in layout.columns if c.kind == "number"]), "degenerate_row")]
    hard += [code(scalars.invalid_compass(v[k]), f"invalid_compass: {k}") for k in layout.directions]
    if altitude is not None:
        hard += [code(v[k].between(by_key[k].low, by_key[k].high) & scalars.implausible_pressure(v[k], altitude), f"pressure_implausible: {k}") for k in sorted(layout.barometers)]
    hard.append(code(F.col("spurious"), "duplicate_day"))
    if period is not None and span is not None:
        hard.append(code(captions.outside_span(period, *span), "period_suspect"))
    out = out.withColumn("__hard", F.concat(F.filter("__problems", lambda p: ~parse.soft(p)), scalars.named(hard)))
    more = [code(~F.col("is_day"), "not_a_day_row"), code(F.col("__filled"), "index_from_page_sequence"), code(~F.col("complete"), "page_day_sequence_incomplete")]
    out = out.withColumns({"__failures": checks.check_failures(layout, v), "__violations": checks.range_violations(layout, v)})
    verdict = checks.verdict(F.col("is_day"), checks.scoreable(layout, v), F.col("__failures"), F.col("__violations"), F.size("__hard") > 0)
    judged = F.struct(
        F.struct(*[v[c.key].alias(c.key) for c in layout.columns]).alias("values"), "is_day", "complete", verdict.alias("verdict"),
        F.concat(F.filter("__problems", parse.soft), "__hard", scalars.named(more)).alias("problems"),
        F.col("__violations").alias("violations"), F.col("__failures").alias("failures"), F.col("__totals").alias("totals"), F.coalesce(corrected, F.array().cast("array<string>")).alias("corrected"),
    )
    return out.select(*[F.col(f"`{c}`") for c in own], judged.alias("judged"))

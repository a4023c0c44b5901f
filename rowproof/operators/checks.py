"""Checks of single rows: ranges, declared arithmetic, degenerate rows, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions.scalars import named
from rowproof.layout import Check, Layout

TOLERANCE = 0.051


def range_violations(layout: Layout, values: dict[str, Column]) -> Column:
    """Keys of the columns outside their inclusive range, in column order."""
    out = [F.when((values[c.key] < c.low) | (values[c.key] > c.high), F.lit(c.key)) for c in layout.columns if c.kind != "text" and c.low is not None]
    return named(out)


def failed(check: Check, values: dict[str, Column], tolerance: float = TOLERANCE) -> Column:
    """Whether a row breaks a check; false where an operand is missing."""
    x, of = values[check.result], [values[k] for k in check.of]
    if check.kind == "order":
        bad = (of[0] > x + tolerance) | (x > of[1] + tolerance)
    elif check.kind == "atleast":
        bad = x < of[0] - tolerance
    else:
        total = sum(of[1:], of[0])
        want = {"diff": of[0] - of[-1], "sum": total, "mean": total / len(of)}[check.kind]
        bad = F.abs(x - want) > tolerance
    return F.coalesce(bad, F.lit(False))


def check_failures(layout: Layout, values: dict[str, Column], tolerance: float = TOLERANCE) -> Column:
    out = [F.when(failed(c, values, tolerance), F.lit(f"{c.kind}:{c.result}")) for c in layout.checks]
    return named(out)


def scoreable(layout: Layout, values: dict[str, Column]) -> Column:
    """Whether any check's result is there."""
    return F.coalesce(*[F.when(values[c.result].isNotNull(), True) for c in layout.checks], F.lit(False)) if layout.checks else F.lit(False)


def degenerate(values: list[Column], least: int = 8) -> Column:
    """Many numbers, two distinct ones at most."""
    there = F.filter(F.array(*values), lambda x: x.isNotNull())
    return (F.size(there) >= least) & (F.size(F.array_distinct(there)) <= 2)


def verdict(is_day: Column, scores: Column, failures: Column, violations: Column, hard: Column) -> Column:
    """checks_pass, qc_clean or flagged."""
    clean = (F.size(violations) == 0) & (F.size(failures) == 0) & ~hard
    return F.when(~is_day | ~clean, "flagged").when(scores, "checks_pass").otherwise("qc_clean")


def outside_layout(cells: DataFrame, layouts: DataFrame, key: list[str], value: str) -> DataFrame:
    """Cells in long form whose value lies outside the range that their layout declares
    for their column: a range join with the layouts' columns, a table of a few
    rows for each layout (``Layout.table``)."""
    known = F.broadcast(layouts.where("low is not null").select(*key, "low", "high"))
    return cells.join(known, key).where(~F.col(value).between(F.col("low"), F.col("high")))

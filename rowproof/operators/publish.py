"""From judged rows to a published dataset: order, counts, series, agreement, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowproof.functions import parse, scalars
from rowproof.layout import Layout

# Verdicts that make a row usable, and where labelled rows stand on a page.
USABLE = ("checks_pass", "qc_clean")
LABELS, OTHER_LABEL = {"1": 1, "2": 2, "3": 3, "mez": 99}, 98


def usable(verdict: Column) -> Column:
    return F.coalesce(verdict.isin(*USABLE), F.lit(False))


def entry_id(*parts: Column) -> Column:
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def row_ordinal(row: Column) -> Column:
    """A row's place: its number, or the place of its label; a missing one comes first."""
    said = F.lower(F.regexp_replace(F.trim(row.cast("string")), "[.]+$", ""))
    place = reduce(lambda out, kv: out.when(said == kv[0], kv[1]), LABELS.items(), F.when(said.isNull(), -1).when(said.rlike("^-*[0-9]+$"), said.try_cast("int")))
    return place.otherwise(OTHER_LABEL)


def document_order(item: Column) -> list[Column]:
    """Sort keys of documents: numeric ones first, by number, then the others by name."""
    numeric = F.coalesce(item.rlike("^[0-9]+$"), F.lit(False))
    return [(~numeric).cast("int").alias("item_is_text"), F.when(numeric, item.try_cast("long")).otherwise(0).alias("item_number"), F.when(numeric, "").otherwise(item).alias("item_text")]


def page_first(df: DataFrame, item: str, page: str, block: str, row: str, layout: str) -> DataFrame:
    """``df`` in document order: a page's rows stand together, layouts only break ties."""
    place = F.coalesce(F.col(block).cast("int"), F.lit(0))
    return df.orderBy(*document_order(F.col(item).cast("string")), F.col(page), place, row_ordinal(F.col(row)), F.col(layout))


def summarised(df: DataFrame, page: list[str], verdict: str, values: list[Column], measured: Column) -> DataFrame:
    """One row: pages, rows, rows by verdict, usable rows, and the values that they
    hold where the row measures something (``measured``)."""
    v = F.col(verdict)
    filled = sum((x.isNotNull().cast("long") for x in values), F.lit(0))
    n = lambda c: F.count_if(c)
    return df.agg(
        F.count_distinct(F.struct(*page)).alias("pages"), F.count("*").alias("rows"), n(v == "checks_pass").alias("checks_pass"), n(v == "qc_clean").alias("qc_clean"),
        n(v == "flagged").alias("flagged"), n(usable(v)).alias("usable"), F.coalesce(F.sum(F.when(usable(v) & measured, filled)), F.lit(0)).alias("values_usable"),
    )


def long_form(df: DataFrame, mapping: list[tuple], layout: str, keep: list[str], verdict: str) -> DataFrame:
    """Every mapped cell as a row: vbl, stat, hour, period, value in the published
    unit, qc.  ``mapping``: (layout, column, vbl, stat, unit, hour, period) rows, by
    layout and column, as the same key may mean different things in two layouts."""
    made = [
        F.when(F.col(layout) == name, F.struct(F.lit(vbl).alias("vbl"), F.lit(stat).alias("stat"), F.lit(hour).cast("int").alias("hour"), F.lit(period).alias("period"), scalars.convert(F.col(c).cast("double"), unit).alias("value")))
        for name, c, vbl, stat, unit, hour, period in mapping
    ]
    cells = F.filter(F.array(*made), lambda c: c.isNotNull() & c["value"].isNotNull())
    qc = F.when(F.col(verdict) == "flagged", "uncertain").otherwise("")
    return df.select(*keep, qc.alias("qc"), F.explode(cells).alias("c")).select(*keep, "qc", "c.*")


def at_stations(df: DataFrame, stations: DataFrame, name: str) -> DataFrame:
    """Rows of known stations, with the registry's columns."""
    return df.join(stations, name)


def unknown_stations(df: DataFrame, stations: DataFrame, name: str) -> DataFrame:
    """Stations that the registry doesn't have, and their rows."""
    return df.groupBy(name).agg(F.count("*").alias("n_rows")).join(stations.select(name), name, "left_anti")


def from_printed(layout: Layout, values: dict[str, Column]) -> dict[str, Column]:
    """Values with the hundreds that the page leaves out; where no single one
    fits, as printed."""
    out = dict(values)
    for c in layout.columns:
        if c.elided:
            v = values[c.key]
            out[c.key] = F.when(v < 100, F.coalesce(scalars.restore_hundreds(v, c.elided_low, c.elided_high), v)).otherwise(v)
    return out


def to_printed(layout: Layout, values: dict[str, Column]) -> dict[str, Column]:
    return values | {c.key: F.when(values[c.key] >= 100, F.round(values[c.key] % 100, 4)).otherwise(values[c.key]) for c in layout.columns if c.elided}


def altitude_restored(low: Column, altitude: Column, width: float = 30.0) -> Column:
    """struct(value, failed): a barometer reading below 200 gets the hundreds that
    the altitude's pressure allows; failed where not exactly one does."""
    want = scalars.pressure_at(altitude)
    full = scalars.restore_hundreds(low, want - width, want + width)
    asked = F.coalesce((low < 200) & altitude.isNotNull(), F.lit(False))
    return F.struct(F.when(asked, F.coalesce(full, low)).otherwise(low).alias("value"), (asked & full.isNull()).alias("failed"))


# The letters of cloud forms; a compound joins them by hyphens or commas.
CLOUDS = ("c", "k", "n", "s", "p", "ç", "ć")


def cloud_forms(raw: Column, least: int = 3) -> Column:
    """Whether a row's cells are cloud forms: ``least`` codes or more, one compound."""
    cells = F.split(F.lower(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", "")), "[|]")
    codes = F.filter(F.transform(cells, lambda c: F.split(c, "[-,]")), lambda parts: F.forall(parts, lambda x: x.isin(*CLOUDS)))
    return (F.size(codes) >= least) & F.exists(codes, lambda parts: F.size(parts) > 1)


def sheet_flags(cells: DataFrame, sheet: list[str], row: str, column: str, value: str, ranges: dict[str, tuple[float, float]], pair: tuple[str, str], totals: DataFrame, out_of_order: str, tolerance: float = 0.15) -> DataFrame:
    """``cells`` (long form) with uncertain: a value outside its range, a pair
    (low, high) the wrong way round, a column whose printed total (``totals``:
    sheet, column, how, printed) isn't that of its values, or a row out of order."""
    v, c = F.col(value), F.col(column)
    outside = reduce(lambda x, kv: x | ((c == kv[0]) & ~v.between(*kv[1])), ranges.items(), F.lit(False))
    of_row, of_column = Window.partitionBy(*sheet, row), Window.partitionBy(*sheet, column)
    low, high = (F.max(F.when(c == k, v)).over(of_row) for k in pair)
    crossed = c.isin(*pair) & (high < low)
    df = cells.join(totals.select(*sheet, column, F.col("how").alias("__how"), F.col("printed").alias("__printed")), [*sheet, column], "left")
    made = F.when(F.col("__how") == "mean", F.avg(v).over(of_column)).otherwise(F.sum(v).over(of_column))
    off = v.isNotNull() & (F.abs(made - F.col("__printed")) > tolerance)
    no = lambda x: F.coalesce(x, F.lit(False))
    return df.select(*cells.columns, (no(outside) | no(crossed) | no(off) | no(F.col(out_of_order))).alias("uncertain"))


def flagged_recall(gold: DataFrame, read: DataFrame, sheet: list[str], row: list[str], columns: list[str], flag: str, tolerance: float = 0.05) -> DataFrame:
    """Per sheet: n_cells, n_wrong, n_flagged_wrong, flagged_recall (0 of nothing).
    ``flag`` + column in ``read``: whether the reader doubts the cell."""
    g = gold.select(*sheet, *row, *[F.col(c).alias(f"g_{c}") for c in columns])
    r = read.select(*sheet, *row, *[F.col(c).alias(f"r_{c}") for c in columns], *[F.col(flag + c).alias(f"f_{c}") for c in columns])
    both = g.join(r, [*sheet, *row], "left")
    wrong = [~scalars.same_cell(F.col(f"g_{c}"), F.col(f"r_{c}"), tolerance) for c in columns]
    n = lambda flags: F.sum(sum((x.cast("long") for x in flags), F.lit(0)))
    doubted = [w & F.coalesce(F.col(f"f_{c}"), F.lit(False)) for w, c in zip(wrong, columns, strict=True)]
    out = both.groupBy(*sheet).agg((F.count("*") * len(columns)).alias("n_cells"), n(wrong).alias("n_wrong"), n(doubted).alias("n_flagged_wrong"))
    return out.withColumn("flagged_recall", F.when(F.col("n_wrong") > 0, F.col("n_flagged_wrong") / F.col("n_wrong")).otherwise(0.0))


def agreement(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], tolerance: float = 0.005) -> DataFrame:
    """Per column: cells that both reads have a row for, and the share that agrees
    (nulls agree with each other)."""
    both = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns]), key)
    same = [F.struct(F.lit(c).alias("column"), scalars.same_cell(F.col(f"a_{c}"), F.col(f"b_{c}"), tolerance).alias("same")) for c in columns]
    return both.select(F.explode(F.array(*same)).alias("c")).groupBy("c.column").agg(F.count("*").alias("n_cells"), F.avg(F.col("c.same").cast("double")).alias("agrees"))


def same_text(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    """Equal as numbers within a tolerance, or as text, case and blanks aside."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    return (plain(a) == plain(b)) | F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) < tolerance, F.lit(False))


def token_score(tokens: Column, gold: list[Column], tolerance: float = 0.005) -> Column:
    """Right cells of a row read as bare numbers; none unless it has as many as the gold."""
    right = sum((F.coalesce(F.abs(F.get(tokens, F.lit(i)) - g) < tolerance, F.lit(False)).cast("int") for i, g in enumerate(gold)), F.lit(0))
    return F.when(F.size(tokens) == len(gold), right).otherwise(0)


def dropped(df: DataFrame, listed: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of pages that aren't listed, and how many rows each listed page lost (0 if it had none)."""
    lost = df.groupBy(*page).agg(F.count("*").alias("n"))
    names = listed.select(*page).distinct()
    return df.join(names, page, "left_anti"), names.join(lost, page, "left").select(*page, F.coalesce("n", F.lit(0)).alias("n_dropped"))


def most_common(df: DataFrame, key: list[str], text: str, order: str) -> DataFrame:
    """The most frequent non-empty text of each key; of equally frequent ones the first seen."""
    counts = df.where(F.coalesce(F.col(text), F.lit("")) != "").groupBy(*key, text).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    return counts.groupBy(*key).agg(F.max_by(text, F.struct("__n", -F.col("__first"))).alias(text))


def windows(chain: Column, n: int | Column) -> Column:
    """All runs of ``n`` neighbours of an array."""
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.size(chain) >= n, F.sequence(F.lit(1), F.size(chain) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(chain, i, n))


def group_digest(df: DataFrame, group: list[str], order: list[str], parts: list[str]) -> DataFrame:
    """SHA-256 over the ordered lines of each group, and their number."""
    line = F.struct(*order, F.concat(F.concat_ws("/", *[F.col(p).cast("string") for p in parts]), F.lit("\n")).alias("line"))
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line))["line"], "").cast("binary"), 256).alias("digest"))


# What the names of trained variants begin and end with.
VARIANT_PREFIXES, VARIANT_SUFFIXES = ("qwen35-lora-", "qwen35-"), ("-epoch2", "-epoch3", "-epoch1")


def variant_name(name: Column) -> Column:
    """One name for a variant however its run was saved: each beginning and each end goes once, in turn."""
    maybe = lambda parts: "".join(f"(?:{p})?" for p in parts)
    return F.regexp_replace(F.regexp_replace(name, "^" + maybe(VARIANT_PREFIXES), ""), maybe(reversed(VARIANT_SUFFIXES)) + "$", "")


# Points of the compass in capitals, as words of a row.
POINTS = r"\b(N|S|E|W|NE|NW|SE|SW|NNE|NNW|ENE|ESE|SSE|SSW|WNW|WSW)\b"


#: What a page's rows can hold, by which rules of layouts tell pages apart.
CONTENTS = ("clouds", "wind", "decimal", "whole", "any")


def contents(rows: Column) -> Column:
    """The ``CONTENTS`` of a page's rows (array of texts): cloud forms in the first,
    three compass points in all of them, and the first number of the first row's
    second or third cell, which has a decimal point or is of one or two digits."""
    first = F.get(rows, F.lit(0))
    bare = lambda t: (F.translate(t, "0123456789.-", "") == "") & ~F.ltrim(F.translate(t, "-", " ")).startswith(".")
    numbers = F.filter(F.slice(parse.tokens(first), 2, 2), lambda t: F.coalesce(parse.plain_number(t).isNotNull() & bare(t), F.lit(False)))
    number = F.get(numbers, F.lit(0))
    point = number.contains(".")
    held = {
        "clouds": cloud_forms(first), "wind": F.size(F.regexp_extract_all(F.array_join(rows, " "), F.lit(POINTS), F.lit(1))) >= 3,
        "decimal": point, "whole": ~point & ~number.startswith("-") & (F.length(number) <= 2), "any": F.lit(True),
    }
    return F.array_compact(F.array(*[F.when(held[k], F.lit(k)) for k in CONTENTS]))


def assigned_layout(cells: Column, rows: Column, rules: list[tuple[int | None, str, str | None]]) -> Column:
    """The layout of a page by the first of the ``rules`` (count of cells, content,
    layout) that fits: a rule without a count fits any, one without a layout says
    that the page has none."""
    table = F.array(*[F.struct(F.lit(n).cast("int").alias("cells"), F.lit(content).alias("content"), F.lit(layout).cast("string").alias("layout")) for n, content, layout in rules])
    fits = lambda held: F.filter(table, lambda r: (r["cells"].isNull() | (r["cells"] == cells)) & F.array_contains(held, r["content"]))
    return scalars.once(contents(rows), lambda held: F.get(fits(held), F.lit(0))["layout"])


def disagreements_explained(cells: DataFrame, corrections: DataFrame, key: list[str], column: str) -> DataFrame:
    """Cells that two reads differ in, with the correction a person made, if any,
    and which read it bears out."""
    made = corrections.select(*key, F.col(column), F.col("now").cast("double").alias("corrected"))
    out = cells.join(made, [*key, column], "left")
    near = lambda c: F.coalesce(F.abs(F.col(c) - F.col("corrected")) <= 0.005, F.lit(False))
    return out.withColumn("right", F.when(F.col("corrected").isNull(), None).when(near("a") & near("b"), "both").when(near("a"), "a").when(near("b"), "b").otherwise("neither"))


def first_file_wins(df: DataFrame, key: list[str], file: str, place: str, last: bool = False) -> DataFrame:
    """Of the entries of a key in several files, the first in order of file name
    and place (or the last) holds."""
    rest = [c for c in df.columns if c not in key]
    pick = F.max if last else F.min
    held = df.groupBy(*key).agg(pick(F.struct(file, place, *[c for c in rest if c not in (file, place)])).alias("__held"))
    return held.select(*key, *[F.col("__held")[c].alias(c) for c in rest])


def held_out_pages(df: DataFrame, pages: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to learn from, rows held out): whole pages go to one side."""
    some = pages.select(*page).distinct()
    return df.join(some, page, "left_anti"), df.join(some, page, "left_semi")


def worst(df: DataFrame, score: str, n: int, ties: list) -> DataFrame:
    """The ``n`` rows of the lowest score (a top-n report)."""
    return df.orderBy(F.col(score).asc_nulls_last(), *ties).limit(n)

"""Records that are derived again, variants with their evaluations, sheets
validated with messages, and rollups of scored sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions.scalars import same_cell
from rowproof.operators.publish import first_file_wins, variant_name


def changed_fields(old: Column, new: dict[str, Column]) -> Column:
    """array<struct<field, old, new>> of the fields whose value is another now; ``old`` is a
    map of texts.  A field that the record never had counts only if its value
    says something: not for null or false."""
    said = {k: v.cast("string") for k, v in new.items()}
    moved = lambda k, v: ~old[k].eqNullSafe(v) & (F.map_contains_key(old, k) | F.coalesce(v != "false", F.lit(False)))
    return F.array_compact(F.array(*[F.when(moved(k, v), F.struct(F.lit(k).alias("field"), old[k].alias("old"), v.alias("new"))) for k, v in said.items()]))


def rederived(df: DataFrame, record: str, caption: str, new: dict[str, Column]) -> DataFrame:
    """``df`` with changes, and its ``record`` (a map of texts) brought up to date where
    there are any.  Records without a caption stay as they are."""
    asked = F.coalesce(F.col(caption), F.lit("")) != ""
    out = df.withColumn("changes", F.when(asked, changed_fields(F.col(record), new)).otherwise(F.array().cast("array<struct<field: string, old: string, new: string>>")))
    fields = F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v.cast("string"))])
    kept = F.map_filter(F.col(record), lambda k, _: ~k.isin(*new))
    return out.withColumn(record, F.when(F.size("changes") > 0, F.map_concat(kept, fields)).otherwise(F.col(record)))


def evaluations(files: DataFrame, file: str, path: str, accuracy: str) -> DataFrame:
    """(name, accuracy) by each of the last two parts of an adapter's path: that of the
    first file, and in a file of the longer path's part first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    named = files.where((F.coalesce(F.col(path), F.lit("")) != "") & F.col(accuracy).isNotNull()).select(F.col(file).alias("file"), F.posexplode(F.slice(parts, -F.least(F.size(parts), F.lit(2)), F.lit(2))).alias("place", "name"), F.col(accuracy).alias("accuracy"))
    return first_file_wins(named, ["name"], "file", "place").select("name", "accuracy")


def variants(logs: DataFrame, file: str, name: str, found: DataFrame) -> DataFrame:
    """One row for each variant (the log of the last file holds) with its measured
    accuracy, null where it was never evaluated."""
    named = logs.withColumn(name, variant_name(F.col(name))).withColumn("__place", F.lit(0))
    held = first_file_wins(named, [name], file, "__place", last=True).drop("__place")
    return held.join(found.select(F.col("name").alias(name), F.col("accuracy").alias("gold_cell_acc")), name, "left")


def variant_lines(df: DataFrame, name: str, rows: str, epochs: str, trained: str) -> DataFrame:
    """(name, line): variants as lines of a table; a dash for what was never measured."""
    number = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)), F.lit("—"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    pad = lambda c, n: F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, " "))
    left = F.when(F.length(name) >= 16, F.col(name)).otherwise(F.rpad(F.col(name), 16, " "))
    shown = lambda c: F.when(F.col(c).isNull(), "—").otherwise(number(c))
    return df.select(name, F.concat_ws(" ", left, pad(text(rows), 5), pad(text(epochs), 3), pad(shown("gold_cell_acc"), 11), pad(shown(trained), 9)).alias("line"))


def sheet_violations(cells: DataFrame, sheet: list[str], date: str, column: str, value: str, ranges: dict[str, tuple[float, float]], pair: tuple[str, str], totals: DataFrame, tolerance: float) -> DataFrame:
    """(sheet, message) of a sheet's rules: the pair (high, low) of a day the wrong way
    round, values outside their range, and printed totals (``totals``: sheet, key,
    printed) that aren't those of their column; a key is a column, an underscore
    and mean or sum (anything else counts as sum), else it is malformed."""
    v, c = F.col(value), F.col(column)
    bounds = F.create_map(*[x for k, (lo, hi) in ranges.items() for x in (F.lit(k), F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))])
    text = lambda x: F.regexp_replace(F.format_string("%.2f", x.cast("double")), "[.]?0+$", "")
    outside = cells.where(~v.between(bounds[c]["lo"], bounds[c]["hi"])).select(*sheet, F.concat(F.col(date), F.lit(": "), c, F.lit("="), text(v), F.lit(" outside physical range")).alias("message"))
    high, low = (F.max(F.when(c == k, v)) for k in pair)
    crossed = cells.where(c.isin(*pair)).groupBy(*sheet, date).agg(high.alias("high"), low.alias("low")).where("high < low")
    crossed = crossed.select(*sheet, F.concat(F.col(date), F.lit(f": {pair[0]} "), text(F.col("high")), F.lit(f" < {pair[1]} "), text(F.col("low"))).alias("message"))
    key = F.col("key")
    whole = key.contains("_")
    malformed = totals.where(~whole).select(*sheet, F.concat(F.lit("printed_totals key '"), key, F.lit("' is malformed (expected <col>_mean or <col>_sum)")).alias("message"))
    asked = totals.where(whole).select(*sheet, "key", "printed", F.regexp_extract("key", "^(.*)_([^_]*)$", 1).alias(column), F.regexp_extract("key", "^(.*)_([^_]*)$", 2).alias("how"))
    made = cells.where(v.isNotNull()).groupBy(*sheet, column).agg(F.avg(value).alias("mean"), F.sum(value).alias("sum"))
    calc = F.when(F.col("how") == "mean", F.col("mean")).otherwise(F.col("sum"))
    off = asked.join(made, [*sheet, column]).where(F.abs(calc - F.col("printed")) > tolerance)
    off = off.select(*sheet, F.concat(F.lit("printed "), key, F.lit("="), text(F.col("printed")), F.lit(" but computed "), F.format_string("%.2f", calc), F.lit(" (possible row/col shift)")).alias("message"))
    return reduce(DataFrame.unionByName, (crossed, outside, malformed, off))


def rolled_up(sheets: DataFrame, scored: Column) -> DataFrame:
    """One row over sheets with n_cells, cell_acc, structural_err_rate, flagged_recall,
    flagged_cells and total_cells: accuracy over all cells, recall of the flags by
    sheet and over all wrong cells (counts rounded by sheet, halves to even)."""
    n, acc = F.col("n_cells"), F.col("cell_acc")
    wrong = F.when(scored, F.bround(n * (1 - acc)).cast("long"))
    caught = F.when(scored, F.bround(n * (1 - acc) * F.col("flagged_recall")).cast("long"))
    of = lambda c: F.when(scored, F.col(c))
    share = lambda a, b, empty: F.when(b > 0, a / b).otherwise(empty)
    s = sheets.agg(
        F.count("*").alias("n_sheets"), F.count_if(scored).alias("n_scored"), F.sum(of("n_cells")).alias("cells"), F.sum(F.when(scored, n * acc)).alias("right"), F.avg(of("structural_err_rate")).alias("structural_err_rate"),
        F.avg(of("flagged_recall")).alias("flagged_recall_macro"), F.sum(wrong).alias("wrong"), F.sum(caught).alias("caught"), F.sum(of("flagged_cells")).alias("flagged"), F.sum(of("total_cells")).alias("every"),
    )
    return s.select(
        "n_sheets", F.col("n_scored").alias("n_sheets_scored"), (F.col("n_sheets") - F.col("n_scored")).alias("n_sheets_errored"), F.when(F.col("n_scored") == 0, 0.0).otherwise(share(F.col("right"), F.col("cells"), 1.0)).alias("cell_acc"),
        F.coalesce("structural_err_rate", F.lit(0.0)).alias("structural_err_rate"), F.coalesce("flagged_recall_macro", F.lit(0.0)).alias("flagged_recall_macro"), share(F.col("caught"), F.col("wrong"), 0.0).alias("flagged_recall_micro"),
        share(F.col("flagged"), F.col("every"), 0.0).alias("fraction_flagged"), F.coalesce("cells", F.lit(0)).alias("n_cells_total"), F.coalesce("wrong", F.lit(0)).alias("total_wrong_cells"), F.coalesce("caught", F.lit(0)).alias("total_flagged_wrong_cells"),
    )


def corpus(tables: DataFrame, is_gold: Column, period: str, suspects: str, zoomed: str) -> DataFrame:
    """One row over all tables: how many, of gold, the span of periods (``first..last``),
    suspects, and the accuracy over the cells of gold."""
    g, judged = F.coalesce(is_gold, F.lit(False)), F.col("cell_acc").isNotNull()
    first, final = F.min(F.nullif(F.col(period), F.lit(""))), F.max(F.nullif(F.col(period), F.lit("")))
    right, cells = F.sum(F.when(g & judged, F.col("cell_acc") * F.col("n_cells"))), F.sum(F.when(g & judged, F.col("n_cells")))
    return tables.agg(
        F.count("*").alias("n_tables"), F.count_if(g).alias("n_gold"), F.count_if(~g).alias("n_fresh"), F.concat(first, F.lit(".."), final).alias("year_span"),
        F.coalesce(F.sum(suspects), F.lit(0)).alias("total_flagged_suspects"), F.coalesce(F.sum(zoomed), F.lit(0)).alias("total_zoom_suspects"), F.try_divide(right, cells).alias("gold_cell_acc_micro"),
    )


def page_accuracy(df: DataFrame, page: list[str], gold: dict[str, Column], read: dict[str, Column], tolerance: float = 0.005) -> DataFrame:
    """Per page: n_rows, n_cells, and the share of cells that are right to the last
    digit; a blank is right only where the page has one."""
    blank = lambda a, b: F.coalesce(F.abs(a - b) < tolerance, a.isNull() & b.isNull())
    right = sum((blank(g, read[k]).cast("int") for k, g in gold.items()), F.lit(0))
    return df.groupBy(*page).agg(F.count("*").alias("n_rows"), (F.count("*") * len(gold)).alias("n_cells"), F.round(F.sum(right) / (F.count("*") * len(gold)), 4).alias("cell_acc"))


def restored_barometers(df: DataFrame, columns: dict[str, tuple[float, float]], restore) -> DataFrame:
    """``df`` with the hundreds of its barometer columns, and flags: a column whose
    printed digits fit no single value keeps them and is named there."""
    made = {c: restore(F.col(c), lo, hi) for c, (lo, hi) in columns.items()}
    flags = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & m.isNull(), F.lit(c)) for c, m in made.items()]))
    return df.withColumns({"__flags": flags} | {f"__{c}": F.coalesce(m, F.col(c)) for c, m in made.items()}).withColumns({c: F.col(f"__{c}") for c in columns}).withColumnRenamed("__flags", "flags").drop(*[f"__{c}" for c in columns])


def station_registry(headers: DataFrame, header: Column, id_of) -> DataFrame:
    """(id, name, moves, lat, lon, lat_magnitude, lon_magnitude, hemisphere_missing, alt) of
    printed headings: a coordinate whose hemisphere isn't printed is a magnitude
    only, and a ship under way has none.  Of equal ids the last heading holds."""
    h = F.col("__h")
    df = headers.withColumn("__h", header)
    fixed = ~h["moves"]
    size = lambda c: F.round(F.abs(F.nullif(c, F.lit(0.0))), 4)
    lat, lon = h["lat_hemisphere"].isNotNull(), h["lon_hemisphere"].isNotNull()
    return df.select(
        *headers.columns, id_of(h["station"]).alias("id"), h["station"].alias("name"), h["moves"].alias("moves"), F.when(fixed & lat, F.round(h["lat_deg"], 4)).alias("lat"), F.when(fixed & lon, h["lon_greenwich"]).alias("lon"),
        F.when(fixed & ~lat, size(h["lat_deg"])).alias("lat_magnitude"), F.when(fixed & ~lon, size(h["lon_deg"])).alias("lon_magnitude"), (fixed & ~(lat & lon)).alias("hemisphere_missing"), h["barometer_m"].alias("alt"),
    )


def iso_dates(period: Column, day: Column) -> Column:
    """``YYYY-MM-DD`` of a period and a day, which may be no day of that month."""
    return F.concat(period, F.lit("-"), F.lpad(day.cast("int").cast("string"), 2, "0"))


def pages_produced(files: list[DataFrame], item: str, page: str) -> DataFrame:
    """Distinct pages over all files; a page without a number is -1."""
    each = [f.select(F.coalesce(F.col(item).cast("string"), F.lit("None")).alias("item"), F.coalesce(F.col(page).cast("int"), F.lit(-1)).alias("page")) for f in files]
    return reduce(DataFrame.unionByName, each).distinct()


# What a caption says before its proper nouns.
RUNNING_HEADS = (
    r"(?i)revista do observat[oó]rio\s*\d*",
    r"(?i)resumo das observa[çc][õo]es meteorol[oó]gicas( feitas)?( em| no| na)?",
    r"(?i)observations m[ée]t[ée]orologiques du mois d[e']?\s*\w+\s*\d*",
)


def station_group(caption: Column) -> Column:
    """A rough key for grouping: what a caption names besides its running heads, up to 48 letters."""
    c = F.trim(F.regexp_replace(F.coalesce(caption, F.lit("")), r"(?U)\s+", " "))
    for head in RUNNING_HEADS:
        c = F.regexp_replace(c, head.replace("(?i)", "(?iuU)", 1), "")
    c = F.substr(F.trim(F.regexp_replace(c, "[^A-Za-zÀ-ÿ .'-]", " ")), F.lit(1), F.lit(48))
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("(no station named)"))


def manifest_entries(labels: DataFrame, located: DataFrame, page: list[str], period: str, row: str, cells: list[str], target: Column) -> tuple[DataFrame, DataFrame]:
    """(entries, skipped) of pages that a person labelled row by row.

    An entry is a row with any cell that is not empty, of a page that has a period
    and at least as many ``located`` rows (page, n) as the row's place (from 0)
    asks for; its target is the text to learn.  Pages without a period or without
    located rows are skipped, with the reason."""
    known = F.coalesce(F.col(period), F.lit("")) != ""
    df = labels.join(located.select(*page, F.col("n").alias("__n")), page, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    reason = F.when(~known, "no period recorded").when(F.col("__n") == 0, "no rows located")
    skipped = df.select(*page, reason.alias("reason")).where("reason is not null").distinct()
    some = F.exists(F.array(*[F.coalesce(F.col(c).cast("string") != "", F.lit(False)) for c in cells]), lambda x: x)
    entries = df.where(known & some & (F.col(row) < F.col("__n"))).drop("__n").withColumn("target", target)
    return entries, skipped

"""Rows of the older layouts: the target of fourteen columns with its wind beside
it, and the two printed orders with day and wind among the cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowproof.functions import parse
from rowproof.functions.scalars import once
from rowproof.layout import Layout, LayoutColumn

# The columns of a row, and the cells of the two printed orders.
COLUMNS = ("pressure", "pressure_max", "pressure_min", "tmean", "tmax", "tmin", "vapor", "humidity", "wind_force", "cloudiness", "precip", "evap_sol", "evap_sombra", "ozone")
PRINTED_A = ("day", "pressure", "pressure_max", "pressure_min", "tmean", "tmax", "tmin", "vapor", "humidity", "wind_dir", "wind_force", "cloudiness", "precip", "evap_sol", "evap_sombra", "ozone")
PRINTED_B = ("day", "pressure", "pressure_max", "pressure_min", "tmean", "tmax", "tmin", "vapor", "humidity", "wind_dir", "wind_force", "cloudiness", "precip", "evap", "ozone")
BESIDE = "dir="


def layout(id: str, cells: tuple[str, ...]) -> Layout:
    return Layout(id, tuple(LayoutColumn(c, {"day": "day", "wind_dir": "text"}.get(c, "number")) for c in cells))


ROW, A, B = layout("row", COLUMNS), layout("printed-a", PRINTED_A), layout("printed-b", PRINTED_B)


def row_target(values: dict[str, Column], direction: Column) -> Column:
    """The text of a row; its wind follows where there is any."""
    said = F.when(F.coalesce(direction, F.lit("")) != "", F.concat(F.lit(f" | {BESIDE}"), direction)).otherwise("")
    return F.concat(parse.target(ROW, values), said)


def row_parsed(raw: Column) -> Column:
    """struct(cells by column, wind_dir, problems) of a row's text: cells go by their
    place, missing ones are null, and too many or too few are a problem."""
    n = len(COLUMNS)

    def read(t: Column) -> Column:
        beside = F.coalesce(F.element_at(t, -1).startswith(BESIDE), F.lit(False))
        return once(F.when(beside, F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t), lambda own: made(own, F.when(beside, F.trim(F.substr(F.element_at(t, -1), F.lit(len(BESIDE) + 1))))))

    def made(t: Column, direction: Column) -> Column:
        token = lambda i: F.coalesce(F.get(t, F.lit(i)), F.lit("null"))
        count = F.when(F.size(t) < n, F.concat(F.size(t).cast("string"), F.lit(f" tokens, expected {n}"))).when(F.size(t) > n, F.concat(F.size(t).cast("string"), F.lit(f" tokens, expected {n} (extra ignored)")))
        bad = [F.when(~parse.is_blank(token(i)) & parse.number(token(i)).isNull(), F.concat(F.lit(f"{c}: unparsable "), parse.quoted(token(i)))) for i, c in enumerate(COLUMNS)]
        cells = F.struct(*[F.when(~parse.is_blank(token(i)), parse.number(token(i))).alias(c) for i, c in enumerate(COLUMNS)])
        return F.struct(cells.alias("cells"), direction.alias("wind_dir"), F.array_compact(F.array(count, *bad)).alias("problems"))

    return once(parse.tokens(raw), read)


def printed_target(values: dict[str, Column], of: Layout) -> Column:
    """The row as printed; the single evaporation of the second order is that of the
    shade, or else of the sun."""
    return parse.target(of, values | {"evap": F.coalesce(values["evap_sombra"], values["evap_sol"])})


def printed_values(cells: Column, of: Layout) -> dict[str, Column]:
    """Day, columns and wind of a row parsed against one of the printed orders."""
    there = {c.key: cells[c.key]["txt" if c.kind == "text" else "num"] for c in of.columns}
    shade = there.get("evap_sombra", there.get("evap"))
    none = F.lit(None).cast("double")
    return {"day": there["day"].cast("int"), "wind_dir": there["wind_dir"]} | {c: there.get(c, none) for c in COLUMNS} | {"evap_sombra": shade}


def first_printed_int(text: Column) -> Column:
    """The whole number that the first cell begins with, leading dots aside."""
    head = F.regexp_replace(F.trim(F.substring_index(F.coalesce(text, F.lit("")), "|", 1)), "^[·.]+", "")
    return F.nullif(F.regexp_extract(head, "^([0-9]+)", 1), F.lit("")).try_cast("long")

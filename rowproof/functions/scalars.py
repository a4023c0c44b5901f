"""Scalar functions of table judging: elided digits, pressure, angles, dates in captions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months in captions (Portuguese, French), January first; the town that holds one of them.
MONTHS = [
    ("janeiro", "janvier"), ("fevereiro", "fevrier"), ("marco", "mars"), ("abril", "avril"), ("maio", "mai"), ("junho", "juin"),
    ("julho", "juillet"), ("agosto", "aout"), ("setembro", "septembre"), ("outubro", "octobre"), ("novembro", "novembre"), ("dezembro", "decembre"),
]
PLACES = "rio de janeiro|rio-de-janeiro|riu de janeiro"
# Marks behind the numbers of an angle, and the letters of the hemispheres.
DEGREE, HOUR, MINUTE, SECOND = ("°", "º", "o"), ("h",), ("'", "′", "m"), ("''", '"', "″", "s")
HEMISPHERES, NEGATIVE = ("N", "S", "E", "W", "O"), ("S", "W", "O")
# Fixed value: degrees of the local meridian from Greenwich, 43° 10' 21" west.
MERIDIAN = -(43 + 10 / 60 + 21 / 3600)
# Wind directions and words for none.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SSO", "SW", "SO", "WSW", "OSO", "W", "O", "WNW", "ONO", "NW", "NO", "NNW", "NNO", "C", "CALMA", "CALME", "0", "V", "VAR", "VARIAVEL")


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def named(texts: list[Column]) -> Column:
    """Those of the texts that are there, which in most rows is none: the array is
    only made where one is."""
    none = F.array().cast("array<string>")
    return F.when(reduce(lambda x, y: x | y, [t.isNotNull() for t in texts]), F.array_compact(F.array(*texts))).otherwise(none) if texts else none


def restore_hundreds(low: Column, lo: Column | float, hi: Column | float) -> Column:
    """The only value with the printed last two digits in [lo, hi), else null."""
    def fitting(f: Column, lo: Column, hi: Column) -> Column:
        below = F.greatest(F.floor((lo - f) / 100), F.lit(0)) * 100
        first = F.when(below + f >= lo, below).otherwise(below + 100)
        alone = (first <= 900) & (first + f < hi) & ~((first < 900) & (first + 100 + f < hi))
        return F.when(alone, first + f)

    printed = F.pmod(F.round(low * 100).cast("long"), F.lit(10_000)) / 100
    if isinstance(lo, Column):  # what is computed for each row is computed once
        return once(F.struct(printed.alias("f"), lo.alias("lo"), hi.alias("hi")), lambda x: fitting(x["f"], x["lo"], x["hi"]))
    return once(printed, lambda f: fitting(f, F.lit(float(lo)), F.lit(float(hi))))


def pressure_at(altitude: Column) -> Column:
    return 760 * F.exp(-altitude / 8434)


def implausible_pressure(observed: Column, altitude: Column, tolerance: float = 25.0) -> Column:
    return F.coalesce(F.abs(observed - pressure_at(altitude)) > tolerance, F.lit(False))


def invalid_compass(token: Column) -> Column:
    """Whether a printed direction has a part that is no direction."""
    parts = F.filter(F.split(F.upper(token), r"[,;/\s]+|\bE\b(?=\s)"), lambda x: x != "")
    return F.coalesce(~F.forall(parts, lambda p: F.replace(p, F.lit("."), F.lit("")).isin(*COMPASS)), F.lit(False))


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|[\s.;]+$", "")


def hemisphere(text: Column) -> Column:
    """The printed letter, or null; it stands before the number as often as after it."""
    letters = F.filter(F.split(F.upper(bare(text)), r"[\s,;.]+"), lambda w: w.isin(*HEMISPHERES))
    return F.get(letters, F.lit(0))


#: A number with its mark, if it has one; longer marks go first.
MARKED = "[0-9]+(?:[.,][0-9]+)?\\s*(?:" + "|".join(sorted((*SECOND, *MINUTE, *HOUR, *DEGREE), key=len, reverse=True)) + ")?"


def parse_angle(text: Column) -> Column:
    """Degrees of ``3°28' W``, ``9°,38'``, ``0h,30m E`` (time, 15 degrees an hour) or
    ``2m W`` (minutes of time); W, S and O are negative.  Null where nothing can
    be read, as on a ship (``var``).

    An angle is a sum of numbers, each weighed by its mark.  A first number
    without one counts wholes; later ones are minutes of time where the first
    were hours, and else seconds."""
    def weighed(pairs: Column) -> Column:
        mark = lambda p: F.regexp_extract(p, r"[^0-9.,\s]+$", 0)
        time = F.exists(pairs, lambda p: mark(p).isin(*HOUR)) | (F.size(pairs) == 1) & mark(F.get(pairs, F.lit(0))).isin("m")

        def part(p: Column, i: Column) -> Column:
            n = F.replace(F.regexp_extract(p, "^[0-9]+(?:[.,][0-9]+)?", 0), F.lit(","), F.lit(".")).try_cast("double")
            m = mark(p)
            unit = F.when(m.isin(*MINUTE), 60).when(m.isin(*SECOND), 3600).when(m.isin(*HOUR, *DEGREE) | (i == 0), 1).when(time & (i == 1), 60).otherwise(3600)
            return n / unit

        total = F.aggregate(F.transform(pairs, part), F.lit(0.0), lambda x, y: x + y)
        return F.when(F.size(pairs) > 0, total * F.when(time, 15.0).otherwise(1.0))

    sign = F.when(hemisphere(text).isin(*NEGATIVE), -1.0).otherwise(1.0)
    said = F.lower(bare(text))
    return F.when(~said.startswith("var"), once(F.regexp_extract_all(said, F.lit(MARKED), F.lit(0)), weighed) * sign)


def to_greenwich(longitude: Column) -> Column:
    """A longitude from the local meridian as one from Greenwich."""
    return F.round(MERIDIAN + longitude, 4)


def caption_period(text: Column) -> Column:
    """``YYYY-MM`` of a caption with a year of 1850-1899 and one month.  The town
    that ends in a month's name does not count; of several months the one holds
    that the caption says it is of (``mez de Agosto``), if that is one."""
    plain = lambda c: F.translate(c, "áàâãäéèêëíìîïóòôõöúùûüç", "aaaaaeeeeiiiiooooouuuuc")
    names = F.array(*[F.array(*map(F.lit, n)) for n in MONTHS])
    word = "(?<![a-zà-ÿ])(" + "|".join(x for n in MONTHS for x in n) + ")(?![a-zà-ÿ])"

    def known(words: Column) -> Column:
        return once(words, lambda w: F.filter(F.transform(names, lambda n, k: F.when(F.arrays_overlap(n, w), F.lpad((k + 1).cast("string"), 2, "0"))), lambda m: m.isNotNull()))

    def of(said: Column) -> Column:
        year = F.regexp_extract(said, r"\b(18[5-9][0-9])\b", 1)
        phrases = F.transform(F.regexp_extract_all(said, F.lit(r"\b(?:mez|mes|mois|month)\s+d[eo']?\s*'?\s*([a-zà-ÿ]+)"), F.lit(1)), plain)

        def month(named: Column) -> Column:
            only = F.when(F.size(named) > 1, known(phrases)).otherwise(named)
            return once(only, lambda m: F.when((F.size(m) == 1) & (year != ""), F.concat(year, F.lit("-"), F.get(m, F.lit(0)))))

        return once(known(F.regexp_extract_all(plain(said), F.lit(word), F.lit(1))), month)

    return once(F.regexp_replace(F.lower(F.regexp_replace(text, r"\s+", " ")), PLACES, " "), of)


def same_cell(a: Column, b: Column, tolerance: float) -> Column:
    """Equal within a tolerance, both null counting as equal."""
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.abs(a - b) <= tolerance)


def convert(value: Column, unit: str) -> Column:
    made = {"mmHg": lambda v: F.round(v * 1.333224, 3), "in": lambda v: F.round(v * 25.4, 3), "F": lambda v: F.round((v - 32) * 5 / 9, 3)}
    return made[unit](value) if unit in made else value


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

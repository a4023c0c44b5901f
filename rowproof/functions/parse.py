"""Tolerant row parsing, specialised to a layout.

A cell is a struct (kind, num, txt): ``null`` for blanks, ``num``, ``txt`` for
text columns and words that stand for no number, ``ditto`` for a repeat sign.
Every step is a projection of its own, so tokens and numbers are computed once
and the whole parser is generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowproof.functions.scalars import named, once
from rowproof.layout import Layout

# Tokens that stand for a blank cell and for "as above" (in lower case), and those that end a row.
BLANKS = ("null", "", "-", "—", "...", "…", "....")
DITTOS = ("»", "«", '"', "”", "″", "''", ",,", "idem", "id.", "ditto", "〃")
STOPS = ("<|im_end|>", "<|endoftext|>", "</s>")
EDGES = tuple(" \t\n\x0b\f\r`")
# Raised points, long dashes, and how a mended row is reported (these problems are soft).
POINTS, DASHES = "·‧∙⋅", "—–"
PADDED, JOINED, LEADING, HOLE = "padded 1 trailing cell (assumed the last column is blank)", "index cell read as two tokens", "dropped a spurious leading cell", "dropped an empty cell at position"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def plain_number(token: Column) -> Column:
    """A number with a point of any kind, or null."""
    t = F.translate(token, ",·", "..")
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def number(token: Column) -> Column:
    """A printed number, or null: decimal commas, raised points, dashes as signs,
    a blank behind the sign."""
    t = F.translate(token, "," + POINTS + DASHES, "." + "." * len(POINTS) + "-" * len(DASHES))
    t = F.replace(F.replace(t, F.lit("+ "), F.lit("+")), F.lit("- "), F.lit("-"))
    # A plain number is left as it is by all of this, so it is only done for the others.
    return F.when(token.rlike(NUMBER), token.try_cast("double")).otherwise(once(t, lambda t: F.when(t.rlike(NUMBER), t.try_cast("double"))))


def quoted(token: Column) -> Column:
    mark = F.when(token.contains("'") & ~token.contains('"'), '"').otherwise("'")
    return F.concat(mark, token, mark)


def tokens(raw: Column) -> Column:
    """Trimmed tokens between pipes, up to a stop; backticks around the row are dropped."""
    said = reduce(lambda x, stop: F.substring_index(x, stop, 1), STOPS, F.coalesce(raw, F.lit("")))
    edge = F.substring(said, 1, 1).isin(*EDGES) | F.substring(said, -1, 1).isin(*EDGES)
    return F.split(F.when(edge, F.regexp_replace(said, r"^\s*`*\s*|\s*`*\s*$", "")).otherwise(said), r"\s*[|]\s*")


def is_blank(token: Column) -> Column:
    return F.lower(token).isin(*BLANKS)


def mended_index(df: DataFrame, layout: Layout) -> DataFrame:
    """One token too many and an index out of range: a spurious leading cell is
    dropped, or an index that was read as two tokens is joined.  Only for an
    index with a declared range."""
    n, index = len(layout.columns), layout.index
    t = F.col("__tokens")
    a, b = F.get(t, F.lit(0)), F.get(t, F.lit(1))
    legal = lambda x: F.coalesce(plain_number(x).between(index.low, index.high), F.lit(False))
    joined = F.concat(a, b)

    def mend(x: Column) -> Column:
        a, b, joined = x["a"], x["b"], F.concat(x["a"], x["b"])
        empty = F.lower(a).isin(*DITTOS, *(x for x in BLANKS if x != "...."))
        return F.when(~legal(a), F.when(empty, F.when(legal(b), "lead")).when(joined.rlike("^[0-9]+$") & legal(joined), "join"))

    what = F.when(F.size(t) == n + 1, once(F.struct(a.alias("a"), b.alias("b")), mend))
    df = df.withColumn("__what", what)
    what = F.col("__what")
    mended = F.when(what == "lead", F.slice(t, 2, n)).when(what == "join", F.concat(F.array(joined), F.slice(t, 3, n - 1))).otherwise(t)
    note = F.when(what == "lead", F.concat(F.lit(LEADING + " "), quoted(a))).when(what == "join", F.concat(F.lit(JOINED + " "), quoted(a), F.lit(" "), quoted(b), F.lit(", joined to "), quoted(joined)))
    return df.withColumns({"__tokens": mended, "__p_index": note}).drop("__what")


def without_hole(df: DataFrame, layout: Layout) -> DataFrame:
    """One token too many and a single blank inside: it is dropped if all numbers
    are in their ranges then (carried columns are not judged)."""
    n, t = len(layout.columns), F.col("__tokens")
    # Looked for in rows with one token too many alone, and by folds, whose code is small.
    blank = F.when(F.size(t) == n + 1, F.filter(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: is_blank(F.get(t, i))))
    df = df.withColumn("__hole", F.when(F.size(blank) == 1, F.get(blank, F.lit(0))))
    hole = F.col("__hole")
    ranges = [F.struct(F.lit(i).alias("i"), F.lit(float(c.low)).alias("low"), F.lit(float(c.high)).alias("high")) for i, c in enumerate(layout.columns) if c.kind != "text" and c.low is not None and not c.carried]
    away = lambda c: F.coalesce(~plain_number(F.get(t, F.when(hole <= c["i"], c["i"] + 1).otherwise(c["i"]))).between(c["low"], c["high"]), F.lit(False))
    outside = F.exists(F.array(*ranges), away) if ranges else F.lit(False)
    df = df.withColumn("__hole", F.when(hole.isNotNull() & ~outside, hole))
    note = F.concat(F.lit(HOLE + " "), hole.cast("string"), F.lit(" (the page rules a line there, it is not a column)"))
    return df.withColumns({"__tokens": F.when(hole.isNotNull(), F.concat(F.slice(t, 1, hole), F.slice(t, hole + 2, n + 1))).otherwise(t), "__p_hole": note}).drop("__hole")


def parse_rows(df: DataFrame, layout: Layout, raw: str = "raw", out: str = "parsed") -> DataFrame:
    """``df`` with ``out``: struct(cells struct by key, problems array, markers map).

    A blank beyond the last column is dropped and one missing trailing cell is
    padded; a declared index and a ruled blank are mended as above; any other
    number of tokens is a problem, and cells go by their place.  Numbers that
    can't be read are null and a problem, unless the token begins like one of the
    layout's markers, which is kept as printed.  A null row has no cells."""
    n, ranged = len(layout.columns), layout.index is not None and layout.index.low is not None
    df = df.withColumn("__tokens", tokens(F.col(raw)))
    t = F.col("__tokens")
    df = df.withColumn("__tokens", F.when((F.size(t) == n + 1) & is_blank(F.get(t, F.lit(n))), F.slice(t, 1, n)).otherwise(t))
    none = F.lit(None).cast("string")
    df = without_hole(mended_index(df, layout), layout) if ranged else df.withColumns({"__p_index": none, "__p_hole": none})
    k = F.size("__tokens")
    # At this place one missing cell is padded: its token is not there, which reads as blank.
    count = F.when(k == n - 1, PADDED).when(k != n, F.concat(k.cast("string"), F.lit(f" cells, expected {n}")))
    df = df.withColumns({"__p_count": count} | {f"__t{i}": F.coalesce(F.get("__tokens", F.lit(i)), F.lit("null")) for i in range(n)})
    df = df.withColumns({f"__l{i}": F.lower(f"__t{i}") for i in range(n)} | {f"__n{i}": number(F.col(f"__t{i}")) for i, c in enumerate(layout.columns) if c.kind != "text"})
    starts = [m.lower().rstrip(".")[:4] for m in layout.markers if m]
    kinds, problems, marked = {}, [], []
    for i, c in enumerate(layout.columns):
        low, token = F.col(f"__l{i}"), F.col(f"__t{i}")
        kind = F.when(low.isin(*DITTOS), "ditto").when(low.isin(*BLANKS), "null")
        if c.kind == "text":
            kinds[f"__k{i}"] = kind.otherwise("txt")
            continue
        word = F.trim(F.regexp_replace(low, r"[.]+$", ""))
        marker = reduce(lambda x, m, word=word: x | word.startswith(m), starts, F.lit(False))
        kinds[f"__k{i}"] = kind.when(F.col(f"__n{i}").isNotNull(), "num").when(marker, "marker").otherwise("txt")
        problems.append(F.when(F.col(f"__k{i}") == "txt", F.concat(F.lit(f"{c.key}: unparsable "), quoted(token))))
        marked.append(F.when(F.col(f"__k{i}") == "marker", F.struct(F.lit(c.key).alias("key"), token.alias("value"))))
    df = df.withColumns(kinds)

    def cell(i: int, kind: str) -> Column:
        k, value = F.col(f"__k{i}"), F.lit(None).cast("double")
        if kind != "text":
            value = F.col(f"__n{i}")
            value = F.when(k == "num", F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("double") if kind == "day" else value)
        return F.struct(k.alias("kind"), value.alias("num"), F.when(k.isin("txt", "marker"), F.col(f"__t{i}")).alias("txt"))

    cells = F.struct(*[cell(i, c.kind).alias(c.key) for i, c in enumerate(layout.columns)])
    made = F.struct(
        cells.alias("cells"),
        named([F.col("__p_index"), F.col("__p_hole"), F.col("__p_count"), *problems]).alias("problems"),
        (F.map_from_entries(F.array_compact(F.array(*marked))) if marked else F.create_map().cast("map<string,string>")).alias("markers"),
    )
    return df.withColumn(out, made).select(*[F.col(f"`{x}`") for x in df.columns if not x.startswith("__")], out)


def soft(problem: Column) -> Column:
    """A recorded repair rather than a reason to distrust the row."""
    return reduce(lambda x, start: x | problem.startswith(start), (JOINED, LEADING, HOLE), problem.startswith(PADDED))


def is_summary(raw: Column, words: tuple[str, ...]) -> Column:
    """Whether a row's first cell is one of the words a page prints for its total, dots and case aside."""
    first = F.lower(F.regexp_replace(F.trim(F.substring_index(raw, "|", 1)), "[.]+$", ""))
    return F.coalesce(first.isin(*[w.rstrip(".").lower() for w in words]), F.lit(False)) if words else F.lit(False)


def target(layout: Layout, columns: dict[str, Column]) -> Column:
    """The text of a row: two decimals at most, ``null`` for blanks, piped."""
    def said(c) -> Column:
        x = columns[c.key]
        if c.kind == "text":
            return F.coalesce(x.cast("string"), F.lit("null"))
        fixed = F.format_string("%.2f", x.cast("double"))
        return F.coalesce(F.when(x.isNotNull(), F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), "[.]$", "")), F.lit("null"))

    return F.concat_ws(" | ", *[said(c) for c in layout.columns])


def cell_count(raw: Column) -> Column:
    """Cells of a row between pipes, those around the row aside."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^[\s|]+|[\s|]+$", "")
    return F.size(F.split(bare, "[|]"))

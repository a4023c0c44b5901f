"""Licence scan in built-in functions only.

Units of each text are compared with whole licence texts, notices and opening
paragraphs (``license_templates``) by the cosine of sparse TF-IDF vectors: the
whole text, each line, each paragraph (lines between lines without a term), and
each header, which is a run of lines of whose different terms half or more occur
in templates (lines without a term, blank or comment marks, don't end a run).
So wrapped notices in comments, full texts over many paragraphs and single lines
are all found.  A weight is (1 + ln tf) (ln((n + 1) / (df + 1)) + 1), df counted
over all documents for every term.

Licences of one family share most of their words, so a template may name terms
that its licence needs and terms that it bars ("lesser", "later", a version): a
unit without the one or with the other is not this licence, however near.
Longer units go before lines, which can end before the word that matters.  A
line with an SPDX mark is a unit of the mark alone; its licence is the whole
expression behind it (identifiers with AND, OR, WITH and brackets, as written),
whether a template has it or not, and goes before all others.

Units become rows of (unit, term, tf) that are joined with the terms' counts
and then with the templates' terms (a constant table); nothing is dense.  Only
units that hold a trigger term become rows.  Triggers are chosen so that this
drops nothing: what a template keeps without its trigger terms is shorter than
``SIMILAR`` times its norm, which bounds the cosine of any unit that has none.

A document is a licence file if its whole text is similar to a template, or if
its base name is one of a licence file and anything in it is similar.  It
declares its directory's licence (the most frequent one, ties to the last in
order).  Documents without a licence of their own inherit from the nearest
ancestor directory that has one: distinct directories are resolved by path
joins, and documents are joined to their directory.

Defined results: null texts have no licence of their own, but inherit; a null
path has no directory; repeated rows repeat; ties of similarity go to the
licence last in order; a NUL character is a blank.  Input columns named
license, similarity, basis or license_from are replaced by the results; all
others stay, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written
from .license_templates import TEMPLATES

SIMILAR = 0.6
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
FILE_NAME = r"(?i)(^|/)(licen[cs]e|unlicense|copying|copyright)([._-][^/]*)?$"
_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*"
SPDX = rf"(?i)SPDX-License-Identifier:[ \t]*({_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_ID})*)"


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


VOCABULARY = sorted({t for template in TEMPLATES for t in terms(template.text)})


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) of every term of the documents, written once."""
    held = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    return written(held.groupBy("term").agg(F.count("*").alias("df")), "terms")


def idf(n: int | Column, df: int | Column):
    return math.log((n + 1) / (df + 1)) + 1 if isinstance(df, int) else F.log((F.lit(n) + 1) / (df + 1)) + 1


def weights(n: int, counts: dict[str, int]) -> tuple[list[tuple], list[str]]:
    """Rows (template, licence, term, weight over the template's norm, whether the template needs the
    term and bars it, how many terms it needs), and the trigger terms."""
    rows, triggers = [], set()
    for k, template in enumerate(TEMPLATES):
        said = terms(template.text)
        v = {t: (1 + math.log(said.count(t))) * idf(n, counts.get(t, 0)) for t in said}
        norm = math.sqrt(sum(x * x for x in v.values()))
        every = {t: x / norm for t, x in v.items()} | {t: 0.0 for t in template.bars + template.needs if t not in v}
        rows += [(k, template.name, t, x, int(t in template.needs), int(t in template.bars), len(set(template.needs))) for t, x in every.items()]
        left = 1.0
        for t, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
            if left < (0.99 * SIMILAR) ** 2:
                break
            triggers.add(t)
            left -= (x / norm) ** 2
    return rows, sorted(triggers)


def units(text: Column, triggers: list[str]) -> Column:
    """Structs (kind, rank, tokens, said) of the whole text, its headers, paragraphs, lines
    and SPDX marks, of those that hold a trigger; null where the text holds none."""
    known, marks = F.array(*map(F.lit, VOCABULARY)), F.array(*map(F.lit, triggers))
    text = F.translate(text, "\0", " ")
    lines = F.split(text, "\n")

    def kept(line: Column) -> Column:
        t = F.array_distinct(tokens(line))
        # array() and transform bind the line's terms, so they are computed once.
        return F.get(F.transform(F.array(t), lambda t: F.when(2 * F.size(F.array_intersect(t, known)) >= F.size(t), line).otherwise(F.lit("\0"))), F.lit(0))

    runs = F.split(F.array_join(F.transform(lines, kept), "\n"), "\0")
    blank = F.transform(lines, lambda x: F.when(x.rlike("[A-Za-z0-9]"), x).otherwise(F.lit("\0")))
    paragraphs = F.split(F.array_join(blank, "\n"), "\0")
    none = F.lit(None).cast("string")
    of = lambda kind, rank, texts: F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), tokens(x).alias("tokens"), none.alias("said")))
    said = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, SPDX, 1)), lambda x: x != "")
    spdx = F.transform(said, lambda x: F.struct(F.lit("spdx").alias("kind"), F.lit(2).alias("rank"), F.array(F.lit("spdx-license-identifier")).alias("tokens"), F.regexp_replace(x, "[ \t]+", " ").alias("said")))
    every = F.concat(of("file", 1, F.array(text)), of("header", 1, runs), of("paragraph", 1, paragraphs), of("line", 0, lines), spdx)
    return F.when(F.arrays_overlap(tokens(text), marks), F.filter(every, lambda u: F.arrays_overlap(u["tokens"], marks)))


def similar(cut: DataFrame, row: str, units_: str, df: DataFrame, n: int, templates: DataFrame) -> DataFrame:
    """(row, best: struct(rank, cos, license), whole) of the rows of ``cut`` that hold a similar unit."""
    unit = cut.where(F.col(units_).isNotNull()).select(F.col(row).alias("row"), F.posexplode(units_).alias("unit", "u"))
    tf = unit.select("row", "unit", "u.kind", "u.rank", "u.said", F.explode("u.tokens").alias("term")).groupBy("row", "unit", "kind", "rank", "said", "term").agg(F.count("*").alias("tf"))
    w = tf.join(df, "term").withColumn("w", (1 + F.log("tf")) * idf(n, F.col("df")))
    square = F.col("w") * F.col("w")
    norm = w.groupBy("row", "unit").agg(F.sqrt(F.sum(square)).alias("norm"), F.sqrt(F.sum(F.when(F.col("term").isin(VOCABULARY), square))).alias("known"))
    # A cosine is at most the share of the norm that lies in terms of templates.
    norm = norm.where(F.col("known") >= 0.99 * SIMILAR * F.col("norm")).drop("known")
    near = w.join(norm.select("row", "unit"), ["row", "unit"], "left_semi").join(F.broadcast(templates), "term")
    dot = near.groupBy("row", "unit", "kind", "rank", "said", "template", "license", "needs").agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.sum("need").alias("has"), F.max("bar").alias("barred"))
    dot = dot.where("has = needs and barred = 0").withColumn("license", F.coalesce("said", "license")).where("license is not null")
    cos = dot.join(norm, ["row", "unit"]).withColumn("cos", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cos") >= SIMILAR)
    return cos.groupBy("row").agg(F.max(F.struct("rank", "cos", "license")).alias("best"), F.max(F.col("kind") == "file").alias("whole"))


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def scanned(docs: DataFrame, path_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its texts, with license, similarity, basis (file, header,
    inherited, none) and license_from (the file's own path or the directory it
    inherits from).  Texts are read twice: for the terms' counts, and for their
    units, which are written with a number for each row."""
    spark = docs.sparkSession
    row, units_, best, whole, dir_, file_, near_ = unused(docs, "row", "units", "best", "whole", "dir", "file", "near")
    df, n = document_counts(docs, text_col), docs.count()
    counts = {r.term: r.df for r in df.where(F.col("term").isin(VOCABULARY)).collect()}  # a constant number of rows
    rows, triggers = weights(n, counts)
    templates = spark.createDataFrame(rows, "template int, license string, term string, v double, need int, bar int, needs int")
    cut = docs.withColumns({row: F.monotonically_increasing_id(), units_: units(F.col(text_col), triggers)}).drop(text_col)
    cut = written(cut, "units")
    own = cut.drop(units_).join(similar(cut, row, units_, df, n, templates).withColumnsRenamed({"row": row, "best": best, "whole": whole}), row, "left")
    b, path = F.col(best), F.col(path_col)
    named = F.coalesce(path.rlike(FILE_NAME), F.lit(False))
    own = own.withColumns({dir_: parent(path), file_: b.isNotNull() & (F.col(whole) | named)})
    own = written(own.drop(row, whole), "matches")
    declared = own.where(F.col(file_) & F.col(dir_).isNotNull()).groupBy(F.col(dir_).alias("dir"), b["license"].alias("license")).agg(F.count("*").alias("n"))
    declared = declared.groupBy("dir").agg(F.max(F.struct("n", "license"))["license"].alias("license"))
    dirs = own.select(F.col(dir_).alias("dir")).where("dir is not null").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("up"))
    near = above.join(declared.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "license")).alias(near_))
    out = own.join(near.withColumnRenamed("dir", dir_), dir_, "left")
    has, near = b.isNotNull(), F.col(near_)
    return out.withColumns({
        "license": F.when(has, b["license"]).otherwise(near["license"]),
        "similarity": b["cos"],
        "basis": F.when(F.col(file_), "file").when(has, "header").when(near.isNotNull(), "inherited").otherwise("none"),
        "license_from": F.when(has, path).otherwise(near["up"]),
    }).drop(best, dir_, file_, near_)

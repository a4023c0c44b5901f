"""Replies of reading models: JSON among fences, prose and slips."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .scalars import once

FENCE = re.compile(r"\s*```(?:json)?\s*(.*?)\s*```\s*$", re.DOTALL)
TRAILING = re.compile(r",(?=\s*[}\]])")


def json_values(text: str | None) -> list[str]:
    """The JSON values of a reply: all of it, else without commas before a closing
    bracket, else the values from its start until something is none."""
    text = (text or "").strip()
    fenced = FENCE.match(text)
    text = fenced[1] if fenced else text
    for whole in (text, TRAILING.sub("", text)):
        try:
            return [json.dumps(json.loads(whole))]
        except ValueError:
            continue
    found, at, decoder = [], 0, json.JSONDecoder()
    while at < len(text):
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            break
        found.append(json.dumps(value))
        at = end + len(text[end:]) - len(text[end:].lstrip())
    return found


@F.pandas_udf(ArrayType(StringType()))
def candidates(replies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in replies:
        yield batch.map(json_values, na_action=None)


def recovered(reply: Column, schema: str, valid: Callable[[Column], Column]) -> Column:
    """The first value of a reply that is ``valid`` (as many rows as asked for, the
    day asked for), else null: a reply is never put down to another row."""
    read = F.transform(candidates(reply), lambda x: F.from_json(x, schema))
    return F.get(F.filter(read, lambda x: F.coalesce(valid(x), F.lit(False))), F.lit(0))


def numeric_cells(cells: Column, flags: Column) -> tuple[Column, Column]:
    """Cells (text by column) as numbers, and the flags with the words that stood in their place."""
    word = F.map_filter(cells, lambda _k, v: v.isNotNull() & v.try_cast("double").isNull())
    old = F.map_entries(F.coalesce(flags, F.create_map().cast("map<string,string>")))
    both = once(F.map_entries(word), lambda w: F.concat(F.filter(old, lambda e: ~F.exists(w, lambda x: x["key"] == e["key"])), w))
    return F.transform_values(cells, lambda _k, v: v.try_cast("double")), F.map_from_entries(both)


def counted(reply: Column, schema: str, rows: str, expected: Column) -> Column:
    """struct(value, error): the first value of a reply that has as many ``rows`` as
    expected.  One of another number is no table with a row too many or few, but
    a reply gone wrong, and says so."""
    return guarded(reply, schema, lambda v: F.size(v[rows]) == expected, lambda v: F.concat(F.size(v[rows]).cast("string"), F.lit(" rows, expected "), expected.cast("string")))


def of_day(reply: Column, schema: str, day: str, expected: Column) -> Column:
    """struct(value, error): the first value of a reply that reports the day asked for;
    a neighbour's is never put down to it."""
    return guarded(reply, schema, lambda v: v[day] == expected, lambda v: F.concat(F.lit("day "), F.coalesce(v[day].cast("string"), F.lit("none")), F.lit(", expected "), expected.cast("string")))


def guarded(reply: Column, schema: str, valid: Callable[[Column], Column], why: Callable[[Column], Column]) -> Column:
    """struct(value, error) of a reply: its first value that is ``valid``, or why its
    last value isn't one."""
    read = F.transform(candidates(reply), lambda x: F.from_json(x, schema))

    def told(values: Column) -> Column:
        good = F.get(F.filter(values, lambda v: F.coalesce(valid(v), F.lit(False))), F.lit(0))
        bad = F.when(F.size(values) > 0, why(F.element_at(values, -1))).otherwise("no valid JSON value found")
        return once(good, lambda g: F.struct(g.alias("value"), F.when(g.isNull(), F.coalesce(bad, F.lit("no valid JSON value found"))).alias("error")))

    return once(read, told)

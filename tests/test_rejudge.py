"""The whole judgement: one shuffle by page, and small pages by hand."""

import re

import pytest
from pyspark.sql import functions as F

from rowproof.layout import Check, Layout, LayoutColumn
from rowproof.operators.rejudge import rejudged
from rowproof.plans import judgement_queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rejudge_days", "rejudge_years"])
def test_one_exchange_by_page(spark, name):
    plan = judgement_queries.judged_lines(spark, SMALL, name == "rejudge_years")._jdf.queryExecution().executedPlan().toString()
    plan = plan.partition("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", plan)) == 1 == len(re.findall(r"\bExchange ", plan))
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["rejudge_days", "rejudge_years"])
def test_few_passes_over_a_page_and_methods_that_are_compiled(spark, name):
    """Rows of a page are sorted by place once, and not again by run; the JVM does not
    compile methods of more than 8,000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = judgement_queries.judged_lines(spark, SMALL, name == "rejudge_years")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    said, days = plan.toString(), name == "rejudge_days"
    assert len(re.findall(r"\bSort \[", said)) == 2 + days and len(re.findall(r"\bWindow \[", said)) <= 8
    stages = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$").codegenStringSeq(plan)
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) <= 8000


def layout(**more):
    return Layout(
        "page", (LayoutColumn("day", "day", low=1, high=31), LayoutColumn("baro", unit="mm", low=650, high=790), LayoutColumn("a", low=0, high=50), LayoutColumn("b"), LayoutColumn("wind_dir", "text")),
        (Check("atleast", "b", ("a",)),), summary_words=("Mez",), **({"monthly": {"aggregate": {"a": "mean", "b": "max"}}} | more),
    )


def judged(spark, page, of, expected=4, **more):
    rows = [(1, i, raw, 0.0, None) for i, raw in enumerate(page)]
    df = spark.createDataFrame(rows, "page long, pos long, raw string, alt double, fix map<string,double>")
    out = rejudged(df, of, ["page"], "pos", F.lit(expected), altitude=F.col("alt"), corrections=F.col("fix"), **more).orderBy("pos").collect()
    return [r.judged for r in out]


def test_days_of_a_page(spark):
    page = ["9 | 760 | 1 | 2 | N", "1 | 760 | 1 | 2 | N", "» | 760 | 2 | 3 | NE", "2 | 700 | 3 | 4 | N", "3 | 760 | 51 | 60 | X", "4 | 760 | 4 | 3 | N", "Mez. | 760 | 12.2 | 60 | N", None]
    got = judged(spark, page, layout(rows_per_page="days_in_month_x2"))
    assert [j.is_day for j in got] == [False, True, True, True, True, True, False, False]
    assert [j.verdict for j in got] == ["flagged", "checks_pass", "checks_pass", "flagged", "flagged", "flagged", "flagged", "flagged"]
    assert all(j.complete for j in got) and got[2]["values"].day == 1 and got[7]["values"].baro is None
    assert got[3].problems == ["pressure_implausible: baro"] and got[4].problems == ["invalid_compass: wind_dir"] and got[4].violations == ["a"] and got[5].failures == ["atleast:b"]
    assert {tuple(j.totals) for j in got} == {()}  # the mean of 1, 2, 3, 51, 4 is 12.2
    got = judged(spark, [*page[:6], "Mez | 760 | 12.3 | 61 | N"], layout(rows_per_page="days_in_month_x2"))
    assert got[0].totals == ["a", "b"]
    assert not judged(spark, page, layout(), expected=5)[1].complete
    assert judged(spark, [], layout()) == []


def test_the_first_of_equal_runs_holds_and_duplicates_are_told_apart(spark):
    got = judged(spark, ["1 | 760 | 1 | 2 | N", "2 | 760 | 1 | 2 | N", "x | 760 | 1 | 2 | N", "8 | 760 | 1 | 2 | N", "9 | 760 | 1 | 2 | N"], layout(), expected=2)
    assert [j.is_day for j in got] == [True, True, False, False, False] and got[0].complete
    got = judged(spark, [f"{d} | 760 | 1 | 2 | N" for d in (1, 3, 2, 3, 4)], layout())
    assert [("duplicate_day" in j.problems) for j in got] == [False, True, False, False, False]


def test_years_are_filled_from_the_sequence(spark):
    years = layout(index_kind="year", rows_per_page="fixed:4")
    got = judged(spark, ["3 | 760 | 1 | 2 | N", "x | 760 | 1 | 2 | N", "5 | 760 | 1 | 2 | N", "6 | 760 | 1 | 2 | N"], years)
    assert [j["values"].day for j in got] == [3, 4, 5, 6] and all(j.is_day for j in got) and not got[0].complete
    assert "index_from_page_sequence" in got[1].problems and got[1].verdict == "flagged"
    got = judged(spark, ["3 | 760 | 1 | 2 | N", "x | 760 | 1 | 2 | N", "5 | 760 | 1 | 2 | N", "7 | 760 | 1 | 2 | N"], years)
    assert got[1]["values"].day is None


def test_corrections_hold_and_are_named(spark):
    df = spark.createDataFrame([(1, 1, "1 | 760 | 9 | 2 | N", {"a": 1.0, "b": 2.0}), (1, 2, "2 | 760 | 1 | 2 | N", {})], "page long, pos long, raw string, fix map<string,double>")
    a, b = [r.judged for r in rejudged(df, layout(), ["page"], "pos", F.lit(2), corrections=F.col("fix")).orderBy("pos").collect()]
    assert (a["values"].a, a.corrected, a.verdict, b.corrected) == (1.0, ["a"], "checks_pass", [])
    blank = layout(monthly={"aggregate": {"a": "sum"}, "blank_is_zero": ["a"]})
    page = ["1 | 760 | null | 2 | N", "2 | 760 | 3 | 4 | N"]
    assert judged(spark, [*page, "Mez | 760 | 3 | 4 | N"], blank)[0].totals == [] and judged(spark, [*page, "Mez | 760 | 4 | 4 | N"], blank)[0].totals == ["a"]
    assert judged(spark, [*page, "Mez | 760 | 4 | 4 | N"], layout())[0].totals == []  # a gap judges nothing

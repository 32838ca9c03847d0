"""Property checks against plain-Python restatements, many cases per Spark job."""

import bisect

from hypothesis import given, settings, strategies as st

from lakeward.functions import scalars

_SPARK = {}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789a ", max_size=6), min_size=1, max_size=60),
       st.integers(1990, 2010), st.integers(0, 12))
def _prop_year_partition(values, start, span):
    spark = _SPARK["s"]
    end = start + span
    bounds = scalars.year_bounds(start, end)
    df = spark.createDataFrame([(v,) for v in values], "y string")
    got = [r[0] for r in df.select(scalars.year_partition("y", start, end, "rest")).collect()]
    exp = []
    for v in values:
        if len(bounds) < 2 or v < bounds[0] or v >= bounds[-1]:
            exp.append("rest")
        else:
            exp.append(bounds[bisect.bisect_right(bounds, v) - 1])
    assert got == exp


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-10**9, 10**9), min_size=1, max_size=200))
def _prop_ms_to_seconds(ms):
    spark = _SPARK["s"]
    df = spark.createDataFrame([(m,) for m in ms], "ms bigint")
    assert [r[0] for r in df.select(scalars.ms_to_seconds("ms")).collect()] == [round(m / 1000) for m in ms]


def test_properties(spark):
    _SPARK["s"] = spark
    _prop_year_partition()
    _prop_ms_to_seconds()

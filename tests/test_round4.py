"""Sliding profiles in one pass over the epochs, with no table of points sent through the driver."""

import datetime as dt

import pytest

from epochlane.operators import profiles
from epochlane.plans.all import QUERIES

DATA = "/root/testdata/sf0.001"


def ran(df):
    """The plan that a query ended with."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["profile_sliding", "profile_sliding_incl"])
def test_points_are_not_broadcast(spark, name):
    """A table made from the days' lengths is taken for as small as those, however many points it has."""
    plan = ran(QUERIES[name](spark, DATA))
    assert "Broadcast" not in plan and "Join" not in plan
    assert plan.split("== Initial Plan ==")[0].count("Scan parquet") == 1


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("whole_if_short", [False, True])
def test_sliding_equals_slices(spark, inclusive, whole_if_short):
    """Days around the length of a window, with other stages, an unknown one, and a day of no date."""
    days = {dt.date(2024, 1, n + 1): [(i * i + n) % 3 for i in range(n)] for n in range(1, 20)}
    rows = [("S0", d, i, s) for d, of in days.items() for i, s in enumerate(of)] + [("S1", dt.date(2024, 1, 1), i, s) for i, s in enumerate((None, 2, None, 2, 2, 0, 1))]
    df = spark.createDataFrame([*rows, *(("S0", None, i, 2) for i in range(9))], "subject_id string, day date, epoch_idx int, stage int")
    days = {("S0", d): of for d, of in days.items()} | {("S1", dt.date(2024, 1, 1)): [None, 2, None, 2, 2, 0, 1]}
    for width, step in ((5, 2), (4, 4), (3, 5)):
        want = {}
        for k, of in days.items():
            at = range(0, max(len(of) - width + inclusive, 0), step)
            want |= {(*k, i): 100.0 * of[a : a + width].count(2) / width for i, a in enumerate(at)}
            if whole_if_short and len(of) < width:
                want[(*k, 0)] = 100.0 * of.count(2) / len(of)
        got = profiles.sliding(df, width, step, inclusive=inclusive, whole_if_short=whole_if_short).collect()
        assert len(got) == len(want) and {tuple(r)[:3]: r["pct"] for r in got} == pytest.approx(want)

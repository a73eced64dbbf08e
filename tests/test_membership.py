import random
from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ratelab.operators import membership
from ratelab.operators.membership import events_in_periods, overlap_periods, people_in_periods
from ratelab.sources.calendar import from_table, monthly, rolling, spanning

SCHEMA = "id int, period_start date, period_end date, extra date"
FAR = date(9999, 12, 31)
CASES = [
    (date(1995, 2, 1), FAR, None, False),
    (date(1994, 1, 1), date(1995, 1, 1), None, True),
    (date(1994, 1, 1), None, None, False),
    (date(1994, 1, 1), date(1996, 1, 1), None, True),
    (date(1994, 1, 1), FAR, date(1994, 12, 31), False),
    (date(1994, 1, 1), FAR, date(1995, 1, 1), True),
    (date(1995, 1, 20), FAR, date(1995, 1, 10), True),
]


def test_boundaries(spark):
    rows = [(i, *case[:3]) for i, case in enumerate(CASES)]
    got = overlap_periods(spark.createDataFrame(rows, SCHEMA), monthly(spark, date(1995, 1, 1), 1), extra_end="extra")
    assert sorted(r["id"] for r in got.collect()) == [i for i, c in enumerate(CASES) if c[3]]


def member(row, window):
    _, start, end, extra = row
    return (
        end is not None
        and start < window["end_date"]
        and end >= window["start_date"]
        and (extra is None or extra >= window["start_date"])
    )


days = st.integers(-400, 900).map(lambda n: date(1995, 1, 1) + timedelta(days=n))
rows = st.tuples(days, st.one_of(st.none(), days, st.just(FAR)), st.one_of(st.none(), days))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(rows, min_size=1, max_size=25), st.sampled_from([1, 3, 12]), st.booleans())
def test_overlap_equals_brute_force(spark, data, width, buckets):
    table = [(i, *r) for i, r in enumerate(data)]
    calendar = rolling(spark, date(1995, 1, 1), 14, width)
    limit, membership.BROADCAST_PERIODS = membership.BROADCAST_PERIODS, 5 if buckets else 100
    try:
        got = overlap_periods(spark.createDataFrame(table, SCHEMA), calendar, extra_end="extra")
        found = sorted((r["id"], r["month_no"]) for r in got.collect())
        events = events_in_periods(
            spark.createDataFrame([(i, r[0]) for i, r in enumerate(data)], "id int, day date"), calendar, "day"
        )
        seen = sorted((r["id"], r["month_no"]) for r in events.collect())
    finally:
        membership.BROADCAST_PERIODS = limit
    windows = calendar.periods.collect()
    assert found == sorted((r[0], w["month_no"]) for r in table for w in windows if member(r, w))
    assert seen == sorted(
        (i, w["month_no"])
        for i, r in enumerate(data)
        for w in windows
        if w["start_date"] <= r[0] < w["end_date"]
    )


def test_calendars(spark):
    got = [tuple(r) for r in rolling(spark, date(2022, 11, 1), 3, 3).periods.collect()]
    assert got[2] == (date(2023, 1, 1), 3, date(2023, 1, 1), date(2023, 4, 1))
    calendar = rolling(spark, date(2022, 11, 1), 3, 3)
    assert (calendar.first, calendar.last) == (date(2022, 11, 1), date(2023, 4, 1))
    stored = from_table(calendar.periods)
    assert (stored.count, stored.first, stored.last) == (3, calendar.first, calendar.last)
    with pytest.raises(ValueError, match="exactly one period"):
        from_table(calendar.periods.withColumn("month_no", F.lit(1)))
    with pytest.raises(ValueError, match="empty"):
        from_table(calendar.periods.limit(0))
    dates = spark.createDataFrame([(date(2020, 12, 5),), (date(2021, 2, 1),)], "d date")
    assert spanning(dates, "d").count == 3


def people(spark, calendar, with_events, how="left"):
    """Repeated, touching and overlapping memberships, null patients and null age bands."""
    draw = random.Random(5)

    def day(low, high):
        return date(1995, 1, 1) + timedelta(days=draw.randint(low, high))

    def table(schema, *keys):
        rows = []
        for _ in range(60):
            start = day(-100, 500)
            rows.append((draw.choice([1, 2, 3, 4, 5, None]), start, start + timedelta(days=draw.randint(-20, 200)), *[k() for k in keys]))
        head = "patient long, period_start date, effective_end date, "
        return spark.createDataFrame(rows + rows[::7], head + schema)

    practice = table("place long", lambda: draw.randint(1, 3))
    profile = table("age_band int, sex long", lambda: draw.choice([0, 15, None]), lambda: draw.randint(1, 2))
    residence = table("area long", lambda: draw.randint(1, 2))
    seen = [(draw.choice([1, 2, 3, None]), day(-60, 600)) for _ in range(60)] + [(3, None)]
    events = spark.createDataFrame(seen, "patient long, episode_start date") if with_events else None
    return people_in_periods(practice, profile, residence, calendar, events, how)


@pytest.mark.parametrize("width", [1, 3])
def test_people_by_ranges_equal_joins_by_period(spark, width):
    calendar = rolling(spark, date(1995, 1, 1), 14, width)
    for with_events, how in ((False, "left"), (True, "left"), (True, "inner")):
        got = people(spark, calendar, with_events, how)
        expected = people(spark, from_table(calendar.periods), with_events, how)
        assert got.columns == expected.columns
        found = sorted(map(repr, got.collect()))
        assert len(found) > 50 and found == sorted(map(repr, expected.collect()))
        assert len(found) == got.drop("copies", "events").distinct().count()


def operators(df):
    """Operator names of the optimised plan, outermost first."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [line.lstrip(" :+-").split(" ")[0] for line in lines]


def test_periods_are_attached_after_joins(spark):
    calendar = monthly(spark, date(1995, 1, 1), 14)
    for with_events in (False, True):
        names = operators(people(spark, calendar, with_events))
        assert names.index("Generate") < names.index("Join")
        # The others make two changes of each range, one per table.
        assert names.count("Generate") == 4 and "Generate" not in names[: names.index("Generate")]


def test_overlap_per_person(spark):
    calendar = rolling(spark, date(1995, 1, 1), 14, 2)
    data = [(1, date(1995, 1, 5), FAR, None), (1, date(1995, 3, 1), date(1995, 6, 2), None), (1, date(1995, 6, 9), FAR, date(1995, 7, 1))]
    data += [(None, date(1994, 5, 5), date(1995, 4, 1), None)] * 2 + [(2, date(1995, 5, 5), None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    plain = overlap_periods(df, calendar, extra_end="extra").groupBy("id", "month_no").agg(F.count("*").alias("copies"))
    expected = sorted(map(repr, plain.collect()))
    for known in (calendar, from_table(calendar.periods)):
        got = overlap_periods(df, known, extra_end="extra", per=["id"]).select(*plain.columns)
        assert sorted(map(repr, got.collect())) == expected
    # Ranges are counted per person first: no row per person and period is moved.
    names = operators(overlap_periods(df, calendar, extra_end="extra", per=["id"]))
    assert names.index("Generate") < names.index("Window") < names.index("Aggregate")

"""Who belonged where in each period, and which events fell in it.

Each membership table is tested against the calendar on its own: two
memberships of one person may touch the same period without touching each
other. The tables are therefore moved to their person in compact form, as
counted ranges of window numbers, and the ranges are intersected there.
Periods are attached last: no join, sort or shuffle holds a row per person and
period, and what Spark measures of a shuffle is what its tasks will hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratelab.sources.calendar import Calendar

# Stored calendars above this size are matched by month buckets, not broadcast.
BROADCAST_PERIODS = 10_000
BUCKET_SALTS = 32


def clip_to_calendar(calendar: Calendar, start: str, end: str, extra_end: str | None) -> tuple[Column, Column]:
    """Row filter and effective end of a membership.

    A null end never matches. A null extra end is no restriction, which is how
    ``least`` treats it. Clipping to the calendar's last day is exact because no
    window starts later.
    """
    last = F.lit(calendar.last)
    ends = [F.col(end), last] + ([F.col(extra_end)] if extra_end else [])
    effective = F.least(*ends)
    keep = (
        F.col(end).isNotNull()
        & (F.col(start) < last)
        & (F.col(end) >= F.lit(calendar.first))
    )
    if extra_end:
        keep = keep & (F.col(extra_end).isNull() | (F.col(extra_end) >= F.lit(calendar.first)))
    return keep, effective


def overlap_periods(
    df: DataFrame,
    calendar: Calendar,
    start: str = "period_start",
    end: str = "period_end",
    extra_end: str | None = None,
    per: list[str] | None = None,
) -> DataFrame:
    """One row per membership row and period it touches, with ``month_no``.

    A membership touches a window when it starts before the window's end and
    neither its end nor its extra end comes before the window's start. With
    ``per``, one row per period and values of those columns, nulls included,
    with ``copies``, the number of membership rows behind it.
    """
    keep, effective = clip_to_calendar(calendar, start, end, extra_end)
    kept = df.filter(keep).withColumn("effective_end", effective)
    if per is None:
        return touch_periods(kept, calendar, start).drop("effective_end")
    if calendar.width:
        return in_windows(segments(kept, calendar, per, start, "effective_end"))
    return touch_periods(kept, calendar, start).groupBy(*per, "month_no").agg(F.count(F.lit(1)).alias("copies"))


def _month_index(day: Column, calendar: Calendar) -> Column:
    """Number of the calendar month of a day, 1 for the calendar's first month."""
    origin = calendar.first.year * 12 + calendar.first.month - 1
    return F.year(day) * 12 + F.month(day) - origin


def window_range(calendar: Calendar, start: Column, end: Column) -> tuple[Column, Column]:
    """Numbers of the first and last window that a range of days touches.

    For calendars of equal windows, month arithmetic says which they are; no
    row is compared with a window. The range is empty if first > last.
    """
    first = F.greatest(_month_index(start, calendar) - (calendar.width - 1), F.lit(1))
    last = F.least(_month_index(end, calendar), F.lit(calendar.count))
    return first.cast("int"), last.cast("int")


def touch_periods(df: DataFrame, calendar: Calendar, start: str, end: str = "effective_end") -> DataFrame:
    """One row per row and window that the days from ``start`` to ``end`` touch, with ``month_no``."""
    if calendar.width:
        first, last = window_range(calendar, F.col(start), F.col(end))
        return df.filter(first <= last).withColumn("month_no", F.explode(F.sequence(first, last)))
    windows = calendar.periods.select("month_no", "start_date", "end_date")
    test = (F.col(start) < F.col("end_date")) & (F.col(end) >= F.col("start_date"))
    if calendar.count <= BROADCAST_PERIODS:
        joined = df.join(F.broadcast(windows), test)
    else:
        joined = _bucket_join(
            df, windows, calendar, F.least(F.col(start), F.col(end)), F.greatest(F.col(start), F.col(end)), test
        )
    return joined.drop("start_date", "end_date")


def events_in_periods(df: DataFrame, calendar: Calendar, when: str) -> DataFrame:
    """One row per event and window [start, end) that holds its date."""
    inside = df.filter(
        (F.col(when) >= F.lit(calendar.first)) & (F.col(when) < F.lit(calendar.last))
    )
    return touch_periods(inside, calendar, when, when)


def _bucket_join(
    df: DataFrame, windows: DataFrame, calendar: Calendar, low: Column, high: Column, test: Column
) -> DataFrame:
    """Range join through shared month buckets, for calendars too long to broadcast.

    Any matching pair has a day in common, hence a month; it is kept only in
    the first month both sides cover. Rows of one month are spread over salts.
    """
    first, last = F.lit(calendar.first), F.lit(calendar.last)
    month = F.expr("interval 1 month")

    def months(a: Column, b: Column) -> Column:
        return F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), month)

    salts = F.sequence(F.lit(0).cast("long"), F.lit(BUCKET_SALTS - 1).cast("long"))
    low = F.least(F.greatest(low, first), last)
    high = F.greatest(F.least(high, last), first)
    left = (
        df.withColumn("first_bucket", F.trunc(low, "month"))
        .withColumn("salt", F.pmod(F.xxhash64(*df.columns), F.lit(BUCKET_SALTS)))
        .withColumn("bucket", F.explode(months(low, high)))
    )
    right = (
        windows.withColumn("window_bucket", F.trunc("start_date", "month"))
        .withColumn("bucket", F.explode(months(F.col("start_date"), F.date_sub("end_date", 1))))
        .withColumn("salt", F.explode(salts))
    )
    return (
        left.join(right, ["bucket", "salt"])
        .filter(test & (F.col("bucket") == F.greatest("first_bucket", "window_bucket")))
        .drop("bucket", "salt", "first_bucket", "window_bucket")
    )


def _counted(df: DataFrame, calendar: Calendar, keys: list[str], start: str, end: str) -> DataFrame:
    """(patient, month_no, keys, copies) rows, all of a person in one place.

    Equal rows of a person are counted before any shuffle and, on calendars of
    equal windows, dates become window numbers first: a person then has at
    most one row per range of windows and keys, however many raw rows.
    """
    df = df.filter(F.col("patient").isNotNull())
    ends = [start, end]
    if calendar.width:
        first, last = window_range(calendar, F.col(start), F.col(end))
        df = df.select("patient", *keys, first.alias("first"), last.alias("last")).filter("first <= last")
        ends = ["first", "last"]
    compact = df.groupBy("patient", *dict.fromkeys(ends), *keys).agg(F.count(F.lit(1)).alias("n")).repartition("patient")
    if calendar.width:
        rows = compact.withColumn("month_no", F.explode(F.sequence("first", "last")))
    else:
        rows = touch_periods(compact, calendar, start, end)
    return rows.groupBy("patient", "month_no", *keys).agg(F.sum("n").alias("copies"))


def segments(
    df: DataFrame, calendar: Calendar, keys: list[str], start: str, end: str, together: str | None = None
) -> DataFrame:
    """Disjoint ranges ``first`` to ``last`` of window numbers per ``keys``, with ``copies``, the rows over each.

    For calendars of equal windows. Equal ranges are counted before they move;
    ``together`` names the key that alone says where they go.
    """
    first, last = window_range(calendar, F.col(start), F.col(end))
    ranges = df.select(*keys, first.alias("first"), last.alias("last")).filter("first <= last")
    counted = ranges.groupBy(*keys, "first", "last").agg(F.count(F.lit(1)).alias("n"))
    if together:
        counted = counted.repartition(together)
    changes = counted.select(*keys, F.expr("inline(array(struct(first AS at, n AS d), struct(last + 1 AS at, -n AS d)))"))
    order = Window.partitionBy(*keys).orderBy("at")
    # Changes in the same place have the same sum; only the last of them is
    # followed by another place.
    return changes.select(
        *keys, F.col("at").alias("first"), (F.lead("at").over(order) - 1).alias("last"), F.sum("d").over(order).alias("copies")
    ).filter("first <= last AND copies > 0")


def in_windows(ranges: DataFrame) -> DataFrame:
    """One row per range and window in it, with ``month_no`` instead of ``first`` and ``last``."""
    return ranges.withColumn("month_no", F.explode(F.sequence("first", "last"))).drop("first", "last")


def people_in_ranges(practice: DataFrame, profile: DataFrame, residence: DataFrame, calendar: Calendar) -> DataFrame:
    """Ranges of windows in which a person is in a cell, with ``copies`` as in ``people_in_periods``.

    For calendars of equal windows; ranges of one person and cell are disjoint.
    """
    out = None
    for df, keys in ((practice, ["place"]), (profile, ["age_band", "sex"]), (residence, ["area"])):
        known = df.filter(F.col("patient").isNotNull())
        side = segments(known, calendar, ["patient", *keys], "period_start", "effective_end", "patient")
        if out is None:
            out = side
            continue
        side = side.withColumnsRenamed({"first": "from", "last": "to", "copies": "n"})
        met = out.join(side, "patient").filter((F.col("first") <= F.col("to")) & (F.col("from") <= F.col("last")))
        out = met.withColumns(
            {"first": F.greatest("first", "from"), "last": F.least("last", "to"), "copies": F.col("copies") * F.col("n")}
        ).drop("from", "to", "n")
    return out


def _seen(events: DataFrame, calendar: Calendar) -> DataFrame:
    """(patient, seen): a person's numbers of events, one entry per month that has any.

    For windows of one month a map from the window, else a list of ranges of
    windows that hold the events.
    """
    when = F.col("episode_start")
    first, last = window_range(calendar, when, when)
    ranges = events.filter(F.col("patient").isNotNull()).select("patient", first.alias("first"), last.alias("last"))
    counted = ranges.groupBy("patient", "first", "last").agg(F.count(F.lit(1)).alias("n")).repartition("patient")
    if calendar.width == 1:
        entries = F.map_from_entries(F.collect_list(F.struct("first", "n")))
    else:
        entries = F.collect_list(F.struct("first", "last", "n"))
    return counted.groupBy("patient").agg(entries.alias("seen"))


def _seen_in(calendar: Calendar) -> Column:
    """Events of the window ``month_no``; null if there are none."""
    if calendar.width == 1:
        return F.try_element_at("seen", F.col("month_no"))
    held = F.filter("seen", lambda e: F.col("month_no").between(e["first"], e["last"]))
    return F.nullif(F.aggregate(held, F.lit(0).cast("long"), lambda n, e: n + e["n"]), F.lit(0).cast("long"))


def people_in_periods(
    practice: DataFrame,
    profile: DataFrame,
    residence: DataFrame,
    calendar: Calendar,
    events: DataFrame | None = None,
    how: str = "left",
) -> DataFrame:
    """Join the three memberships, and events if given, on (patient, month_no).

    Inputs hold ``patient``, ``period_start`` and ``effective_end`` plus their
    keys: ``place`` for practice, ``age_band`` and ``sex`` for profile, ``area``
    for residence. Each (patient, month_no, place, area, age_band, sex) comes
    out once. ``copies`` is the number of membership row combinations behind
    it and ``events`` the person's events in the period. A person with very
    many places and areas in one period has a row for each combination: that
    is what cells count.

    On calendars of equal windows the periods are attached last, to ranges that
    carry their person's events by month. Stored calendars of unequal windows
    are joined on (patient, month_no).
    """
    if events is not None:
        events = events.filter(
            (F.col("episode_start") >= F.lit(calendar.first)) & (F.col("episode_start") < F.lit(calendar.last))
        )
    if calendar.width:
        columns = ["patient", "month_no", "place", "area", "age_band", "sex", "copies"]
        lasting = people_in_ranges(practice, profile, residence, calendar)
        if events is None:
            return in_windows(lasting).select(*columns)
        people = in_windows(lasting.join(_seen(events, calendar), "patient", how))
        out = people.select(*columns, _seen_in(calendar).alias("events"))
        return out.filter(F.col("events").isNotNull()) if how == "inner" else out
    inputs = [(practice, ["place"]), (profile, ["age_band", "sex"]), (residence, ["area"])]
    sides = [
        _counted(df, calendar, keys, "period_start", "effective_end").withColumnRenamed("copies", f"n{i}")
        for i, (df, keys) in enumerate(inputs)
    ]
    on = ["patient", "month_no"]
    out = sides[0].join(sides[1], on).join(sides[2], on)
    copies = F.col("n0") * F.col("n1") * F.col("n2")
    columns = [*on, "place", "area", "age_band", "sex", copies.alias("copies")]
    if events is not None:
        seen = _counted(events, calendar, [], "episode_start", "episode_start")
        out = out.join(seen.withColumnRenamed("copies", "events"), on, how)
        columns.append(F.col("events"))
    return out.select(*columns)

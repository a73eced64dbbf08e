"""Cells of overlapping windows, from changes instead of rows per person and window.

A membership touches a range of windows. It enters its cell at the first and
leaves it after the last, so a person gives two changes per range however many
windows the range spans; adding up a cell's changes in order gives its numbers
in every window. Several outcomes are counted in the same pass.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratelab.operators.cells import CODED, LINK_KEYS, Codes, PatientTables, event_rule, members
from ratelab.operators.membership import people_in_ranges, window_range

CELL = [c for c in CODED if c != "month_no"]


def _changes(ranges: DataFrame, amounts: dict[str, Column]) -> DataFrame:
    """``amounts`` coming in at ``first`` and going out after ``last``."""
    come = ranges.select(*CELL, F.col("first").alias("at"), *[a.alias(k) for k, a in amounts.items()])
    go = ranges.select(*CELL, (F.col("last") + 1).alias("at"), *[(-a).alias(k) for k, a in amounts.items()])
    return come.unionAll(go)


def cells_by_changes(t: PatientTables, outcomes: dict[str, Column] | None = None) -> DataFrame:
    """Population cells with the events of every outcome, on a calendar of equal windows.

    ``outcomes`` names measures and says which rows of the encounter table are
    their events; one row may belong to several. Without it, ``attends`` are the
    events of the rules. Equals ``rate_cells`` for each outcome; a cell without
    events of an outcome has null there. Work grows with memberships and with
    rows of the result, not with people times windows.
    """
    calendar = t.calendar
    if not calendar.width:
        raise ValueError("changes are counted on calendars of equal windows that start in consecutive months")
    outcomes = outcomes or {"attends": event_rule(t.rules)}
    if taken := set(outcomes) & {"persons", "at", *CODED, *LINK_KEYS}:
        raise ValueError(f"not a name for an outcome: {sorted(taken)}")
    codes = Codes(t)
    lasting = people_in_ranges(*members(t, codes), calendar)
    when = F.col("episode_start")
    first, last = window_range(calendar, when, when)
    seen = t.encounter.filter((when >= F.lit(calendar.first)) & (when < F.lit(calendar.last)) & F.col("patient").isNotNull())
    flags = {k: F.coalesce(rule, F.lit(False)).cast("long") for k, rule in outcomes.items()}
    seen = seen.select("patient", first.alias("e_first"), last.alias("e_last"), *[v.alias(k) for k, v in flags.items()])
    seen = seen.groupBy("patient", "e_first", "e_last").agg(*[F.sum(k).alias(k) for k in outcomes]).repartition("patient")
    seen = seen.filter(reduce(lambda a, b: a | b, [F.col(k) > 0 for k in outcomes]))
    met = lasting.join(seen, "patient").withColumns({"first": F.greatest("first", "e_first"), "last": F.least("last", "e_last")}).filter("first <= last")
    nothing = {k: F.lit(0).cast("long") for k in outcomes}
    people = _changes(lasting, {"persons": F.lit(1).cast("long"), **nothing})
    events = _changes(met, {"persons": F.lit(0).cast("long"), **{k: F.col("copies") * F.col(k) for k in outcomes}})
    numbers = ["persons", *outcomes]
    # At most one row per cell and window after this.
    steps = people.unionAll(events).groupBy(*CELL, "at").agg(*[F.sum(k).alias(k) for k in numbers])
    order = Window.partitionBy(*CELL).orderBy("at")
    running = steps.select(
        *CELL, "at", F.lead("at").over(order).alias("next"),
        *[F.sum(k).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k in numbers],
    ).filter("persons > 0")
    cells = running.withColumn("month_no", F.explode(F.expr("sequence(at, next - 1)"))).drop("at", "next")
    cells = codes.decode(cells, calendar, *numbers)
    # A cell with a null key has no partner in an equality join.
    linked = reduce(and_, [F.col(k).isNotNull() for k in LINK_KEYS])
    return cells.withColumns({k: F.when(linked & (F.col(k) > 0), F.col(k)) for k in outcomes})

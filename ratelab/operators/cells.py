"""Population and activity counts per stratum ("cells"), and their joins."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ratelab.functions.columns import age_band, nonblank, starts_with_any
from ratelab.operators.lookup import assign_lookup, compact_codes
from ratelab.operators.membership import (
    BROADCAST_PERIODS,
    clip_to_calendar,
    people_in_periods,
)
from ratelab.session import broadcast_checked
from ratelab.sources.calendar import Calendar


@dataclass(frozen=True)
class Rules:
    """Fixed values of the study definition."""

    source: int = 7
    census_year: str = "2011"
    method_prefixes: tuple[str, ...] = ("1", "2")
    episode_number: int = 1
    unmatched_quintile: int = 99
    unknown_gender: str = "U"
    age_limit: int = 105
    age_width: int = 15


@dataclass(frozen=True)
class PatientTables:
    """Patient-level inputs; column names as in ``ratelab.sources.tables.SCHEMAS``."""

    practice: DataFrame
    profile: DataFrame
    residence: DataFrame
    gender: DataFrame
    output_area: DataFrame
    organisation: DataFrame
    pcn: DataFrame
    imd: DataFrame
    encounter: DataFrame
    calendar: Calendar
    asof: date
    rules: Rules = field(default_factory=Rules)

    def with_rules(self, **changes) -> "PatientTables":
        return replace(self, rules=replace(self.rules, **changes))


PLACE = ["borough", "pcn_name", "practice_code", "practice_name"]
# Grain of a cell table.
CELL_KEYS = ["month", "month_no", "lsoa", *PLACE, "quintile", "age_band", "gender"]
# Keys that link an activity cell to its population cell: the period number
# stands for the period.
LINK_KEYS = [k for k in CELL_KEYS if k != "month"]


def practice_places(organisation: DataFrame, pcn: DataFrame) -> DataFrame:
    """Practice attributes per organisation; its parent organisation must exist."""
    parent = organisation.select(F.col("org").alias("parent_org"))
    listed = pcn.filter(nonblank("borough"))
    return (
        organisation.join(parent, "parent_org")
        .join(listed, F.col("org_code") == F.col("practice_code"))
        .select("org", *PLACE)
    )


class Codes:
    """Dimensions as compact codes: only numbers travel through the big shuffles."""

    def __init__(self, t: PatientTables):
        places = practice_places(t.organisation, t.pcn)
        areas = t.output_area.filter(F.col("census_year") == t.rules.census_year).select("area_sk", "lsoa")
        place, place_names = compact_codes(places, "org", PLACE, "place")
        area, area_names = compact_codes(areas, "area_sk", ["lsoa"], "area")
        sex, sex_names = compact_codes(t.gender.select("gender_sk", "gender"), "gender_sk", ["gender"], "sex")
        # The quintile belongs to the area, so it is attached to the area table
        # rather than to every cell.
        area_names = assign_lookup(
            area_names, t.imd, "lsoa", "imd_quintile", "quintile", t.rules.unmatched_quintile
        )
        self.place, self.area, self.sex, self.place_names, self.area_names, self.sex_names = broadcast_checked(
            place, area, sex, place_names, area_names, sex_names
        )

    def decode(self, cells: DataFrame, calendar: Calendar, *measures: str) -> DataFrame:
        return (
            cells.join(self.place_names, "place")
            .join(self.area_names, "area")
            .join(self.sex_names, "sex")
            .join(month_names(calendar), "month_no")
            .select(*CELL_KEYS, *measures)
        )


def month_names(calendar: Calendar) -> DataFrame:
    names = calendar.periods.select("month_no", "month")
    return F.broadcast(names) if calendar.count <= BROADCAST_PERIODS else names


def event_rule(rules: Rules) -> Column:
    """Which rows of the encounter table are events of the study."""
    return starts_with_any("method", rules.method_prefixes) & (F.col("episode_number") == rules.episode_number)


def members(t: PatientTables, codes: Codes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Practice, profile and residence memberships that touch the calendar, in codes."""
    rules, calendar = t.rules, t.calendar

    def member(df: DataFrame, extra_end: str) -> DataFrame:
        keep, effective = clip_to_calendar(calendar, "period_start", "period_end", extra_end)
        return df.filter((F.col("source") == rules.source) & keep).withColumn("effective_end", effective)

    compact = ["patient", "period_start", "effective_end"]
    practice = member(t.practice, "date_left").join(codes.place, "org").select(*compact, "place")
    residence = member(t.residence, "date_detected_end").join(codes.area, "area_sk").select(*compact, "area")
    profile = (
        member(t.profile, "date_of_death")
        .join(codes.sex, "gender_sk")
        .select(*compact, age_band("dob", t.asof, rules.age_width).alias("age_band"), "sex")
    )
    return practice, profile, residence


def _people(t: PatientTables, codes: Codes, with_events: bool, how: str = "left") -> DataFrame:
    events = None
    if with_events:
        events = t.encounter.filter(event_rule(t.rules)).select("patient", "episode_start")
    return people_in_periods(*members(t, codes), t.calendar, events, how)


CODED = ["month_no", "place", "area", "age_band", "sex"]


def population_cells(t: PatientTables) -> DataFrame:
    """Distinct people per cell.

    A person occurs once per cell and period in the joined memberships, so the
    distinct count is a plain count.
    """
    codes = Codes(t)
    people = _people(t, codes, with_events=False)
    cells = people.groupBy(*CODED).agg(F.count(F.lit(1)).alias("persons"))
    return codes.decode(cells, t.calendar, "persons")


def activity_cells(t: PatientTables, measure: str = "attends", distinct_events: bool = False) -> DataFrame:
    """Event rows per cell.

    An event counts once for every combination of membership rows its person
    has in the period; ``distinct_events`` counts it once per cell instead.
    """
    codes = Codes(t)
    people = _people(t, codes, with_events=True, how="inner")
    count = F.col("events") if distinct_events else F.col("copies") * F.col("events")
    cells = people.groupBy(*CODED).agg(F.sum(count).alias(measure))
    return codes.decode(cells, t.calendar, measure)


def rate_cells(t: PatientTables, measure: str = "attends", distinct_events: bool = False) -> DataFrame:
    """Population cells with their events, in one pass over the memberships.

    Equals ``link_cells(population_cells(t), activity_cells(t))``: every event
    cell lies inside a population cell. Cells without events have null events.
    """
    codes = Codes(t)
    people = _people(t, codes, with_events=True, how="left")
    count = F.col("events") if distinct_events else F.col("copies") * F.col("events")
    cells = people.groupBy(*CODED).agg(
        F.count(F.lit(1)).alias("persons"), F.sum(count).alias(measure)
    )
    decoded = codes.decode(cells, t.calendar, "persons", measure)
    # A cell with a null key has no partner in an equality join.
    linked = reduce(and_, [F.col(k).isNotNull() for k in LINK_KEYS])
    return decoded.withColumn(measure, F.when(linked, F.col(measure)))


def study_strata(cells: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Known quintile, known gender, age below the limit; nulls are dropped."""
    return cells.filter(
        (F.col("quintile") != rules.unmatched_quintile)
        & (F.col("gender") != rules.unknown_gender)
        & (F.col("age_band") < rules.age_limit)
    )


def link_cells(population: DataFrame, activity: DataFrame, measure: str = "attends") -> DataFrame:
    """Population cells left-joined with activity cells on the full grain."""
    return population.join(activity.select(*LINK_KEYS, measure), LINK_KEYS, "left")


def link_cells_on(
    population: DataFrame, activity: DataFrame, keys: list[str], measure: str = "attends"
) -> DataFrame:
    """The same on fewer keys: each side is summed to the keys first.

    Joining finer cells on fewer keys would repeat rows and inflate both sums.
    """
    persons = population.groupBy(*keys).agg(F.sum("persons").alias("persons"))
    events = activity.groupBy(*keys).agg(F.sum(measure).alias(measure))
    return persons.join(events, keys, "left")


def sum_cells(
    linked: DataFrame, keys: list[str], measure: str = "attends", zero_fill: bool = False
) -> DataFrame:
    """Persons and events by ``keys``.

    Without ``zero_fill`` a group with no matched events has null events. When
    the keys leave out the period, persons are person-periods.
    """
    events = F.sum(measure)
    if zero_fill:
        events = F.coalesce(events, F.lit(0))
    return linked.groupBy(*keys).agg(F.sum("persons").alias("persons"), events.alias(measure))

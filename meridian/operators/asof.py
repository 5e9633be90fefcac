"""As-of joins: whole snapshots, bitemporal events, next rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.ts import forward_fill


def membership_asof(snapshots: DataFrame, calendar: DataFrame, codes: DataFrame) -> DataFrame:
    """``di, code``: names in the newest snapshot on or before each day.

    ``snapshots`` has ``snap_date, code``. A name missing from the newest snapshot is out. Snapshots that hold none of ``codes`` don't count. Days
    before the first snapshot have no names. The range join runs over days and snapshot dates only, never over names.
    """
    known = snapshots.join(codes.select("code").distinct(), "code", "left_semi").distinct()
    dates = known.select("snap_date").distinct().withColumn("until", F.lead("snap_date").over(Window.orderBy("snap_date")))
    # snapshot dates: one row per month or so
    days = calendar.join(F.broadcast(dates), (F.col("date") >= F.col("snap_date")) & (F.col("until").isNull() | (F.col("date") < F.col("until")))).select("di", "snap_date")
    return known.join(days, "snap_date").select("di", "code")


def pit_fill(events: DataFrame, calendar: DataFrame, grid: DataFrame) -> DataFrame:
    """``di, date, code, value``: the value known on each day from events (``code, report_date, pub_date, value``).

    An event counts from the first day strictly after its publication, and only if no later report period was published before it;
    of several on one effective day the last by (pub_date, report_date) counts. A missing report date is the publication date.
    Events without a value, a publication date or a later day, and those of unknown codes, are left out.
    """
    usable = events.where("value IS NOT NULL AND pub_date IS NOT NULL").withColumn("report_date", F.coalesce("report_date", "pub_date"))
    order = ["pub_date", "report_date", "value"]
    seen = Window.partitionBy("code").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fresh = usable.withColumn("newest", F.max("report_date").over(seen)).where("report_date = newest")
    first = calendar.agg(F.min("date").alias("d")).first()["d"]
    days = calendar.select("di", "date", F.lag("date").over(Window.orderBy("date")).alias("before"))
    # publication dates from one calendar day to the eve of the next count from that next day: a row per natural day
    effective = days.select("di", F.explode(F.sequence(F.coalesce("before", F.date_sub("date", 1)), F.date_sub("date", 1))).alias("known_on"))
    dated = fresh.withColumn("known_on", F.greatest("pub_date", F.date_sub(F.lit(first), 1))).join(F.broadcast(effective), "known_on")
    last = dated.groupBy("di", "code").agg(F.max_by("value", F.struct(*order)).alias("event"))
    filled = grid.select("di", "date", "code").join(last, ["di", "code"], "left")
    return filled.select("di", "date", "code", forward_fill(F.col("event")).alias("value"))


def latest_known(series: DataFrame, days: DataFrame, column: str = "value", floor: float | None = None) -> DataFrame:
    """``di`` and ``column`` for every day: the last value of the series on or before it; before the first there is none. With ``floor``, missing and smaller values become it."""
    both = days.select("di", F.lit(None).cast("double").alias(column), F.lit(1).alias("asked")).unionByName(series.select("di", column, F.lit(0).alias("asked")))
    order = Window.orderBy("di", "asked").rowsBetween(Window.unboundedPreceding, 0)  # one row per day and value of one series
    found = both.select("di", "asked", F.last(column, ignorenulls=True).over(order).alias(column)).where("asked = 1")
    value = F.col(column) if floor is None else F.greatest(F.coalesce(column, F.lit(floor)), F.lit(floor))
    return found.select("di", value.alias(column))


def next_day(calendar: DataFrame) -> DataFrame:
    """``di, next_di``: the execution day of each signal day; null for the last."""
    return calendar.select("di", F.lead("di").over(Window.orderBy("di")).alias("next_di"))


def upsert_periods(cached: DataFrame, fetched: DataFrame, period: str = "report_date") -> DataFrame:
    """``cached`` with the periods that ``fetched`` has replaced; a period without fetched rows keeps its cached ones."""
    new = fetched.select(period).distinct()
    return cached.join(new, period, "left_anti").unionByName(fetched)

"""Time features of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.ordering import CASE, EventLog, around, per_case, running

MICRO = 1e6


def since_case_start(log: EventLog, out: str = "case_elapsed_time") -> EventLog:
    """Seconds since the first event of the case."""
    with_start = per_case(log, start_us=F.min("us"))
    return log.with_events(
        with_start.events.withColumn(out, (F.col("us") - F.col("start_us")) / MICRO).drop("start_us")
    )


def longest_case(log: EventLog) -> DataFrame:
    return log.events.groupBy(CASE).count().agg(F.max("count").alias("max_case_length"))


def since_earlier_event(log: EventLog, out: str = "event_elapsed_time") -> EventLog:
    """Seconds since the previous strictly earlier time; ties share it, the first time has none."""
    stepped = around(
        log,
        lambda df, w: df.withColumn(
            "earlier_us", F.when(F.col("us") > F.lag("us").over(w), F.lag("us").over(w))
        ),
        before=1,
    )
    known = running(stepped, {"last_us": ("last", "earlier_us")}, through=True)
    return log.with_events(
        known.events.withColumn(out, (F.col("us") - F.col("last_us")) / MICRO).drop("earlier_us", "last_us")
    )


def since_last_row(log: EventLog, out: str = "event_elapsed_time") -> EventLog:
    """Seconds between neighbouring rows, 0 for the first row and for ties."""
    return around(
        log,
        lambda df, w: df.withColumn(
            out, F.coalesce((F.col("us") - F.lag("us").over(w)) / MICRO, F.lit(0.0))
        ),
        before=1,
    )


def at_time() -> Column:
    return F.timestamp_micros("us")


def day_in_week() -> Column:
    """0 is Monday."""
    return F.weekday(at_time())


def seconds_in_day() -> Column:
    return F.hour(at_time()) * 3600 + F.minute(at_time()) * 60 + F.second(at_time())


def with_time_features(log: EventLog) -> EventLog:
    """The four derived time columns; numeric ones join the dynamic attributes."""
    timed = since_earlier_event(since_case_start(log))
    return timed.with_events(
        timed.events.withColumn("day_in_week", day_in_week().cast("double")).withColumn(
            "seconds_in_day", seconds_in_day().cast("double")
        )
    )

"""Service dates, shared by the calendar rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..feed import Feed
from ..functions.exprs import full

C = F.col
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def service_dates(feed: Feed, clamp: bool, last_row: bool = False) -> DataFrame:
    """service_id, date: days of calendar, with the exceptions of calendar_dates; of exceptions of a date the last counts.

    clamp: a calendar that ends before it starts is active on its first day alone, if that weekday is; else never.
    last_row: a later calendar row of a service replaces earlier ones.
    """
    c = feed.df("calendar").where(full(C("service_id")) & C("start_date").isNotNull() & C("end_date").isNotNull())
    if last_row:
        c = c.groupBy("service_id").agg(*[F.max_by(x, "_row").alias(x) for x in ("start_date", "end_date", *DAYS)])
    end = F.greatest("start_date", "end_date") if clamp else C("end_date")
    active = F.array(*[C(d) == 1 for d in DAYS])
    c = c.withColumn("_end", end).where("_end >= start_date").select("service_id", active.alias("_on"), F.explode(F.sequence("start_date", "_end")).alias("date"))
    c = c.where(F.get("_on", F.weekday("date"))).select("service_id", "date").distinct()
    x = feed.df("calendar_dates").where(full(C("service_id")) & C("date").isNotNull()).groupBy("service_id", "date").agg(F.max_by("exception_type", "_row").alias("x"))
    return c.join(x.where("x = 2"), ["service_id", "date"], "left_anti").unionByName(x.where("x = 1").select("service_id", "date")).distinct()

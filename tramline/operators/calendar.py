"""Calendars, service dates and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..feed import Feed, RunOptions, note
from ..functions.exprs import full
from ..plans.service import service_dates
from . import rule
from .keys import repeats

C = F.col


def day(c):
    return F.date_format(c, "yyyyMMdd")


@rule("CalendarValidator")
def calendar(feed: Feed, options: RunOptions):
    out = []
    if feed.has("calendar"):
        context = {"startFieldName": "start_date", "endFieldName": "end_date", "startValue": day("start_date"), "endValue": day("end_date"), "entityId": C("service_id")}
        out.append(note(feed.df("calendar").where("start_date > end_date"), "start_and_end_range_out_of_order", "ERROR", "calendar", context))
    if feed.has("calendar_dates"):
        rows = repeats(feed.df("calendar_dates").where(full(C("service_id")) & C("date").isNotNull()), [C("service_id"), C("date")])
        context = {"fieldName1": "service_id", "fieldValue1": C("service_id"), "fieldName2": "date", "fieldValue2": day("date"), "oldCsvRowNumber": C("_first"), "newCsvRowNumber": C("_row")}
        out.append(note(rows, "duplicate_key", "ERROR", "calendar_dates", context))
    return out


@rule("ExpiredCalendarValidator", gated="calendar calendar_dates")
def expired_calendar(feed: Feed, options: RunOptions):
    last = service_dates(feed, clamp=True).groupBy("service_id").agg(F.max("date").alias("last"))
    today = F.lit(options.date)
    rows = feed.df("calendar").select("service_id", "_row").join(last, "service_id").where(C("last") < today)
    out = [note(rows, "expired_calendar", "WARNING", "calendar", {"serviceId": C("service_id")})]
    if not feed.has("calendar") or not feed.df("calendar").limit(1).count():
        # only calendar_dates: reported if no service is active any more
        live = last.where(C("last") >= today).select(F.lit(1).alias("_one")).limit(1)
        first = feed.df("calendar_dates").groupBy("service_id").agg(F.min("_row").alias("_row")).join(last, "service_id").withColumn("_one", F.lit(1)).join(F.broadcast(live), "_one", "left_anti")
        out.append(note(first, "expired_calendar", "WARNING", "calendar_dates", {"serviceId": C("service_id")}))
    return out


def trips_per_date(feed: Feed):
    """date, n: trips on each service date; a trip with frequencies counts as often as it runs."""
    runs = F.expr("case when headway_secs > 0 and end_time > start_time then 1 + (end_time - start_time - 1) div headway_secs else 0 end")
    f = feed.df("frequencies").where(full(C("trip_id"))).groupBy("trip_id").agg(F.sum(runs).alias("times"))
    t = feed.df("trips").select("trip_id", "service_id").join(f, "trip_id", "left").groupBy("service_id").agg(F.sum(F.coalesce("times", F.lit(1))).alias("k"))
    return service_dates(feed, clamp=True).join(t, "service_id").groupBy("date").agg(F.sum("k").alias("n"))


def majority_window(feed: Feed):
    """start, end: the first and last date with about as many trips as usual; one row, or none without service."""
    n = trips_per_date(feed)  # a row per date
    w = Window.partitionBy(F.lit(0))
    n = n.withColumn("at", F.row_number().over(w.orderBy("n", "date")) - 1).withColumn("size", F.count("*").over(w))
    n = n.withColumn("pick", F.greatest(F.floor(0.9 * C("size")), C("size") - 30).cast("int"))
    n = n.withColumn("least", F.floor(0.75 * F.max(F.when(C("at") == F.least(C("pick"), C("size") - 1), C("n"))).over(w)))
    return n.where("n >= least").groupBy().agg(F.min("date").alias("start"), F.max("date").alias("end")).where("start is not null")


@rule("DateTripsValidator", needs="trips", gated="trips calendar calendar_dates frequencies")
def date_trips(feed: Feed, options: RunOptions):
    today = F.lit(options.date)
    rows = majority_window(feed).where((C("start") > today) | (C("end") < F.date_add(today, 7)))
    context = {"currentDate": day(today), "serviceWindowStartDate": day("start"), "serviceWindowEndDate": day("end")}
    return note(rows, "trip_coverage_not_active_for_next7_days", "WARNING", "trips", context, row=None)


@rule("GoogleServiceGapValidator", google=True)
def service_gap(feed: Feed, options: RunOptions):
    dates = service_dates(feed, clamp=False, last_row=True).select("date").distinct()  # a row per date
    dates = dates.withColumn("next", F.lead("date").over(Window.partitionBy(F.lit(0)).orderBy("date")))
    return note(dates.where(F.datediff("next", "date") >= 14), "too_many_days_without_service", "WARNING", "calendar", {"firstDate": day("date"), "nextDate": day("next")}, row=None)

"""Checks of rows in order within a trip, group or service."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..feed import Feed, RunOptions, note
from ..functions.exprs import blank, clock, full
from . import rule
from .intervals import started_within
from .rows import fields

C = F.col


def in_trip():
    return Window.partitionBy("trip_id").orderBy("stop_sequence", "_row")


def from_end():
    return Window.partitionBy("trip_id").orderBy(F.desc("stop_sequence"), F.desc("_row"))


@rule("StopTimeArrivalAndDepartureTimeValidator", needs="stop_times")
def arrival_and_departure(feed: Feed, options: RunOptions):
    st = feed.df("stop_times").where(full(C("trip_id")))
    a, d = C("arrival_time"), C("departure_time")
    before = in_trip().rowsBetween(Window.unboundedPreceding, -1)
    st = st.withColumn("_p", F.last(F.when(d.isNotNull(), F.struct(d.alias("d"), C("_row").alias("r"))), ignorenulls=True).over(before))
    who = {"tripId": C("trip_id"), "stopSequence": C("stop_sequence")}
    one = fields(st, {"arrival_time": a.isNotNull() & d.isNull(), "departure_time": d.isNotNull() & a.isNull()})
    swapped = {"startFieldName": "arrival_time", "endFieldName": "departure_time", "startValue": clock(a), "endValue": clock(d), "entityId": C("trip_id")}
    return [
        note(one, "stop_time_with_only_arrival_or_departure_time", "ERROR", "stop_times", who | {"specifiedField": C("f")}, at=C("f")),
        note(st.where(a > d), "start_and_end_range_out_of_order", "ERROR", "stop_times", swapped),
        note(st.where(a < C("_p.d")), "stop_time_with_arrival_before_previous_departure_time", "ERROR", "stop_times", {"tripId": C("trip_id"), "arrivalTime": clock(a), "departureTime": clock(C("_p.d")), "prevCsvRowNumber": C("_p.r")}),
    ]


@rule("MissingTripEdgeValidator", needs="stop_times")
def missing_trip_edge(feed: Feed, options: RunOptions):
    st = feed.df("stop_times").where(full(C("trip_id")))
    st = st.withColumn("_a", F.row_number().over(in_trip())).withColumn("_z", F.row_number().over(from_end()))
    ends = F.array_compact(F.array(F.when(C("_a") == 1, 1), F.when(C("_z") == 1, 2)))  # a trip of one stop has both
    st = st.where("(_a = 1 or _z = 1) and start_pickup_drop_off_window is null and end_pickup_drop_off_window is null").withColumn("_e", F.explode(ends))
    out = fields(st, {"arrival_time": C("arrival_time").isNull(), "departure_time": C("departure_time").isNull()})
    return note(out, "missing_trip_edge", "ERROR", "stop_times", {"tripId": C("trip_id"), "stopSequence": C("stop_sequence"), "specifiedField": C("f")}, at=C("f"))


@rule("StopTimesRecordValidator", needs="stop_times", gated="stop_times")
def stop_times_record(feed: Feed, options: RunOptions):
    if not feed.header("stop_times", "start_pickup_drop_off_window", "end_pickup_drop_off_window", "pickup_type", "drop_off_type"):
        return None
    st = feed.df("stop_times").withColumn("_n", F.count("*").over(Window.partitionBy("trip_id")))
    st = st.where("_n = 1 and start_pickup_drop_off_window is not null and end_pickup_drop_off_window is not null and pickup_type = 2 and drop_off_type = 2")
    return note(st, "missing_stop_times_record", "ERROR", "stop_times", {"tripId": C("trip_id"), "locationGroupId": C("location_group_id"), "locationId": C("location_id")})


@rule("StopTimeIncreasingDistanceValidator", needs="stop_times")
def increasing_distance(feed: Feed, options: RunOptions):
    st = feed.df("stop_times").where(full(C("trip_id")) & full(C("stop_id")) & blank(C("location_id")) & blank(C("location_group_id")))
    st = st.withColumn("_p", F.lag(F.struct("_row", "stop_sequence", "shape_dist_traveled")).over(in_trip()))
    context = {"tripId": C("trip_id"), "stopId": C("stop_id"), "stopSequence": C("stop_sequence"), "shapeDistTraveled": C("shape_dist_traveled")}
    context |= {"prevCsvRowNumber": C("_p._row"), "prevStopSequence": C("_p.stop_sequence"), "prevShapeDistTraveled": C("_p.shape_dist_traveled")}
    return note(st.where(C("_p.shape_dist_traveled") >= C("shape_dist_traveled")), "decreasing_or_equal_stop_time_distance", "ERROR", "stop_times", context)


@rule("OverlappingFrequencyValidator", needs="frequencies")
def overlapping_frequency(feed: Feed, options: RunOptions):
    w = Window.partitionBy("trip_id").orderBy("start_time", "end_time", "headway_secs", "_row")
    f = feed.df("frequencies").where(full(C("trip_id"))).withColumn("_p", F.lag(F.struct("_row", "end_time")).over(w))
    context = {"tripId": C("trip_id"), "prevCsvRowNumber": C("_p._row"), "currCsvRowNumber": C("_row"), "prevEndTime": clock(C("_p.end_time")), "currStartTime": clock(C("start_time"))}
    return note(f.where(C("start_time") < C("_p.end_time")), "overlapping_frequency", "ERROR", "frequencies", context)


@rule("TimeframeOverlapValidator", needs="timeframes")
def timeframe_overlap(feed: Feed, options: RunOptions):
    t = feed.df("timeframes").where(full(C("timeframe_group_id")) & full(C("service_id")) & C("start_time").isNotNull() & C("end_time").isNotNull())
    w = Window.partitionBy("timeframe_group_id", "service_id").orderBy("start_time", "end_time", "_row")
    t = t.withColumn("_p", F.lag(F.struct("_row", "end_time")).over(w)).withColumn("_o", F.coalesce(C("start_time") < C("_p.end_time"), F.lit(False)).cast("int"))
    t = t.withColumn("_k", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_o = 1 and _k = 1")
    context = {"timeframeGroupId": C("timeframe_group_id"), "serviceId": C("service_id"), "prevCsvRowNumber": C("_p._row"), "currCsvRowNumber": C("_row"), "prevEndTime": clock(C("_p.end_time")), "currStartTime": clock(C("start_time"))}
    return note(t, "timeframe_overlap", "ERROR", "timeframes", context)


@rule("TripUsabilityValidator", needs="trips", gated="trips stop_times")
def unusable_trip(feed: Feed, options: RunOptions):
    n = feed.df("stop_times").groupBy(C("trip_id").alias("_t")).agg(F.count("*").alias("n")).where("n > 1")
    rows = feed.df("trips").where(full(C("trip_id"))).join(n, C("trip_id") == C("_t"), "left_anti")
    return note(rows, "unusable_trip", "WARNING", "trips", {"tripId": C("trip_id")})


@rule("FareProductDefaultRiderCategoriesValidator", needs="rider_categories", thorough=True)
def default_categories(feed: Feed, options: RunOptions):
    d = feed.df("rider_categories").where("is_default_fare_category = 1")
    pair = lambda w, by: (F.row_number().over(w.orderBy(*by)), F.count("*").over(w))
    first = d.withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_row"))).where("_at <= 2")
    two = first.groupBy().agg(F.min_by("_row", "_at").alias("r1"), F.max_by("_row", "_at").alias("r2"), F.min_by("rider_category_id", "_at").alias("c1"), F.max_by("rider_category_id", "_at").alias("c2"), F.count("*").alias("n")).where("n > 1")
    context = {"csvRowNumber1": C("r1"), "csvRowNumber2": C("r2"), "riderCategoryId1": C("c1"), "riderCategoryId2": C("c2")}
    out = [note(two, "fare_product_with_multiple_default_rider_categories", "ERROR", "rider_categories", {"fareProductId": None} | context, row=None)]
    if feed.has("fare_products"):
        ids = d.select("rider_category_id").distinct()
        p = feed.df("fare_products").join(ids, "rider_category_id").groupBy("fare_product_id", "rider_category_id").agg(F.min("_row").alias("_row"))
        w = Window.partitionBy("fare_product_id")
        at, _ = pair(w, ["_row"])
        p = p.withColumn("_at", at).where("_at <= 2").groupBy("fare_product_id").agg(
            F.min_by("_row", "_at").alias("r1"), F.max_by("_row", "_at").alias("r2"), F.min_by("rider_category_id", "_at").alias("c1"), F.max_by("rider_category_id", "_at").alias("c2"), F.count("*").alias("n")
        )
        out.append(note(p.where("n > 1"), "fare_product_with_multiple_default_rider_categories", "ERROR", "fare_products", {"fareProductId": C("fare_product_id")} | context, row="r1"))
    return out


@rule("BlockTripsWithOverlappingStopTimesValidator", needs="trips stop_times")
def block_overlap(feed: Feed, options: RunOptions):
    from ..plans.service import service_dates

    st = feed.df("stop_times")
    span = st.groupBy("trip_id").agg(
        F.min_by(F.coalesce("departure_time", "arrival_time"), F.struct("stop_sequence", "_row")).alias("start"), F.max_by(F.coalesce("arrival_time", "departure_time"), F.struct("stop_sequence", "_row")).alias("end")
    )
    t = feed.df("trips").where(full(C("block_id"))).select("trip_id", "block_id", "service_id", "_row").join(span.where("start is not null and end is not null"), "trip_id")
    t = t.select("block_id", "trip_id", "service_id", "_row", "start", "end", F.struct("start", "_row").alias("key"))
    pairs = started_within(t, ["block_id"], "start", "end", "key")
    same = pairs.where("service_id_a = service_id_b")
    other = pairs.where("service_id_a <> service_id_b")
    # services that share a date: far fewer pairs than trips
    services = other.select(C("service_id_a").alias("a"), C("service_id_b").alias("b")).distinct()
    dates = service_dates(feed, clamp=False)
    shared = services.join(dates.select(C("service_id").alias("a"), "date"), "a").join(dates.select(C("service_id").alias("b"), "date"), ["b", "date"]).select(C("a").alias("service_id_a"), C("b").alias("service_id_b")).distinct()
    rows = same.unionByName(other.join(shared, ["service_id_a", "service_id_b"], "left_semi"))
    context = {"blockId": C("block_id"), "csvRowNumberA": C("_row_a"), "csvRowNumberB": C("_row_b"), "tripIdA": C("trip_id_a"), "tripIdB": C("trip_id_b"), "serviceIdA": C("service_id_a"), "serviceIdB": C("service_id_b")}
    return note(rows, "block_trips_with_overlapping_stop_times", "ERROR", "trips", context | {"intersection": F.greatest("start_a", "start_b") - F.least("end_a", "end_b")}, row="_row_a")


@rule("OverlappingPickupDropOffZoneValidator", needs="stop_times", thorough=True)
def zone_overlap(feed: Feed, options: RunOptions):
    cols = ["trip_id", "_row", "stop_sequence", "location_id", "location_group_id", "pickup_type", "drop_off_type", C("start_pickup_drop_off_window").alias("ws"), C("end_pickup_drop_off_window").alias("we")]
    st = feed.df("stop_times").select(*cols).where("ws is not null and we is not null")
    side = lambda s: st.select("trip_id", *[C(c).alias(f"{c}{s}") for c in st.columns if c != "trip_id"])
    p = side(1).join(side(2), "trip_id").where("struct(stop_sequence1, _row1) < struct(stop_sequence2, _row2) and ws1 < we2 and ws2 < we1")
    p = p.where("(coalesce(pickup_type1, 0) = coalesce(pickup_type2, 0) or coalesce(drop_off_type1, 0) = coalesce(drop_off_type2, 0)) and least(coalesce(pickup_type1, 0), coalesce(pickup_type2, 0), coalesce(drop_off_type1, 0), coalesce(drop_off_type2, 0)) >= 0")
    alike = F.coalesce((C("location_id1") == C("location_id2")) | (C("location_group_id1") == C("location_group_id2")), F.lit(False))
    if feed.has("locations"):
        box = feed.tables["locations"]
        for s in (1, 2):
            p = p.join(box.select(C("location_id").alias(f"location_id{s}"), *[C(c).alias(f"{c}{s}") for c in ("minx", "miny", "maxx", "maxy")]), f"location_id{s}", "left")
        alike |= F.coalesce((C("minx1") <= C("maxx2")) & (C("minx2") <= C("maxx1")) & (C("miny1") <= C("maxy2")) & (C("miny2") <= C("maxy1")), F.lit(False))
    context = {"tripId": C("trip_id")} | {f"{k}{s}": v for s in (1, 2) for k, v in (("stopSequence", C(f"stop_sequence{s}")), ("locationId", F.coalesce(f"location_id{s}", f"location_group_id{s}")), ("startPickupDropOffWindow", clock(C(f"ws{s}"))), ("endPickupDropOffWindow", clock(C(f"we{s}"))))}
    return note(p.where(alike), "overlapping_zone_and_pickup_drop_off_window", "ERROR", "stop_times", context, row="_row2")


@rule("DuplicateTripValidator", needs="trips stop_times", google=True)
def duplicate_trip(feed: Feed, options: RunOptions):
    st = feed.df("stop_times").where(full(C("trip_id"))).groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("_row", "stop_id", "arrival_time", "departure_time"))).alias("s"))
    st = st.select("trip_id", F.sha2(F.to_json(F.transform("s", lambda x: F.struct(x["stop_id"], x["arrival_time"], x["departure_time"]))), 256).alias("sig"))
    t = feed.df("trips").join(st, "trip_id").groupBy("service_id", "route_id", "direction_id", "block_id", "shape_id", "sig")
    # the five least rows of each group, without gathering the group
    w = Window.partitionBy("service_id", "route_id", "direction_id", "block_id", "shape_id", "sig").orderBy("_row")
    few = feed.df("trips").join(st, "trip_id").withColumn("_at", F.row_number().over(w)).where("_at <= 5")
    few = few.groupBy("service_id", "route_id", "direction_id", "block_id", "shape_id", "sig").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "trip_id"))), lambda x: x["trip_id"]), ",").alias("ids"))
    n = t.agg(F.count("*").alias("n"), F.min("_row").alias("_row")).where("n > 1")
    keys = ["service_id", "route_id", "direction_id", "block_id", "shape_id", "sig"]
    same = None
    for k in keys:
        one = n[k].eqNullSafe(few[k])
        same = one if same is None else same & one
    return note(n.join(few, same).select(n["n"], n["_row"], "ids"), "duplicate_trip", "WARNING", "trips", {"tripCount": C("n"), "exampleTripIds": C("ids")})

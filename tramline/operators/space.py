"""Distances and speeds along trips and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..feed import Feed, RunOptions, note
from ..functions.exprs import clock, full, haversine, max_speed, speed_kph
from . import rule
from .stations import last_by
from .transfers import located

C = F.col
#: Distance over which stops are far apart; room for rounding, in km.
FAR_KM, ROUNDING = 10.0, 1e-6


@rule("ShapeIncreasingDistanceValidator", needs="shapes")
def shape_distance(feed: Feed, options: RunOptions):
    w = Window.partitionBy("shape_id").orderBy("shape_pt_sequence", "_row")
    s = feed.df("shapes").where(full(C("shape_id"))).withColumn("p", F.lag(F.struct("_row", "shape_pt_sequence", "shape_dist_traveled", "shape_pt_lat", "shape_pt_lon")).over(w))
    d, pd = C("shape_dist_traveled"), C("p.shape_dist_traveled")
    s = s.withColumn("m", haversine(C("p.shape_pt_lat"), C("p.shape_pt_lon"), C("shape_pt_lat"), C("shape_pt_lon")))
    same = (C("p.shape_pt_lat") == C("shape_pt_lat")) & (C("p.shape_pt_lon") == C("shape_pt_lon"))
    context = {"shapeId": C("shape_id"), "shapePtSequence": C("shape_pt_sequence"), "shapeDistTraveled": d, "prevCsvRowNumber": C("p._row"), "prevShapePtSequence": C("p.shape_pt_sequence"), "prevShapeDistTraveled": pd}
    apart = context | {"actualDistanceBetweenShapePoints": C("m")}
    equal = s.where(d == pd)
    return [
        note(s.where(d < pd), "decreasing_shape_distance", "ERROR", "shapes", context),
        note(equal.where(same), "equal_shape_distance_same_coordinates", "WARNING", "shapes", context),
        note(equal.where(~same & (C("m") >= 1.11)), "equal_shape_distance_diff_coordinates", "ERROR", "shapes", apart),
        note(equal.where(~same & (C("m") > 0) & (C("m") < 1.11)), "equal_shape_distance_diff_coordinates_distance_below_threshold", "WARNING", "shapes", apart),
    ]


@rule("SingleShapePointValidator", needs="shapes")
def single_point(feed: Feed, options: RunOptions):
    s = feed.df("shapes").where(full(C("shape_id"))).groupBy("shape_id").agg(F.count("*").alias("n"), F.min("_row").alias("_row")).where("n = 1")
    return note(s, "single_shape_point", "WARNING", "shapes", {"shapeId": C("shape_id")})


@rule("TripAndShapeDistanceValidator", needs="trips stop_times shapes stops")
def trip_and_shape(feed: Feed, options: RunOptions):
    s = feed.df("shapes").where("shape_dist_traveled is not null").groupBy("shape_id").agg(F.max_by(F.struct(C("shape_dist_traveled").alias("d"), C("shape_pt_lat").alias("lat"), C("shape_pt_lon").alias("lon")), F.struct("shape_dist_traveled", -C("_row"))).alias("m"))
    st = feed.df("stop_times").where(full(C("trip_id"))).groupBy("trip_id").agg(F.max_by(F.struct("stop_id", C("shape_dist_traveled").alias("d")), F.struct("stop_sequence", "_row")).alias("z"))
    places = last_by(feed.df("stops"), "stop_id", "stop_lat", "stop_lon")
    t = feed.df("trips").where(full(C("shape_id"))).join(s, "shape_id").join(st, "trip_id").withColumn("stop_id", C("z.stop_id")).join(places, "stop_id")
    t = t.where("m.d > 0 and z.d > m.d and stop_lat is not null and stop_lon is not null").withColumn("far", haversine(C("stop_lat"), C("stop_lon"), C("m.lat"), C("m.lon")))
    context = {"tripId": C("trip_id"), "shapeId": C("shape_id"), "maxTripDistanceTraveled": C("z.d"), "maxShapeDistanceTraveled": C("m.d"), "geoDistanceToShape": C("far")}
    return [
        note(t.where("far > 11.1"), "trip_distance_exceeds_shape_distance", "ERROR", "trips", context),
        note(t.where("far <= 11.1 and far > 0"), "trip_distance_exceeds_shape_distance_below_threshold", "WARNING", "trips", context),
    ]


def far_stops(legs: DataFrame) -> DataFrame:
    """pattern, i1, i2, kph, dist, code: the first call of each pattern that is reached too fast from one over FAR_KM before it, and the last such one.

    A speed over `top` means that distance less time at that speed is above 0, so an end can be judged by the least such value of all starts over FAR_KM before, a
    window in order of distance: one for starts at whole minutes, whose time counts a minute more if the end's is whole too, and one for
    all. What the sums' rounding leaves open, and the first sure end, are added up call by call from the end backwards."""
    whole = lambda c: c % 60 == 0
    speed = C("top") / 3600.0
    x = legs.withColumn("u", C("km") - speed * C("d")).withColumn("u_whole", F.when(whole(C("d")), C("u"))).withColumn("u_other", F.when(~whole(C("d")), C("u")))
    end = C("km") - speed * C("a")

    def over(km: float) -> Column:
        """How far the best of the starts over so many km before is above 0."""
        least = lambda u: F.expr(f"min({u}) over (partition by pattern order by km range between unbounded preceding and {km:.6f} preceding)")
        return F.greatest(end - F.when(whole(C("a")), least("u_other")).otherwise(least("u")), F.when(whole(C("a")), end - least("u_whole") - 60 * speed))

    # what may be and what is for sure, on either side of FAR_KM and of 0
    x = x.withColumns({"may": over(FAR_KM - ROUNDING), "is": over(FAR_KM + ROUNDING)})
    w = Window.partitionBy("pattern")
    x = x.withColumn("sure", F.min(F.when(C("is") > ROUNDING, C("i"))).over(w))
    open_ = (C("may") > -ROUNDING) & (C("i") <= F.coalesce("sure", "i"))
    x = x.withColumn("ends", F.collect_list(F.when(open_, F.struct("i", "a"))).over(w)).where("size(ends) > 0")
    x = x.select("pattern", "i", "d", "leg", "top", F.explode("ends").alias("end")).where("i <= end.i")
    back = Window.partitionBy("pattern", "end.i").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("dist", F.sum("leg").over(back)).withColumn("kph", speed_kph(C("dist"), C("d"), C("end.a"))).where((C("kph") > C("top")) & (C("dist") > FAR_KM))
    x = x.groupBy("pattern").agg(F.min_by(F.struct(C("i").alias("i1"), C("end.i").alias("i2"), "kph", "dist"), F.struct(C("end.i"), -C("i"))).alias("x"))
    return x.select("pattern", "x.*", F.lit("fast_travel_between_far_stops").alias("code"))


@rule("StopTimeTravelSpeedValidator", needs="stop_times trips routes stops", gated="stop_times trips routes stops")
def travel_speed(feed: Feed, options: RunOptions):
    # a call takes all that is said of it along: one shuffle by stop, one by trip, and nothing that is wide is joined after that
    routes = last_by(feed.df("routes"), "route_id", "route_type").withColumn("known", F.lit(True))
    trips = feed.df("trips").select("trip_id", "route_id", "_row").join(routes, "route_id", "left")
    trips = last_by(trips.withColumn("route", F.struct("route_id", "route_type", "known", C("_row").alias("trip_row"))), "trip_id", "route").where("route.known")
    stops = feed.df("stops").where(full(C("stop_id"))).groupBy("stop_id").agg(F.max_by("stop_name", "_row").alias("name"), F.max_by("stop_lat", "_row").alias("la"), F.max_by("stop_lon", "_row").alias("lo"))
    stops = stops.select("stop_id", "name", F.expr("(la is null or abs(la) <= 90) and (lo is null or abs(lo) <= 180)").alias("placed")).join(located(feed), "stop_id")
    st = feed.df("stop_times").where(full(C("trip_id"))).select("trip_id", "stop_sequence", "_row", "stop_id", C("arrival_time").alias("a"), C("departure_time").alias("d")).join(stops, "stop_id", "left")
    whole = st.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("stop_sequence", "_row", "stop_id", "a", "d", C("at.lat").alias("lat"), C("at.lon").alias("lon"), "name", "placed"))).alias("rows"))
    whole = whole.where("size(rows) > 1").join(trips, "trip_id")
    place = lambda c: [F.coalesce(C(f"{c}.{x}"), F.lit(0.0)) for x in ("lat", "lon")]
    top = max_speed(C("route.route_type")).alias("top")
    pairs = F.arrays_zip(F.slice("rows", 1, F.size("rows") - 1).alias("c1"), F.slice("rows", 2, F.size("rows") - 1).alias("c2"))
    near = whole.select("trip_id", "route", top, F.inline(pairs)).where("c1.d is not null and c2.a is not null")
    near = near.withColumn("dist", haversine(*place("c1"), *place("c2"), 6371.0)).withColumn("kph", speed_kph(C("dist"), C("c1.d"), C("c2.a"))).where("kph > top")
    near = near.select("trip_id", "route", "kph", "dist", "c1", "c2")
    # each trip by itself, without what is only told of its calls
    w = Window.partitionBy("pattern").orderBy("i")
    legs = whole.select(C("trip_id").alias("pattern"), top, F.posexplode("rows").alias("i", "c")).select("pattern", "top", "i", "c.a", "c.d", F.struct("c.lat", "c.lon").alias("at"))
    legs = legs.withColumn("q", F.lag("at").over(w)).withColumn("leg", F.when(C("q").isNull(), 0.0).otherwise(haversine(*place("q"), *place("at"), 6371.0))).drop("q", "at")
    legs = legs.withColumn("km", F.sum("leg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    far = far_stops(legs).withColumnRenamed("pattern", "trip_id").join(whole, "trip_id")
    far = far.select("trip_id", "route", "kph", "dist", F.element_at("rows", C("i1") + 1).alias("c1"), F.element_at("rows", C("i2") + 1).alias("c2"))
    # one plan for each code: a filter by code would not spare the other's
    told = lambda rows: rows.where("c1.placed and c2.placed").select("kph", "dist", "trip_id", "route.trip_row", "route.route_id", *[C(f"c{k}.{c}").alias(f"{n}{k}") for k, t in ((1, "d"), (2, "a")) for c, n in (("_row", "row"), ("stop_sequence", "seq"), ("stop_id", "stop"), ("name", "name"), (t, "t"))])
    context = {"tripCsvRowNumber": C("trip_row"), "tripId": C("trip_id"), "routeId": C("route_id"), "speedKph": C("kph"), "distanceKm": C("dist")}
    for k, t in ((1, "departureTime1"), (2, "arrivalTime2")):
        context |= {f"csvRowNumber{k}": C(f"row{k}"), f"stopSequence{k}": C(f"seq{k}"), f"stopId{k}": C(f"stop{k}"), f"stopName{k}": C(f"name{k}"), t: clock(C(f"t{k}"))}
    return [note(told(rows), f"fast_travel_between_{which}_stops", "WARNING", "trips", context, row="trip_row") for rows, which in ((near, "consecutive"), (far, "far"))]

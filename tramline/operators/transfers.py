"""Transfers between stops, routes and trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..feed import Feed, RunOptions, note
from ..functions.exprs import blank, full, haversine
from . import rule
from .rows import fields
from .stations import kind, last_by

C = F.col


@rule("TransfersValidator", needs="transfers", thorough=True)
def min_transfer_time(feed: Feed, options: RunOptions):
    return note(feed.df("transfers").where("transfer_type = 2 and min_transfer_time is null"), "missing_required_field", "ERROR", "transfers", at="min_transfer_time")


def sides(feed: Feed) -> DataFrame:
    """Two rows of each transfer: its from and its to side."""
    one = [F.struct(F.lit(s).alias("side"), C(f"{s}_stop_id").alias("stop_id"), C(f"{s}_route_id").alias("route_id"), C(f"{s}_trip_id").alias("trip_id")) for s in ("from", "to")]
    return feed.df("transfers").select("_row", "transfer_type", F.explode(F.array(*one)).alias("s")).select("_row", "transfer_type", "s.*")


def _name(what: str):
    return F.concat(C("side"), F.lit(f"_{what}_id"))


@rule("TransfersStopTypeValidator", needs="transfers stops")
def stop_type(feed: Feed, options: RunOptions):
    known = last_by(feed.df("stops").withColumn("k", kind()), "stop_id", "k")
    rows = sides(feed).join(known, "stop_id").where("k not in (0, 1)")
    return note(rows, "transfer_with_invalid_stop_location_type", "ERROR", "transfers", {"stopIdFieldName": _name("stop"), "stopId": C("stop_id"), "locationTypeValue": C("k")}, at=_name("stop"))


@rule("TransfersTripReferenceValidator", needs="transfers trips stops stop_times")
def trip_reference(feed: Feed, options: RunOptions):
    trips = last_by(feed.df("trips"), "trip_id", "route_id").withColumnRenamed("route_id", "own_route")
    s = sides(feed).where(full(C("trip_id"))).join(trips, "trip_id")
    wrong = s.where(full(C("route_id")) & (C("route_id") != C("own_route")))
    context = {"tripFieldName": _name("trip"), "tripId": C("trip_id"), "routeFieldName": _name("route"), "routeId": C("route_id"), "expectedRouteId": C("own_route")}
    stops = feed.df("stops").withColumn("k", kind())
    known = last_by(stops, "stop_id", "k").where("k in (0, 1)")
    children = stops.where(full(C("parent_station"))).select(C("parent_station").alias("stop_id"), C("stop_id").alias("at"))
    places = known.where("k = 0").select("stop_id", C("stop_id").alias("at")).unionByName(known.where("k = 1").join(children, "stop_id").select("stop_id", "at"))
    need = s.where(full(C("stop_id"))).join(known, "stop_id")
    visits = feed.df("stop_times").select("trip_id", C("stop_id").alias("at")).join(need.select("trip_id").distinct(), "trip_id", "left_semi").distinct()
    visited = need.select("_row", "side", "trip_id", "stop_id").join(places, "stop_id").join(visits, ["trip_id", "at"], "left_semi").select("_row", "side").distinct()
    lost = need.join(visited, ["_row", "side"], "left_anti")
    return [
        note(wrong, "transfer_with_invalid_trip_and_route", "ERROR", "transfers", context),
        note(lost, "transfer_with_invalid_trip_and_stop", "ERROR", "transfers", {"tripFieldName": _name("trip"), "tripId": C("trip_id"), "stopFieldName": _name("stop"), "stopId": C("stop_id")}),
    ]


@rule("TransferStopIdsConditionalValidator", needs="transfers")
def stop_ids(feed: Feed, options: RunOptions):
    t = feed.df("transfers").where(C("transfer_type").isNotNull() & ~C("transfer_type").isin(4, 5))
    return note(fields(t, {f: blank(C(f)) for f in ("from_stop_id", "to_stop_id")}), "missing_required_field", "ERROR", "transfers", at=C("f"))


@rule("TransfersInSeatTransferTypeValidator", needs="transfers stops stop_times")
def in_seat(feed: Feed, options: RunOptions):
    s = sides(feed).where(C("transfer_type").isin(4, 5))
    known = last_by(feed.df("stops").withColumn("k", kind()), "stop_id", "k")
    stations = s.join(known, "stop_id").where("k = 1")
    trips = s.where(full(C("trip_id"))).select("trip_id").distinct()
    st = feed.df("stop_times").join(trips, "trip_id", "left_semi")
    order = F.struct("stop_sequence", "_row")
    ends = st.groupBy("trip_id").agg(F.min_by("stop_id", order).alias("first"), F.max_by("stop_id", order).alias("last"))
    mid = s.where(full(C("stop_id"))).join(st.select("trip_id", "stop_id").distinct(), ["trip_id", "stop_id"]).join(ends, "trip_id")
    mid = mid.where((C("side") == "from") & (C("stop_id") != C("last")) | (C("side") == "to") & (C("stop_id") != C("first")))
    return [
        note(s.where(blank(C("trip_id"))), "missing_required_field", "ERROR", "transfers", at=_name("trip")),
        note(stations, "transfer_with_invalid_stop_location_type", "ERROR", "transfers", {"stopIdFieldName": _name("stop"), "stopId": C("stop_id"), "locationTypeValue": C("k")}, at=_name("stop")),
        note(mid, "transfer_with_suspicious_mid_trip_in_seat", "WARNING", "transfers", {"tripIdFieldName": _name("trip"), "tripId": C("trip_id"), "stopIdFieldName": _name("stop"), "stopId": C("stop_id")}),
    ]


def located(feed: Feed) -> DataFrame:
    """stop_id, at(lat, lon): a stop's own coordinates, else its parent's, else its parent's parent's. Pairs are whole."""
    point = F.when(C("stop_lat").isNotNull() & C("stop_lon").isNotNull(), F.struct(C("stop_lat").alias("lat"), C("stop_lon").alias("lon")))
    s = last_by(feed.df("stops").withColumn("at", point), "stop_id", "at", "parent_station")
    hop = lambda n: s.select(C("stop_id").alias(f"s{n}"), C("at").alias(f"a{n}"), C("parent_station").alias(f"p{n}"))
    return hop(0).join(hop(1), C("p0") == C("s1"), "left").join(hop(2), C("p1") == C("s2"), "left").select(C("s0").alias("stop_id"), F.coalesce("a0", "a1", "a2").alias("at"))


@rule("TransferDistanceValidator", needs="transfers stops")
def transfer_distance(feed: Feed, options: RunOptions):
    at = located(feed).where("at is not null")
    t = feed.df("transfers").join(at.select(C("stop_id").alias("from_stop_id"), C("at").alias("a")), "from_stop_id").join(at.select(C("stop_id").alias("to_stop_id"), C("at").alias("b")), "to_stop_id")
    t = t.withColumn("km", haversine(C("a.lat"), C("a.lon"), C("b.lat"), C("b.lon")) / 1000)
    context = {"fromStopId": C("from_stop_id"), "toStopId": C("to_stop_id"), "distanceKm": C("km")}
    return [note(t.where("km > 10"), "transfer_distance_too_large", "WARNING", "transfers", context), note(t.where("km > 2 and km <= 10"), "transfer_distance_above_2_km", "INFO", "transfers", context)]

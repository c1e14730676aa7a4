"""Stops, stations, levels and pathways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..feed import Feed, RunOptions, note
from ..functions.exprs import blank, full
from . import rule
from .paths import reach

C = F.col


def last_by(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per key: that of the last row which has it."""
    return df.where(full(C(key))).groupBy(key).agg(*[F.max_by(c, "_row").alias(c) for c in columns])


def kind() -> Column:
    return F.coalesce("location_type", F.lit(0))


@rule("LocationHasStopTimesValidator", needs="stops stop_times", gated="stops stop_times")
def location_has_stop_times(feed: Feed, options: RunOptions):
    st = feed.df("stop_times")
    direct = st.where(full(C("stop_id"))).groupBy(C("stop_id").alias("_s")).agg(F.min("_row").alias("_first"))
    groups = st.where(full(C("location_group_id"))).select("location_group_id").distinct()
    grouped = feed.df("location_group_stops").join(groups, "location_group_id", "left_semi").select(C("stop_id").alias("_s")).distinct()
    s = feed.df("stops").where(full(C("stop_id"))).withColumn("_k", kind())
    who = {"stopId": C("stop_id"), "stopName": C("stop_name")}
    idle = s.where("_k = 0").join(direct, C("stop_id") == C("_s"), "left_anti").join(grouped, C("stop_id") == C("_s"), "left_anti")
    odd = s.where("_k <> 0").join(direct, C("stop_id") == C("_s"))
    return [note(idle, "stop_without_stop_time", "WARNING", "stops", who), note(odd, "location_with_unexpected_stop_time", "ERROR", "stops", who | {"stopTimeCsvRowNumber": C("_first")})]


@rule("ParentStationValidator", needs="stops")
def parent_station(feed: Feed, options: RunOptions):
    s = feed.df("stops").withColumn("k", kind())
    p = last_by(s, "stop_id", "k", "_row", "stop_name").select(C("stop_id").alias("p_id"), C("k").alias("p_k"), C("_row").alias("p_row"), C("stop_name").alias("p_name"))
    want = F.when(C("k").isin(0, 2, 3), 1).when(C("k") == 4, 0)
    rows = s.where(full(C("parent_station"))).join(p, C("parent_station") == C("p_id")).withColumn("want", want).where("want is not null and p_k <> want")
    context = {"stopId": C("stop_id"), "stopName": C("stop_name"), "locationType": C("k"), "parentStation": C("parent_station"), "parentCsvRowNumber": C("p_row"), "parentStopName": C("p_name"), "parentLocationType": C("p_k"), "expectedLocationType": C("want")}
    used = s.where((C("k") == 0) & full(C("parent_station"))).select(C("parent_station").alias("_u")).distinct()
    idle = s.where((C("k") == 1) & full(C("stop_id"))).join(used, C("stop_id") == C("_u"), "left_anti")
    return [note(rows, "wrong_parent_location_type", "ERROR", "stops", context), note(idle, "unused_station", "INFO", "stops", {"stopId": C("stop_id"), "stopName": C("stop_name")})]


@rule("LocationTypeValidator", needs="stops")
def location_type(feed: Feed, options: RunOptions):
    s = feed.df("stops").withColumn("k", kind())
    who = {"stopId": C("stop_id"), "stopName": C("stop_name")}
    lone = blank(C("parent_station"))
    return [
        note(s.where((C("k") == 1) & ~lone), "station_with_parent_station", "ERROR", "stops", who | {"parentStation": C("parent_station")}),
        note(s.where(C("k").isin(2, 3, 4) & lone), "location_without_parent_station", "ERROR", "stops", who | {"locationType": C("k")}),
        note(s.where((C("k") == 0) & full(C("platform_code")) & lone), "platform_without_parent_station", "INFO", "stops", who),
    ]


@rule("StopZoneIdValidator", needs="stops fare_rules")
def stop_zone(feed: Feed, options: RunOptions):
    zoned = feed.df("fare_rules").where(full(C("origin_id")) | full(C("destination_id")) | full(C("contains_id")))
    routes = zoned.where(full(C("route_id"))).select("route_id").distinct()
    trips = feed.df("trips").join(routes, "route_id", "left_semi").select("trip_id").distinct()
    served = feed.df("stop_times").join(trips, "trip_id", "left_semi").select("stop_id").distinct()
    rows = feed.df("stops").where((kind() == 0) & blank(C("zone_id"))).join(served, "stop_id", "left_semi")
    return note(rows, "stop_without_zone_id", "INFO", "stops", {"stopId": C("stop_id"), "stopName": C("stop_name")})


def _ends(feed: Feed) -> DataFrame:
    p = feed.df("pathways")
    return p.select(C("from_stop_id").alias("id")).unionByName(p.select(C("to_stop_id").alias("id"))).where(full(C("id"))).distinct()


@rule("MissingLevelIdValidator", needs="levels pathways stops", thorough=True)
def missing_level(feed: Feed, options: RunOptions):
    rows = feed.df("stops").where(blank(C("level_id"))).join(_ends(feed), C("stop_id") == C("id"), "left_semi")
    return note(rows, "missing_level_id", "ERROR", "stops", {"stopId": C("stop_id"), "stopName": C("stop_name")})


@rule("PathwaysValidator", needs="pathways")
def pathways(feed: Feed, options: RunOptions):
    p = feed.df("pathways")
    out = [note(p.where("traversal_time = 0"), "number_out_of_range", "ERROR", "pathways", {"fieldValue": C("traversal_time"), "entityId": C("pathway_id")}, at="traversal_time")]
    if options.thorough:
        out.append(note(p.where("length is null and pathway_mode <> 7"), "missing_recommended_field", "WARNING", "pathways", at="length"))
        out.append(note(p.where("pathway_mode = 2 and stair_count is null"), "missing_recommended_field", "WARNING", "pathways", at="stair_count"))
    return out


@rule("BidirectionalExitGateValidator", needs="pathways")
def exit_gate(feed: Feed, options: RunOptions):
    return note(feed.df("pathways").where("pathway_mode = 7 and is_bidirectional = 1"), "bidirectional_exit_gate", "ERROR", "pathways", {"pathwayMode": C("pathway_mode"), "isBidirectional": C("is_bidirectional")})


@rule("PathwayLoopValidator", needs="pathways")
def pathway_loop(feed: Feed, options: RunOptions):
    return note(feed.df("pathways").where(full(C("from_stop_id")) & (C("from_stop_id") == C("to_stop_id"))), "pathway_loop", "WARNING", "pathways", {"pathwayId": C("pathway_id"), "stopId": C("from_stop_id")})


@rule("PathwayEndpointTypeValidator", needs="pathways stops")
def endpoint_type(feed: Feed, options: RunOptions):
    s = feed.df("stops").withColumn("k", kind())
    known = last_by(s, "stop_id", "k")
    parents = s.where(full(C("parent_station"))).select(C("parent_station").alias("_p")).distinct().withColumn("has_child", F.lit(True))
    sides = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), C(f).alias("id")) for f in ("from_stop_id", "to_stop_id")]))
    e = feed.df("pathways").select("_row", "pathway_id", sides.alias("e")).select("_row", "pathway_id", "e.f", "e.id").join(known, C("id") == C("stop_id"))
    e = e.join(parents, C("id") == C("_p"), "left")
    context = {"pathwayId": C("pathway_id"), "fieldName": C("f"), "stopId": C("id")}
    return [
        note(e.where("k = 0 and has_child"), "pathway_to_platform_with_boarding_areas", "ERROR", "pathways", context, at=C("f")),
        note(e.where("k = 1"), "pathway_to_wrong_location_type", "ERROR", "pathways", context, at=C("f")),
    ]


@rule("PathwayDanglingGenericNodeValidator", needs="pathways stops")
def dangling(feed: Feed, options: RunOptions):
    p = feed.df("pathways").where(full(C("from_stop_id")) & full(C("to_stop_id")))
    near = p.select(C("from_stop_id").alias("id"), C("to_stop_id").alias("other")).unionByName(p.select(C("to_stop_id").alias("id"), C("from_stop_id").alias("other")))
    one = near.groupBy("id").agg(F.countDistinct("other").alias("n")).where("n = 1")
    rows = feed.df("stops").where("location_type = 3").join(one, C("stop_id") == C("id"), "left_semi")
    return note(rows, "pathway_dangling_generic_node", "WARNING", "stops", {"stopId": C("stop_id"), "stopName": C("stop_name"), "parentStation": C("parent_station")})


@rule("PathwayReachableLocationValidator", needs="pathways stops")
def unreachable(feed: Feed, options: RunOptions):
    s = feed.df("stops").withColumn("k", kind())
    p = feed.df("pathways").where(full(C("from_stop_id")) & full(C("to_stop_id")))
    ahead = p.select(C("from_stop_id").alias("src"), C("to_stop_id").alias("dst"))
    both = p.where("is_bidirectional = 1").select(C("to_stop_id").alias("src"), C("from_stop_id").alias("dst"))
    edges = ahead.unionByName(both)
    doors = s.where((C("k") == 2) & full(C("stop_id"))).select(C("stop_id").alias("id"))
    # both searches in one: the way in along the edges, the way out against them
    ways = edges.withColumn("way", F.lit("in")).unionByName(edges.select(C("dst").alias("src"), C("src").alias("dst"), F.lit("out").alias("way")))
    found = reach(doors.withColumn("way", F.explode(F.array(F.lit("in"), F.lit("out")))), ways, "way")
    found = found.groupBy("id").agg(F.max(C("way") == "in").alias("enter"), F.max(C("way") == "out").alias("leave"))
    # the station of a location: itself, its parent or its parent's parent
    up = last_by(s, "stop_id", "k", "parent_station")
    hop = lambda n: up.select(C("stop_id").alias(f"s{n}"), C("k").alias(f"k{n}"), C("parent_station").alias(f"p{n}"))
    home = hop(0).join(hop(1), C("p0") == C("s1"), "left").join(hop(2), C("p1") == C("s2"), "left")
    home = home.select(C("s0").alias("id"), F.when(C("k0") == 1, C("s0")).when(C("k1") == 1, C("s1")).when(C("k2") == 1, C("s2")).alias("station")).where("station is not null")
    with_paths = home.join(_ends(feed), "id", "left_semi").select("station").distinct()
    children = s.where(full(C("parent_station"))).select(C("parent_station").alias("id")).distinct()
    childless = s.where("k = 0").join(children, C("stop_id") == C("id"), "left_anti")
    locations = s.where("k in (3, 4)").unionByName(childless)
    rows = locations.join(home, C("stop_id") == C("id")).drop("id").join(with_paths, "station", "left_semi")
    rows = rows.join(found, C("stop_id") == C("id"), "left").drop("id")
    rows = rows.withColumn("enter", F.coalesce("enter", F.lit(False))).withColumn("leave", F.coalesce("leave", F.lit(False))).where("not (enter and leave)")
    context = {"stopId": C("stop_id"), "stopName": C("stop_name"), "locationType": C("k"), "parentStation": C("parent_station"), "hasEntrance": C("enter"), "hasExit": C("leave")}
    return note(rows, "pathway_unreachable_location", "ERROR", "stops", context)


@rule("UnusedStopValidator", needs="stops", thorough=True)
def unused_stop(feed: Feed, options: RunOptions):
    s = feed.df("stops")
    served = feed.df("stop_times").where(full(C("stop_id"))).select(C("stop_id").alias("id")).distinct()
    up = last_by(s, "stop_id", "parent_station").where(full(C("parent_station"))).select(C("stop_id").alias("src"), C("parent_station").alias("dst"))
    rows = s.where(full(C("stop_id"))).join(reach(served, up), C("stop_id") == C("id"), "left_anti")
    return note(rows, "unused_stop", "WARNING", "stops", {"stopId": C("stop_id"), "stopName": C("stop_name")})

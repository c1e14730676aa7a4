"""Checks of single rows, and of rows against a few facts of another table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..feed import Feed, RunOptions, note
from ..functions.exprs import blank, clock, full, luma
from ..functions.urls import valid_url
from . import rule

C = F.col


def one_row(df: DataFrame) -> DataFrame:
    """A one-row table to join by `_one`."""
    return df.withColumn("_one", F.lit(1))


def with_one(df: DataFrame, single: DataFrame) -> DataFrame:
    """df with the columns of a one-row table."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row(single)), "_one").drop("_one")


def fields(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A row for each field whose check fails, named `f`."""
    return df.withColumn("f", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(f)) for f, bad in checks.items()]))))


@rule("AgencyConsistencyValidator", needs="agency")
def agency_consistency(feed: Feed, options: RunOptions):
    a = feed.df("agency")
    lang = F.lower(F.trim("agency_lang"))
    facts = a.groupBy().agg(F.count("*").alias("n"), F.min_by("agency_timezone", "_row").alias("tz"), F.min_by(F.when(full(C("agency_lang")), lang), F.when(full(C("agency_lang")), C("_row"))).alias("lang"))
    rows = with_one(a, facts)
    nameless = blank(C("agency_id"))
    many = rows.where("n > 1")
    return [
        note(rows.where((C("n") == 1) & nameless), "missing_recommended_field", "WARNING", "agency", at="agency_id"),
        note(many.where(nameless), "missing_required_field", "ERROR", "agency", at="agency_id"),
        note(many.where(~C("agency_timezone").eqNullSafe(C("tz"))), "inconsistent_agency_timezone", "ERROR", "agency", {"expected": C("tz"), "actual": C("agency_timezone")}),
        note(many.where(full(C("agency_lang")) & (lang != C("lang"))), "inconsistent_agency_lang", "WARNING", "agency", {"expected": C("lang"), "actual": lang}),
    ]


@rule("TimepointTimeValidator", needs="stop_times")
def timepoint(feed: Feed, options: RunOptions):
    if not feed.header("stop_times", "timepoint"):
        return None
    st = feed.df("stop_times")
    context = {"tripId": C("trip_id"), "stopSequence": C("stop_sequence")}
    lacking = fields(st.where("timepoint = 1"), {"arrival_time": C("arrival_time").isNull(), "departure_time": C("departure_time").isNull()})
    return [
        note(st.where(C("timepoint").isNull() & (C("arrival_time").isNotNull() | C("departure_time").isNotNull())), "missing_timepoint_value", "WARNING", "stop_times", context),
        note(lacking, "stop_time_timepoint_without_times", "ERROR", "stop_times", context | {"specifiedField": C("f")}, at=C("f")),
    ]


def _windows(st: DataFrame) -> tuple[Column, Column, dict]:
    a, b = C("start_pickup_drop_off_window"), C("end_pickup_drop_off_window")
    return a, b, {"startPickupDropOffWindow": clock(a), "endPickupDropOffWindow": clock(b)}


@rule("PickupDropOffTypeValidator", needs="stop_times")
def pickup_drop_off_type(feed: Feed, options: RunOptions):
    if not feed.header("stop_times", "start_pickup_drop_off_window") and not feed.header("stop_times", "end_pickup_drop_off_window"):
        return None
    st = feed.df("stop_times")
    a, b, context = _windows(st)
    st = st.where(a.isNotNull() | b.isNotNull())
    return [
        note(st.where(F.coalesce("pickup_type", F.lit(0)).isin(0, 3)), "forbidden_pickup_type", "ERROR", "stop_times", context),
        note(st.where(F.coalesce("drop_off_type", F.lit(0)) == 0), "forbidden_drop_off_type", "ERROR", "stop_times", context),
    ]


@rule("PickupDropOffWindowValidator", needs="stop_times")
def pickup_drop_off_window(feed: Feed, options: RunOptions):
    st = feed.df("stop_times")
    a, b, context = _windows(st)
    timed = C("arrival_time").isNotNull() | C("departure_time").isNotNull()
    return [
        note(st.where((a.isNotNull() | b.isNotNull()) & timed), "forbidden_arrival_or_departure_time", "ERROR", "stop_times", context | {"arrivalTime": clock(C("arrival_time")), "departureTime": clock(C("departure_time"))}),
        note(st.where(a.isNotNull() != b.isNotNull()), "missing_pickup_or_drop_off_window", "ERROR", "stop_times", context),
        note(st.where(a >= b), "invalid_pickup_drop_off_window", "ERROR", "stop_times", context),
    ]


@rule("StopTimesGeographyIdPresenceValidator", needs="stop_times")
def geography_presence(feed: Feed, options: RunOptions):
    ids = ("stop_id", "location_group_id", "location_id")
    n = sum((full(C(c)).cast("int") for c in ids), F.lit(0))
    st = feed.df("stop_times").withColumn("_n", n)
    return [
        note(st.where("_n = 0"), "missing_required_field", "ERROR", "stop_times", at="stop_id"),
        note(st.where("_n > 1"), "forbidden_geography_id", "ERROR", "stop_times", {"stopId": C("stop_id"), "locationGroupId": C("location_group_id"), "locationId": C("location_id")}),
    ]


def _points(df: DataFrame, table: str, lat: str, lon: str, entity: str) -> list[DataFrame]:
    y, x = C(lat), C(lon)
    pair = {"latFieldName": lat, "latFieldValue": y, "lonFieldName": lon, "lonFieldValue": x, "entityId": C(entity)}
    bounds = [note(df.where((C(f) < -m) | (C(f) > m)), "number_out_of_range", "ERROR", table, {"fieldValue": C(f), "entityId": C(entity)}, at=f) for f, m in ((lat, 90.0), (lon, 180.0))]
    return [*bounds, note(df.where((F.abs(y) <= 1) & (F.abs(x) <= 1)), "point_near_origin", "ERROR", table, pair), note(df.where((F.abs(y) >= 89) & x.isNotNull()), "point_near_pole", "ERROR", table, pair)]


@rule("StopLatLonValidator", needs="stops", gated="stops")
def stop_lat_lon(feed: Feed, options: RunOptions):
    return _points(feed.df("stops"), "stops", "stop_lat", "stop_lon", "stop_id")


@rule("ShapeLatLonValidator", needs="shapes", gated="shapes")
def shape_lat_lon(feed: Feed, options: RunOptions):
    return _points(feed.df("shapes"), "shapes", "shape_pt_lat", "shape_pt_lon", "shape_id")


@rule("StopTimesShapeDistTraveledPresenceValidator", needs="stop_times", thorough=True)
def shape_dist_presence(feed: Feed, options: RunOptions):
    if not feed.header("stop_times", "shape_dist_traveled"):
        return None
    a, b = C("start_pickup_drop_off_window"), C("end_pickup_drop_off_window")
    elsewhere = blank(C("stop_id")) & (full(C("location_group_id")) | full(C("location_id")))
    st = feed.df("stop_times").where(C("shape_dist_traveled").isNotNull() & (a.isNotNull() | b.isNotNull() | elsewhere))
    context = {"tripId": C("trip_id"), "locationGroupId": C("location_group_id"), "locationId": C("location_id"), "shapeDistTraveled": C("shape_dist_traveled")}
    return note(st, "forbidden_shape_dist_traveled", "ERROR", "stop_times", context, at="shape_dist_traveled")


@rule("StopsValidator", needs="stops")
def stops(feed: Feed, options: RunOptions):
    s = feed.df("stops")
    plain = F.coalesce("location_type", F.lit(0)).isin(0, 1, 2)
    context = {"stopId": C("stop_id"), "locationType": F.coalesce("location_type", F.lit(0))}
    return [
        note(s.where(plain & blank(C("stop_name"))), "missing_stop_name", "ERROR", "stops", context),
        note(s.where(plain & (C("stop_lat").isNull() | C("stop_lon").isNull())), "stop_without_location", "ERROR", "stops", context),
        note(s.where(full(C("stop_name")) & (F.lower("stop_desc") == F.lower("stop_name"))), "same_name_and_description_for_stop", "WARNING", "stops", {"stopId": C("stop_id"), "stopDesc": C("stop_desc")}),
    ]


@rule("PickupBookingRuleIdValidator", needs="stop_times booking_rules")
def booking_rule_id(feed: Feed, options: RunOptions):
    st = feed.df("stop_times")
    context = {"pickupType": C("pickup_type"), "dropOffType": C("drop_off_type")}
    out = []
    for window, kind, ref in (("start_pickup_drop_off_window", "pickup_type", "pickup_booking_rule_id"), ("end_pickup_drop_off_window", "drop_off_type", "drop_off_booking_rule_id")):
        if feed.header("stop_times", window, kind):
            out.append(note(st.where(C(window).isNotNull() & (C(kind) == 2) & blank(C(ref))), "missing_pickup_drop_off_booking_rule_id", "WARNING", "stop_times", context, at=ref))
    return out


@rule("ContinuousPickupDropOffValidator", needs="routes trips stop_times")
def continuous(feed: Feed, options: RunOptions):
    if not (feed.header("routes", "continuous_pickup") or feed.header("routes", "continuous_drop_off")):
        return None
    a, b, context = _windows(feed.df("stop_times"))
    r = feed.df("routes").where(C("continuous_pickup").isin(0, 2, 3) | C("continuous_drop_off").isin(0, 2, 3)).select("route_id", C("_row").alias("r"))
    t = feed.df("trips").select("route_id", "trip_id").distinct()
    st = feed.df("stop_times").where(a.isNotNull() | b.isNotNull()).join(t, "trip_id").join(r, "route_id")
    return note(st, "forbidden_continuous_pickup_drop_off", "ERROR", "routes", context | {"routeCsvRowNumber": C("r"), "stopTimeCsvRowNumber": C("_row"), "tripId": C("trip_id")}, row="r")


@rule("RoutesValidator", needs="routes")
def routes(feed: Feed, options: RunOptions):
    r = feed.df("routes")
    short, long, desc = F.trim(F.coalesce("route_short_name", F.lit(""))), F.trim(F.coalesce("route_long_name", F.lit(""))), F.trim(F.coalesce("route_desc", F.lit("")))
    r = r.withColumn("s", short).withColumn("l", long).withColumn("d", desc)
    named = r.where("s <> '' or l <> ''")
    inside = (C("s") != "") & F.startswith(F.lower("l"), F.lower("s")) & F.substring(C("l"), F.length("s") + 1, F.lit(1)).rlike(r"^[\s\-(]?$")
    same_short = (C("d") != "") & (C("s") != "") & (F.lower("d") == F.lower("s"))
    same_long = (C("d") != "") & (C("l") != "") & (F.lower("d") == F.lower("l")) & ~same_short
    desc = {"routeId": C("route_id"), "routeDesc": C("route_desc")}
    return [
        note(r.where("s = '' and l = ''"), "route_both_short_and_long_name_missing", "ERROR", "routes", {"routeId": C("route_id")}),
        note(named.where("char_length(s) > 12"), "route_short_name_too_long", "WARNING", "routes", {"routeId": C("route_id"), "routeShortName": C("s")}, at="route_short_name"),
        note(named.where(inside), "route_long_name_contains_short_name", "WARNING", "routes", {"routeId": C("route_id"), "routeShortName": C("s"), "routeLongName": C("l")}),
        note(named.where(same_short), "same_name_and_description_for_route", "WARNING", "routes", desc | {"specifiedField": "route_short_name"}),
        note(named.where(same_long), "same_name_and_description_for_route", "WARNING", "routes", desc | {"specifiedField": "route_long_name"}),
    ]


@rule("BikesAllowanceValidator", needs="routes trips")
def bikes(feed: Feed, options: RunOptions):
    if not feed.header("trips", "bikes_allowed", exact=True):
        return None
    ferries = feed.df("routes").where("route_type = 4").select("route_id").distinct()
    t = feed.df("trips").join(ferries, "route_id", "left_semi").where(~F.coalesce("bikes_allowed", F.lit(0)).isin(1, 2))
    return note(t, "missing_bike_allowance", "WARNING", "trips", {"routeId": C("route_id"), "tripId": C("trip_id")})


def _agency_id(feed: Feed, table: str) -> list[DataFrame]:
    rows = with_one(feed.df(table).where(blank(C("agency_id"))), feed.df("agency").groupBy().agg(F.count("*").alias("n")))
    return [note(rows.where("n > 1"), "missing_required_field", "ERROR", table, at="agency_id"), note(rows.where("n = 1"), "missing_recommended_field", "WARNING", table, at="agency_id")]


@rule("RouteAgencyIdValidator", needs="routes")
def route_agency_id(feed: Feed, options: RunOptions):
    return _agency_id(feed, "routes")


@rule("FareAttributeAgencyIdValidator", needs="fare_attributes", gated="fare_attributes agency")
def fare_agency_id(feed: Feed, options: RunOptions):
    return _agency_id(feed, "fare_attributes")


@rule("MatchingFeedAndAgencyLangValidator", needs="feed_info agency")
def matching_lang(feed: Feed, options: RunOptions):
    first = feed.df("feed_info").groupBy().agg(F.lower(F.trim(F.min_by("feed_lang", "_row"))).alias("lang"))
    lang = F.lower(F.trim("agency_lang"))
    rows = with_one(feed.df("agency"), first).where(full(C("lang")) & (C("lang") != "mul") & full(C("agency_lang")) & (lang != C("lang")))
    context = {"agencyId": C("agency_id"), "agencyName": C("agency_name"), "agencyLang": lang, "feedLang": C("lang")}
    return note(rows, "feed_info_lang_and_agency_lang_mismatch", "WARNING", "feed_info", context, row=F.lit(2))


@rule("UrlConsistencyValidator", needs="agency routes stops", gated="agency routes stops")
def url_consistency(feed: Feed, options: RunOptions):
    url = lambda c: F.lower(F.trim(c))
    a = feed.df("agency").where(full(C("agency_url"))).select(url("agency_url").alias("u"), "agency_name", C("_row").alias("ar"))
    r = feed.df("routes").where(full(C("route_url"))).select(url("route_url").alias("u"), "route_id", "route_url", C("_row").alias("rr"))
    s = feed.df("stops").where(full(C("stop_url"))).select(url("stop_url").alias("u"), "stop_id", "stop_url", C("_row").alias("sr"))
    return [
        note(r.join(a, "u"), "same_route_and_agency_url", "WARNING", "routes", {"routeCsvRowNumber": C("rr"), "routeId": C("route_id"), "agencyName": C("agency_name"), "routeUrl": C("route_url"), "agencyCsvRowNumber": C("ar")}, row="rr"),
        note(s.join(a, "u"), "same_stop_and_agency_url", "WARNING", "stops", {"stopCsvRowNumber": C("sr"), "stopId": C("stop_id"), "agencyName": C("agency_name"), "stopUrl": C("stop_url"), "agencyCsvRowNumber": C("ar")}, row="sr"),
        note(s.join(r, "u"), "same_stop_and_route_url", "WARNING", "stops", {"stopCsvRowNumber": C("sr"), "stopId": C("stop_id"), "stopUrl": C("stop_url"), "routeId": C("route_id"), "routeCsvRowNumber": C("rr")}, row="sr"),
    ]


@rule("RouteColorContrastValidator", needs="routes")
def color_contrast(feed: Feed, options: RunOptions):
    low = F.abs(luma(C("route_color")) - luma(C("route_text_color"))) < 72
    hexed = lambda c: F.lpad(F.hex(c), 6, "0")
    return note(feed.df("routes").where(low), "route_color_contrast", "WARNING", "routes", {"routeId": C("route_id"), "routeColor": hexed("route_color"), "routeTextColor": hexed("route_text_color")})


@rule("FrequenciesValidator", needs="frequencies")
def frequencies(feed: Feed, options: RunOptions):
    f = feed.df("frequencies")
    names = {"startFieldName": "start_time", "endFieldName": "end_time", "entityId": C("trip_id")}
    return [
        note(f.where("start_time > end_time"), "start_and_end_range_out_of_order", "ERROR", "frequencies", names | {"startValue": clock(C("start_time")), "endValue": clock(C("end_time"))}),
        note(f.where("start_time = end_time"), "start_and_end_range_equal", "ERROR", "frequencies", names | {"value": clock(C("start_time"))}),
    ]


@rule("FareAttributesValidator", needs="fare_attributes")
def fare_attributes(feed: Feed, options: RunOptions):
    return note(feed.df("fare_attributes").where("price < 0"), "number_out_of_range", "ERROR", "fare_attributes", {"fieldValue": C("price"), "entityId": C("fare_id")}, at="price")


@rule("FareMediaNameValidator", needs="fare_media")
def fare_media_name(feed: Feed, options: RunOptions):
    return note(feed.df("fare_media").where(C("fare_media_type").isin(2, 4) & blank(C("fare_media_name"))), "missing_recommended_field", "WARNING", "fare_media", at="fare_media_name")


@rule("FareTransferRuleDurationLimitTypeValidator", needs="fare_transfer_rules")
def duration_limit(feed: Feed, options: RunOptions):
    f = feed.df("fare_transfer_rules")
    out = [note(f.where((C("duration_limit") >= 0) & C("duration_limit_type").isNull()), "fare_transfer_rule_duration_limit_without_type", "ERROR", "fare_transfer_rules")]
    if options.thorough:
        out.append(note(f.where(C("duration_limit").isNull() & C("duration_limit_type").isNotNull()), "fare_transfer_rule_duration_limit_type_without_duration_limit", "ERROR", "fare_transfer_rules"))
    return out


@rule("FareTransferRuleTransferCountValidator", needs="fare_transfer_rules")
def transfer_count(feed: Feed, options: RunOptions):
    same = full(C("from_leg_group_id")) & F.coalesce(C("from_leg_group_id") == C("to_leg_group_id"), F.lit(False))
    f, n = feed.df("fare_transfer_rules"), C("transfer_count")
    return [
        note(f.where(same & ((n < -1) | (n == 0))), "fare_transfer_rule_invalid_transfer_count", "ERROR", "fare_transfer_rules", {"transferCount": n}),
        note(f.where(same & n.isNull()), "fare_transfer_rule_missing_transfer_count", "ERROR", "fare_transfer_rules"),
        note(f.where(~same & n.isNotNull()), "fare_transfer_rule_with_forbidden_transfer_count", "ERROR", "fare_transfer_rules"),
    ]


@rule("TimeframeStartAndEndTimeValidator", needs="timeframes")
def timeframe_times(feed: Feed, options: RunOptions):
    t = feed.df("timeframes")
    over = fields(t, {"start_time": C("start_time") > 86400, "end_time": C("end_time") > 86400})
    return [
        note(t.where(C("start_time").isNull() != C("end_time").isNull()), "timeframe_only_start_or_end_time_specified", "ERROR", "timeframes"),
        note(over, "timeframe_start_or_end_time_greater_than_twenty_four_hours", "ERROR", "timeframes", {"time": clock(F.when(C("f") == "start_time", C("start_time")).otherwise(C("end_time")))}, at=C("f")),
    ]


@rule("FeedInfoValidator", needs="feed_info")
def feed_info(feed: Feed, options: RunOptions):
    f = feed.df("feed_info")
    out = [note(f.groupBy().agg(F.count("*").alias("n")).where("n > 1"), "more_than_one_entity", "WARNING", "feed_info", {"entityCount": C("n")}, row=None)]
    out += [note(f, "missing_recommended_field", "WARNING", "feed_info", at=c) for c in ("feed_start_date", "feed_end_date", "feed_version") if not feed.header("feed_info", c)]
    day = lambda c: F.date_format(c, "yyyyMMdd")
    context = {"startFieldName": "feed_start_date", "endFieldName": "feed_end_date", "startValue": day("feed_start_date"), "endValue": day("feed_end_date")}
    return [*out, note(f.where("feed_start_date > feed_end_date"), "start_and_end_range_out_of_order", "ERROR", "feed_info", context)]


@rule("FeedServiceDateValidator", needs="feed_info")
def feed_service_date(feed: Feed, options: RunOptions):
    a, b = C("feed_start_date"), C("feed_end_date")
    return note(fields(feed.df("feed_info"), {"feed_start_date": a.isNull() & b.isNotNull(), "feed_end_date": a.isNotNull() & b.isNull()}), "missing_feed_info_date", "WARNING", "feed_info", at=C("f"))


@rule("FeedExpirationDateValidator", needs="feed_info")
def feed_expiration(feed: Feed, options: RunOptions):
    f, today, end = feed.df("feed_info"), F.lit(options.date), C("feed_end_date")
    day = lambda c: F.date_format(c, "yyyyMMdd")
    context = lambda n: {"currentDate": day(today), "feedEndDate": day(end), "suggestedExpirationDate": day(F.date_add(today, n))}
    return [
        note(f.where(end <= F.date_add(today, 7)), "feed_expiration_date7_days", "WARNING", "feed_info", context(7)),
        note(f.where((end > F.date_add(today, 7)) & (end <= F.date_add(today, 30))), "feed_expiration_date30_days", "WARNING", "feed_info", context(30)),
    ]


@rule("FeedContactValidator", needs="feed_info")
def feed_contact(feed: Feed, options: RunOptions):
    return note(feed.df("feed_info").where(blank(C("feed_contact_email")) & blank(C("feed_contact_url"))), "missing_feed_contact_email_and_url", "WARNING", "feed_info")


@rule("AttributionWithoutRoleValidator", needs="attributions")
def attribution_role(feed: Feed, options: RunOptions):
    roles = ("is_producer", "is_operator", "is_authority")
    if any(feed.header("attributions", r) for r in roles):
        none = ~F.array_contains(F.array(*[F.coalesce(r, F.lit(0)) for r in roles]), 1)
        return note(feed.df("attributions").where(none), "attribution_without_role", "WARNING", "attributions", {"attributionId": C("attribution_id")})


@rule("UrlSyntaxValidator", thorough=True)
def url_syntax(feed: Feed, options: RunOptions):
    fields_ = {"agency": ("agency_url", "agency_fare_url"), "stops": ("stop_url",), "routes": ("route_url",), "feed_info": ("feed_publisher_url", "feed_contact_url")}
    out = []
    for table, names in fields_.items():
        for f in names:
            if feed.has(table):
                value = F.trim(f)
                # what lacks a scheme alone
                lacks = ~F.contains(value, F.lit("://")) & F.contains(value, F.lit(".")) & valid_url(F.concat(F.lit("https://"), value))
                fix = F.when(lacks, F.concat(F.lit("https://"), value))
                out.append(note(feed.df(table).where(full(C(f)) & ~valid_url(value)), "u_r_i_syntax_error", "ERROR", table, {"fieldValue": C(f), "fix": fix}, at=f))
    return out


# Fields that each booking type forbids.
_FORBIDDEN = {
    0: ("forbidden_real_time_booking_field_value", "prior_notice_duration_min prior_notice_duration_max prior_notice_last_day prior_notice_last_time prior_notice_start_day prior_notice_start_time prior_notice_service_id"),
    1: ("forbidden_same_day_booking_field_value", "prior_notice_last_day prior_notice_last_time prior_notice_service_id"),
    2: ("forbidden_prior_day_booking_field_value", "prior_notice_duration_min prior_notice_duration_max"),
}


@rule("BookingRulesEntityValidator", needs="booking_rules")
def booking_rules(feed: Feed, options: RunOptions):
    b = feed.df("booking_rules")
    kind, who = C("booking_type"), {"bookingRuleId": C("booking_rule_id")}
    low, high, start, last = (C(f"prior_notice_{x}") for x in ("duration_min", "duration_max", "start_day", "last_day"))
    start_time, last_time = C("prior_notice_start_time"), C("prior_notice_last_time")
    out = []
    for k, (code, names) in _FORBIDDEN.items():
        found = F.array_compact(F.array(*[F.when(full(C(n).cast("string")), F.lit(n)) for n in names.split()]))
        out.append(note(b.where((kind == k) & (F.size(found) > 0)), code, "ERROR", "booking_rules", who | {"fieldNames": F.array_join(found, ",")}))
    put = lambda where, code, context: out.append(note(b.where(where), code, "ERROR", "booking_rules", context))
    put((kind == 1) & low.isNull(), "missing_prior_notice_duration_min", who)
    put(high < low, "invalid_prior_notice_duration_min", who | {"priorNoticeDurationMin": low, "priorNoticeDurationMax": high})
    put(high.isNotNull() & start.isNotNull(), "forbidden_prior_notice_start_day", who | {"priorNoticeDurationMax": high, "priorNoticeStartDay": start})
    put(last > start, "prior_notice_last_day_after_start_day", {"priorNoticeLastDay": last, "priorNoticeStartDay": start})
    put((kind == 2) & last.isNull(), "missing_prior_notice_last_day", who)
    put((kind == 2) & last_time.isNull(), "missing_prior_notice_last_time", who)
    put(start_time.isNotNull() & start.isNull(), "forbidden_prior_notice_start_time", who | {"priorNoticeStartTime": clock(start_time)})
    put(start_time.isNull() & start.isNotNull(), "missing_prior_notice_start_time", who | {"priorNoticeStartDay": start})
    return out


def _google(name: str, table: str, where, code: str, severity: str, field: str) -> None:
    @rule(name, needs=table, google=True)
    def check(feed: Feed, options: RunOptions):
        return note(feed.df(table).where(where()), code, severity, table, at=field)


_google("GoogleTransferTypeValidator", "transfers", lambda: C("transfer_type").isin(4, 5), "google_transfer_type_check", "WARNING", "transfer_type")
_google("GoogleFareAttributesValidator", "fare_attributes", lambda: (C("ic_price") != -1) & (C("ic_price") < 0), "google_ic_price_check", "ERROR", "ic_price")
_google("AgencyPhoneValidator", "agency", lambda: full(C("agency_phone")) & (F.length(F.regexp_replace("agency_phone", "[^0-9]", "")) < 5), "agency_phone_invalid", "WARNING", "agency_phone")
_google("RouteShortNameLengthValidator", "routes", lambda: F.octet_length(F.trim("route_short_name")) > 6, "route_short_name_too_long", "WARNING", "route_short_name")
_google("StopHeadsignFormatValidator", "stop_times", lambda: C("stop_headsign").rlike(r"[!$%\\*=_]"), "stop_headsign_invalid_char", "WARNING", "stop_headsign")
_google("HeadwayReasonablenessValidator", "frequencies", lambda: C("headway_secs") > 3600, "headway_too_large", "WARNING", "headway_secs")

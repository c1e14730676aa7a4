"""One query for each rule over the projected feed, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, synth
from .operators import all_rules
from .plans.runner import run_rule

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def row(code: str, table: str, where: str = "TRUE", field: str = "NULL", **context: str) -> str:
    """SELECT of notices: context values are SQL expressions."""
    more = "".join(f", CAST({v} AS VARCHAR) AS {k}" for k, v in context.items())
    return f"SELECT '{code}' AS code, CAST(_row AS BIGINT) AS csv_row, CAST({field} AS VARCHAR) AS field{more} FROM {table} WHERE {where}"


def each(code: str, table: str, checks: dict[str, str], **context: str) -> list[str]:
    return [row(code, table, where, f"'{f}'", **context) for f, where in checks.items()]


def add(name: str, rule: str, keys: str, *sql: str | list[str] | None, bare: bool = False) -> None:
    """keys: the context values that the query shows, as text. bare: over the feed that lacks files."""
    shown = keys.split()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = run_rule(synth.feed(spark, sf_dir, bare), all_rules()[rule], synth.OPTIONS)
        return found.select("code", "csv_row", "field", *[F.col(k) if k == "filename" else F.col("context")[k].alias(k) for k in shown])

    QUERIES[name] = query
    parts = [x for s in sql if s for x in ([s] if isinstance(s, str) else s)]
    if parts:
        columns = ", ".join(["code", "csv_row", "field", *shown])
        ORACLE_SQL[name] = synth.with_views(f"SELECT {columns} FROM (" + "\nUNION ALL BY NAME ".join(parts) + ") n", bare)


def of_catalog(code: str, file: str, where: str) -> str:
    """A notice about a file, by what the catalog of the feed holds."""
    return f"SELECT '{code}' AS code, CAST(NULL AS BIGINT) AS csv_row, CAST(NULL AS VARCHAR) AS field, {file} AS filename FROM {where}"


def lost(child: str, field: str, parent: str, key: str, file: str | None = None) -> str:
    return row("foreign_key_violation", child, f"{field} IS NOT NULL AND {field} NOT IN (SELECT {key} FROM {parent} WHERE {key} IS NOT NULL)",
        f"'{field}'", childFilename=f"'{child}.txt'", parentFilename=f"'{file or parent + '.txt'}'", fieldValue=field)


def repeated(table: str, keys: str, where: str = "TRUE", code: str = "duplicate_key", field: str = "NULL", prev: str = "prevCsvRowNumber") -> str:
    return row(code, f"(SELECT *, row_number() OVER w AS at_, first_value(_row) OVER w AS prev_ FROM {table} WHERE {where} WINDOW w AS (PARTITION BY {keys} ORDER BY _row)) x",
        "at_ > 1", field, **{prev: "prev_"})


CLOCK = "lpad(CAST({0} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"


def clock(x: str) -> str:
    return CLOCK.format(x)


# presence, required fields, keys, references
_none_of = "(SELECT count(*) AS c FROM catalog WHERE name IN ({0})) x WHERE c = 0"
add("rule_calendar_presence", "CalendarPresenceValidator", "",
    of_catalog("missing_calendar_and_calendar_date_files", "NULL", _none_of.format("'calendar', 'calendar_dates'")), bare=True)
add("rule_missing_stops_file", "MissingStopsFileValidator", "",
    of_catalog("missing_required_file", "'stops.txt'", "catalog WHERE name = 'stops' AND NOT has_header AND n = 0 AND NOT EXISTS (SELECT * FROM catalog c WHERE c.name = 'locations')"),
        bare=True)
add("rule_required_tables", "RequiredTablesNotEmptyValidator", "filename",
    of_catalog("empty_file", "name || '.txt'", "catalog WHERE name IN ('agency', 'routes', 'trips', 'stop_times', 'stops') AND has_header AND n = 0"), bare=True)
_required = {"agency": "agency_name agency_url agency_timezone", "stops": "stop_id", "routes": "route_id", "trips": "route_id service_id trip_id",
    "stop_times": "trip_id", "fare_attributes": "fare_id currency_type", "translations": "language translation", "fare_rules": "fare_id"}
add("rule_required_fields", "RequiredFieldsNonEmptyValidator", "", *[each("missing_required_field", t, {f: f"{f} IS NULL" for f in fs.split()}) for t, fs in _required.items()])
from .model import EDGES  # noqa: E402

_have = [(c, f, p, k) for c, f, p, k in EDGES if f" {f}" in synth.VIEWS[c]]
add("rule_referential_integrity", "ReferentialIntegrityValidator", "childFilename parentFilename fieldValue", *[lost(*e) for e in _have])
add("rule_trip_service_fk", "TripServiceIdForeignKeyValidator", "childFilename fieldValue", lost("trips", "service_id",
    "(SELECT service_id FROM calendar UNION ALL SELECT service_id FROM calendar_dates) p", "service_id"))
add("rule_timeframe_service_fk", "TimeframeServiceIdForeignKeyValidator", "childFilename fieldValue", lost("timeframes", "service_id",
    "(SELECT service_id FROM calendar UNION ALL SELECT service_id FROM calendar_dates) p", "service_id"))
add("rule_location_fk", "LocationIdForeignKeyValidator", "childFilename fieldValue", lost("stop_times", "location_id", "locations", "location_id"))
add("rule_locations_presence", "LocationsGeoJsonPresenceValidator", "",
    of_catalog("missing_required_file", "'locations.geojson'",
        _none_of.format("'locations'") + " AND EXISTS (SELECT * FROM stop_times WHERE location_id IS NOT NULL)"), bare=True)
add("rule_fare_rules", "FareRulesValidator", "childFilename fieldValue", lost("fare_rules", "fare_id", "fare_attributes", "fare_id"), lost("fare_rules", "route_id", "routes", "route_id"))
_networks = "(SELECT network_id FROM routes UNION ALL SELECT network_id FROM networks) p"
add("rule_fare_leg_network_fk", "FareLegRuleNetworkIdForeignKeyValidator", "childFilename fieldValue", lost("fare_leg_rules", "network_id", _networks, "network_id"))
add("rule_fare_leg_join", "FareLegJoinRuleValidator", "fieldValue", lost("fare_leg_join_rules", "from_network_id", _networks, "network_id"),
    lost("fare_leg_join_rules", "to_network_id", _networks, "network_id"),
    each("missing_required_field", "fare_leg_join_rules", {"from_stop_id": "from_stop_id IS NULL AND to_stop_id IS NOT NULL",
        "to_stop_id": "to_stop_id IS NULL AND from_stop_id IS NOT NULL"}, fieldValue="NULL"))
from .model import UNIQUE  # noqa: E402

add("rule_duplicate_key", "DuplicateKeyValidator", "prevCsvRowNumber", *[repeated(t, k, f"{k} IS NOT NULL", field=f"'{k}'") for t,
    k in UNIQUE.items()], repeated("fare_products", "fare_product_id", field="'fare_product_id'"),
    repeated("transfers", "from_stop_id, to_stop_id, from_trip_id, to_trip_id, from_route_id, to_route_id").replace("prev_ AS VARCHAR", "NULL AS VARCHAR"))
add("rule_duplicate_stop_sequence", "DuplicateStopSequenceValidator", "oldCsvRowNumber", repeated("stop_times", "trip_id, stop_sequence", prev="oldCsvRowNumber"))
add("rule_duplicate_fare_media", "DuplicateFareMediaValidator", "csvRowNumber1", repeated("fare_media", "trim(coalesce(fare_media_name, '')), fare_media_type",
    code="duplicate_fare_media", prev="csvRowNumber1"))
add("rule_duplicate_route_name", "DuplicateRouteNameValidator", "csvRowNumber1", repeated("routes", "trim(coalesce(route_short_name, '')), trim(coalesce(route_long_name, '')), route_type, agency_id",
    "coalesce(route_short_name, route_long_name) IS NOT NULL", "duplicate_route_name", prev="csvRowNumber1"))
add("rule_unused_trip", "TripUsageValidator", "tripId", row("unused_trip", "(SELECT trip_id, min(_row) AS _row FROM trips GROUP BY trip_id) t",
    "trip_id NOT IN (SELECT trip_id FROM stop_times)", tripId="trip_id"))
add("rule_unused_route", "UnusedRouteValidator", "routeId", row("unused_route", "routes", "route_id NOT IN (SELECT route_id FROM trips)", routeId="route_id"))
add("rule_unused_agency", "UnusedAgencyValidator", "agencyId", row("unused_agency", "agency",
    "agency_id IS NOT NULL AND agency_id NOT IN (SELECT agency_id FROM routes WHERE agency_id IS NOT NULL)", agencyId="agency_id"))
add("rule_unused_shape", "ShapeUsageValidator", "shapeId", row("unused_shape", "(SELECT shape_id, min(_row) AS _row FROM shapes GROUP BY shape_id) s",
    "shape_id NOT IN (SELECT shape_id FROM trips WHERE shape_id IS NOT NULL)", shapeId="shape_id"))
add("rule_unique_geography", "UniqueGeographyIdValidator", "geographyId", "SELECT 'duplicate_geography_id' AS code, CAST(NULL AS BIGINT) AS csv_row, CAST(NULL AS VARCHAR) AS field, id AS geographyId "
    "FROM (SELECT stop_id AS id, 1 AS s FROM stops UNION ALL SELECT location_group_id, 2 FROM location_group_stops UNION ALL SELECT location_id, 3 "
    "FROM locations) x GROUP BY id HAVING count(DISTINCT s) > 1")
add("rule_network_consistency", "NetworkIdConsistencyValidator", "fileNameB", "SELECT 'route_networks_specified_in_more_than_one_file' AS code, CAST(NULL AS BIGINT) AS csv_row, CAST(NULL AS VARCHAR) AS field, f AS fileNameB "
    "FROM (VALUES ('route_networks.txt'), ('networks.txt')) v(f)")
add("rule_missing_feed_info", "MissingFeedInfoValidator", "",
    of_catalog("missing_required_file", "'feed_info.txt'", "catalog WHERE name = 'translations' AND has_header AND NOT EXISTS (SELECT * FROM catalog c WHERE c.name = 'feed_info')"),
        bare=True)
add("rule_translations", "TranslationFieldAndReferenceValidator", "tableName", None)

# rows
_langs = (
    "(SELECT *, count(*) OVER () AS n, first_value(agency_timezone) OVER w AS tz, (SELECT lower(trim(agency_lang)) FROM agency "
    "WHERE agency_lang IS NOT NULL ORDER BY _row LIMIT 1) AS lang FROM agency WINDOW w AS (ORDER BY _row)) a"
)
add("rule_agency_consistency", "AgencyConsistencyValidator", "expected actual", row("missing_required_field", _langs, "n > 1 AND agency_id IS NULL",
    "'agency_id'", expected="NULL", actual="NULL"), row("inconsistent_agency_timezone", _langs, "agency_timezone <> tz", expected="tz",
    actual="agency_timezone"),
    row("inconsistent_agency_lang", _langs, "lower(trim(agency_lang)) <> lang", expected="lang", actual="lower(trim(agency_lang))"))
_seq = {"tripId": "trip_id", "stopSequence": "stop_sequence"}
add("rule_timepoint", "TimepointTimeValidator", "tripId stopSequence", row("missing_timepoint_value", "stop_times",
    "timepoint IS NULL AND coalesce(arrival_time, departure_time) IS NOT NULL", **_seq),
    each("stop_time_timepoint_without_times", "stop_times", {f: f"timepoint = 1 AND {f} IS NULL" for f in ("arrival_time", "departure_time")}, **_seq))
_any = "coalesce(start_pickup_drop_off_window, end_pickup_drop_off_window) IS NOT NULL"
add("rule_pickup_drop_off_type", "PickupDropOffTypeValidator", "", row("forbidden_pickup_type", "stop_times", f"{_any} AND coalesce(pickup_type, 0) IN (0, 3)"),
    row("forbidden_drop_off_type", "stop_times", f"{_any} AND coalesce(drop_off_type, 0) = 0"))
add("rule_pickup_drop_off_window", "PickupDropOffWindowValidator", "startPickupDropOffWindow", *[row(code, "stop_times", where,
    startPickupDropOffWindow=clock("start_pickup_drop_off_window")) for code, where in (
    ("forbidden_arrival_or_departure_time", f"{_any} AND coalesce(arrival_time, departure_time) IS NOT NULL"), ("missing_pickup_or_drop_off_window",
        "(start_pickup_drop_off_window IS NULL) <> (end_pickup_drop_off_window IS NULL)"), ("invalid_pickup_drop_off_window",
        "start_pickup_drop_off_window >= end_pickup_drop_off_window"))])
_geo = "((stop_id IS NOT NULL)::INT + (location_group_id IS NOT NULL)::INT + (location_id IS NOT NULL)::INT)"
add("rule_geography_presence", "StopTimesGeographyIdPresenceValidator", "stopId", row("missing_required_field", "stop_times", f"{_geo} = 0",
    "'stop_id'", stopId="NULL"), row("forbidden_geography_id", "stop_times", f"{_geo} > 1", stopId="stop_id"))
for _name, _rule, _t, _y, _x, _id in (("rule_stop_lat_lon", "StopLatLonValidator", "stops", "stop_lat", "stop_lon", "stop_id"), ("rule_shape_lat_lon",
    "ShapeLatLonValidator", "shapes", "shape_pt_lat", "shape_pt_lon", "shape_id")):
    add(_name, _rule, "entityId", row("number_out_of_range", _t, f"abs({_y}) > 90", f"'{_y}'", entityId=_id), row("number_out_of_range", _t,
        f"abs({_x}) > 180", f"'{_x}'", entityId=_id), row("point_near_origin", _t, f"abs({_y}) <= 1 AND abs({_x}) <= 1", entityId=_id),
        row("point_near_pole", _t, f"abs({_y}) >= 89 AND {_x} IS NOT NULL", entityId=_id))
add("rule_shape_dist_presence", "StopTimesShapeDistTraveledPresenceValidator", "tripId", row("forbidden_shape_dist_traveled", "stop_times",
    f"shape_dist_traveled IS NOT NULL AND ({_any} OR stop_id IS NULL AND coalesce(location_group_id, location_id) IS NOT NULL)",
    "'shape_dist_traveled'", tripId="trip_id"))
add("rule_stops", "StopsValidator", "stopId", row("missing_stop_name", "stops", "coalesce(location_type, 0) < 3 AND stop_name IS NULL",
    stopId="stop_id"), row("stop_without_location", "stops", "coalesce(location_type, 0) < 3 AND (stop_lat IS NULL OR stop_lon IS NULL)",
    stopId="stop_id"), row("same_name_and_description_for_stop", "stops", "lower(stop_name) = lower(stop_desc)", stopId="stop_id"))
add("rule_booking_rule_id", "PickupBookingRuleIdValidator", "", row("missing_pickup_drop_off_booking_rule_id", "stop_times",
    "start_pickup_drop_off_window IS NOT NULL AND pickup_type = 2 AND pickup_booking_rule_id IS NULL", "'pickup_booking_rule_id'"),
    row("missing_pickup_drop_off_booking_rule_id", "stop_times", "end_pickup_drop_off_window IS NOT NULL AND drop_off_type = 2",
    "'drop_off_booking_rule_id'"))
add("rule_continuous", "ContinuousPickupDropOffValidator", "tripId stopTimeCsvRowNumber", row("forbidden_continuous_pickup_drop_off",
    f"(SELECT r._row, s._row AS sr, s.trip_id FROM routes r JOIN (SELECT DISTINCT route_id, trip_id FROM trips) t ON t.route_id = r.route_id "
    f"JOIN stop_times s ON s.trip_id = t.trip_id WHERE (r.continuous_pickup IN (0, 2, 3) OR r.continuous_drop_off IN (0, 2, 3)) AND {_any}) x", tripId="trip_id", stopTimeCsvRowNumber="sr"))
_named = "coalesce(route_short_name, route_long_name) IS NOT NULL"
add("rule_routes", "RoutesValidator", "routeId specifiedField", row("route_both_short_and_long_name_missing", "routes", f"NOT ({_named})",
    routeId="route_id", specifiedField="NULL"), row("route_short_name_too_long", "routes", "length(route_short_name) > 12", "'route_short_name'",
    routeId="route_id", specifiedField="NULL"),
    row("route_long_name_contains_short_name", "routes", r"starts_with(lower(route_long_name), lower(trim(route_short_name))) "
    r"AND regexp_full_match(substring(route_long_name, length(trim(route_short_name)) + 1, 1), '[\s\-(]?')", routeId="route_id", specifiedField="NULL"),
    row("same_name_and_description_for_route", "routes", "lower(route_desc) = lower(route_short_name)", routeId="route_id", specifiedField="'route_short_name'"),
    row("same_name_and_description_for_route", "routes", "lower(route_desc) = lower(route_long_name) AND coalesce(lower(route_desc) <> lower(route_short_name), TRUE)",
        routeId="route_id", specifiedField="'route_long_name'"))
add("rule_bikes", "BikesAllowanceValidator", "tripId", row("missing_bike_allowance", "trips",
    "route_id IN (SELECT route_id FROM routes WHERE route_type = 4) AND coalesce(bikes_allowed, 0) NOT IN (1, 2)", tripId="trip_id"))
add("rule_route_agency_id", "RouteAgencyIdValidator", "", row("missing_required_field", "routes", "agency_id IS NULL AND (SELECT count(*) FROM agency) > 1", "'agency_id'"))
add("rule_fare_agency_id", "FareAttributeAgencyIdValidator", "", row("missing_required_field", "fare_attributes", "agency_id IS NULL AND (SELECT count(*) FROM agency) > 1", "'agency_id'"))
add("rule_matching_lang", "MatchingFeedAndAgencyLangValidator", "agencyId agencyLang", "SELECT 'feed_info_lang_and_agency_lang_mismatch' AS code, CAST(2 AS BIGINT) AS csv_row, "
    "CAST(NULL AS VARCHAR) AS field, agency_id AS agencyId, lower(trim(agency_lang)) AS agencyLang FROM agency "
    "WHERE lower(trim(agency_lang)) <> (SELECT feed_lang FROM feed_info ORDER BY _row LIMIT 1)")
_url = "lower(trim({0}))"
for _code, _a, _b, _ua, _ub in (("same_route_and_agency_url", "routes", "agency", "route_url", "agency_url"), ("same_stop_and_agency_url", "stops",
    "agency", "stop_url", "agency_url"), ("same_stop_and_route_url", "stops", "routes", "stop_url", "route_url")):
    _before = ORACLE_SQL.get("rule_url_consistency")
    ORACLE_SQL["rule_url_consistency"] = (_before + " UNION ALL " if _before else "") + (
        f"SELECT '{_code}' AS code, CAST(a._row AS BIGINT) AS csv_row, CAST(NULL AS VARCHAR) AS field "
        f"FROM {_a} a JOIN {_b} b ON {_url.format('a.' + _ua)} = {_url.format('b.' + _ub)}"
    )
_urls = ORACLE_SQL.pop("rule_url_consistency")
add("rule_url_consistency", "UrlConsistencyValidator", "", _urls)
_luma = "CAST(floor(0.30 * ({0} // 65536 % 256) + 0.59 * ({0} // 256 % 256) + 0.11 * ({0} % 256)) AS INT)"
add("rule_color_contrast", "RouteColorContrastValidator", "routeId", row("route_color_contrast", "routes",
    f"abs({_luma.format('route_color')} - {_luma.format('route_text_color')}) < 72", routeId="route_id"))
add("rule_frequencies", "FrequenciesValidator", "entityId", row("start_and_end_range_out_of_order", "frequencies", "start_time > end_time",
    entityId="trip_id"), row("start_and_end_range_equal", "frequencies", "start_time = end_time", entityId="trip_id"))
add("rule_fare_attributes", "FareAttributesValidator", "entityId", row("number_out_of_range", "fare_attributes", "price < 0", "'price'", entityId="fare_id"))
add("rule_fare_media_name", "FareMediaNameValidator", "", row("missing_recommended_field", "fare_media", "fare_media_type IN (2, 4) AND fare_media_name IS NULL", "'fare_media_name'"))
add("rule_duration_limit", "FareTransferRuleDurationLimitTypeValidator", "", row("fare_transfer_rule_duration_limit_without_type",
    "fare_transfer_rules", "duration_limit >= 0 AND duration_limit_type IS NULL"),
    row("fare_transfer_rule_duration_limit_type_without_duration_limit", "fare_transfer_rules",
    "duration_limit IS NULL AND duration_limit_type IS NOT NULL"))
_same = "from_leg_group_id = to_leg_group_id"
add("rule_transfer_count", "FareTransferRuleTransferCountValidator", "", row("fare_transfer_rule_invalid_transfer_count", "fare_transfer_rules",
    f"{_same} AND (transfer_count < -1 OR transfer_count = 0)"), row("fare_transfer_rule_missing_transfer_count", "fare_transfer_rules",
    f"{_same} AND transfer_count IS NULL"), row("fare_transfer_rule_with_forbidden_transfer_count", "fare_transfer_rules",
    f"NOT ({_same}) AND transfer_count IS NOT NULL"))
add("rule_timeframe_times", "TimeframeStartAndEndTimeValidator", "", row("timeframe_only_start_or_end_time_specified", "timeframes",
    "(start_time IS NULL) <> (end_time IS NULL)"), each("timeframe_start_or_end_time_greater_than_twenty_four_hours", "timeframes",
    {f: f"{f} > 86400" for f in ("start_time", "end_time")}))
add("rule_feed_info", "FeedInfoValidator", "entityCount", "SELECT 'more_than_one_entity' AS code, CAST(NULL AS BIGINT) AS csv_row, CAST(NULL AS VARCHAR) AS field, CAST(count(*) AS VARCHAR) AS entityCount "
    "FROM feed_info HAVING count(*) > 1", row("missing_recommended_field", "feed_info", field="'feed_version'", entityCount="NULL"),
        row("start_and_end_range_out_of_order", "feed_info", "feed_start_date > feed_end_date", entityCount="NULL"))
add("rule_feed_service_date", "FeedServiceDateValidator", "", each("missing_feed_info_date", "feed_info",
    {"feed_start_date": "feed_start_date IS NULL AND feed_end_date IS NOT NULL",
    "feed_end_date": "feed_end_date IS NULL AND feed_start_date IS NOT NULL"}))
_day = "strftime({0}, '%Y%m%d')"
add("rule_feed_expiration", "FeedExpirationDateValidator", "feedEndDate", row("feed_expiration_date7_days", "feed_info",
    "feed_end_date <= DATE '2025-01-08'", feedEndDate=_day.format("feed_end_date")), row("feed_expiration_date30_days", "feed_info",
    "feed_end_date > DATE '2025-01-08' AND feed_end_date <= DATE '2025-01-31'", feedEndDate=_day.format("feed_end_date")))
add("rule_feed_contact", "FeedContactValidator", "", row("missing_feed_contact_email_and_url", "feed_info", "feed_contact_email IS NULL"))
add("rule_attribution_role", "AttributionWithoutRoleValidator", "attributionId", row("attribution_without_role", "attributions",
    "coalesce(is_producer, 0) <> 1 AND coalesce(is_operator, 0) <> 1", attributionId="attribution_id"))
_sites = {"agency_url": "agency", "stop_url": "stops", "route_url": "routes", "feed_publisher_url": "feed_info"}
add("rule_url_syntax", "UrlSyntaxValidator", "", *[row("u_r_i_syntax_error", t, f"{f} IS NOT NULL AND NOT {oracles.url(f'trim({f})')}", f"'{f}'") for f, t in _sites.items()])
_b = "booking_rules"
_arr = lambda names: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN prior_notice_{n} IS NOT NULL THEN 'prior_notice_{n}' END" for n in names.split()) + "], lambda x: x IS NOT NULL), ',')"
add("rule_booking_rules", "BookingRulesEntityValidator", "fieldNames", *[row(code, _b, f"booking_type = {k} AND {_arr(n)} <> ''",
    fieldNames=_arr(n)) for k, code, n in ((0, "forbidden_real_time_booking_field_value",
    "duration_min duration_max last_day last_time start_day start_time"), (1, "forbidden_same_day_booking_field_value", "last_day last_time"), (2,
    "forbidden_prior_day_booking_field_value", "duration_min duration_max"))],
    *[row(code, _b, where, fieldNames="NULL") for code, where in (("missing_prior_notice_duration_min",
        "booking_type = 1 AND prior_notice_duration_min IS NULL"), ("invalid_prior_notice_duration_min",
        "prior_notice_duration_max < prior_notice_duration_min"),
    ("forbidden_prior_notice_start_day", "prior_notice_duration_max IS NOT NULL AND prior_notice_start_day IS NOT NULL"),
        ("prior_notice_last_day_after_start_day", "prior_notice_last_day > prior_notice_start_day"), ("missing_prior_notice_last_day",
        "booking_type = 2 AND prior_notice_last_day IS NULL"),
    ("missing_prior_notice_last_time", "booking_type = 2 AND prior_notice_last_time IS NULL"), ("forbidden_prior_notice_start_time",
        "prior_notice_start_time IS NOT NULL AND prior_notice_start_day IS NULL"), ("missing_prior_notice_start_time",
        "prior_notice_start_time IS NULL AND prior_notice_start_day IS NOT NULL"))])
for _name, _rule, _t, _w, _code, _f in (
    ("rule_google_transfer_type", "GoogleTransferTypeValidator", "transfers", "transfer_type IN (4, 5)", "google_transfer_type_check",
        "transfer_type"), ("rule_google_ic_price", "GoogleFareAttributesValidator", "fare_attributes", "ic_price <> -1 AND ic_price < 0",
        "google_ic_price_check", "ic_price"),
    ("rule_agency_phone", "AgencyPhoneValidator", "agency", "length(regexp_replace(agency_phone, '[^0-9]', '', 'g')) < 5", "agency_phone_invalid",
        "agency_phone"), ("rule_short_name_length", "RouteShortNameLengthValidator", "routes", "strlen(trim(route_short_name)) > 6",
        "route_short_name_too_long", "route_short_name"),
    ("rule_headsign_format", "StopHeadsignFormatValidator", "stop_times", "contains(stop_headsign, '*')", "stop_headsign_invalid_char",
        "stop_headsign"), ("rule_headway", "HeadwayReasonablenessValidator", "frequencies", "headway_secs > 3600", "headway_too_large",
        "headway_secs"),
):
    add(_name, _rule, "", row(_code, _t, _w, f"'{_f}'"))

# sequences
_w = "WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence, _row)"
_prev = (
    f"(SELECT *, last_value(CASE WHEN departure_time IS NOT NULL THEN departure_time END IGNORE NULLS) OVER (PARTITION BY trip_id "
    f"ORDER BY stop_sequence, _row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pd FROM stop_times) s"
)
add("rule_arrival_departure", "StopTimeArrivalAndDepartureTimeValidator", "tripId", *[row("stop_time_with_only_arrival_or_departure_time",
    "stop_times", f"{a} IS NOT NULL AND {b} IS NULL", f"'{a}'", tripId="trip_id") for a, b in (("arrival_time", "departure_time"), ("departure_time",
    "arrival_time"))],
    row("start_and_end_range_out_of_order", "stop_times", "arrival_time > departure_time", tripId="NULL"),
        row("stop_time_with_arrival_before_previous_departure_time", _prev, "arrival_time < pd", tripId="trip_id"))
_edge = lambda o: f"(SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY {o}) AS k FROM stop_times) s"
add("rule_missing_trip_edge", "MissingTripEdgeValidator", "tripId", *[each("missing_trip_edge", _edge(o),
    {f: f"k = 1 AND NOT ({_any}) AND {f} IS NULL" for f in ("arrival_time", "departure_time")}, tripId="trip_id") for o in ("stop_sequence, _row",
    "stop_sequence DESC, _row DESC")])
add("rule_stop_times_record", "StopTimesRecordValidator", "tripId", row("missing_stop_times_record", "(SELECT *, count(*) OVER (PARTITION BY trip_id) AS n FROM stop_times) s",
    "n = 1 AND start_pickup_drop_off_window IS NOT NULL AND end_pickup_drop_off_window IS NOT NULL AND pickup_type = 2 AND drop_off_type = 2",
    tripId="trip_id"))
add("rule_increasing_distance", "StopTimeIncreasingDistanceValidator", "tripId prevCsvRowNumber", row("decreasing_or_equal_stop_time_distance",
    f"(SELECT *, lag(shape_dist_traveled) OVER w AS pd, lag(_row) OVER w AS pr FROM stop_times WHERE stop_id IS NOT NULL AND location_id IS NULL "
    f"AND location_group_id IS NULL {_w}) s", "pd >= shape_dist_traveled", tripId="trip_id", prevCsvRowNumber="pr"))
add("rule_overlapping_frequency", "OverlappingFrequencyValidator", "tripId prevCsvRowNumber", row("overlapping_frequency", "(SELECT *, lag(end_time) OVER w AS pe, lag(_row) OVER w AS pr FROM frequencies WINDOW w AS (PARTITION BY trip_id "
    "ORDER BY start_time, end_time, headway_secs, _row)) f", "start_time < pe", tripId="trip_id", prevCsvRowNumber="pr"))
add("rule_timeframe_overlap", "TimeframeOverlapValidator", "timeframeGroupId prevCsvRowNumber", row("timeframe_overlap", "(SELECT *, row_number() OVER (PARTITION BY timeframe_group_id, service_id ORDER BY start_time, end_time, _row) AS k "
    "FROM (SELECT *, lag(end_time) OVER w AS pe, lag(_row) OVER w AS pr FROM timeframes WHERE start_time IS NOT NULL AND end_time IS NOT NULL "
    "WINDOW w AS (PARTITION BY timeframe_group_id, service_id ORDER BY start_time, end_time, _row)) x WHERE start_time < pe) y", "k = 1",
        timeframeGroupId="timeframe_group_id", prevCsvRowNumber="pr"))
add("rule_unusable_trip", "TripUsabilityValidator", "tripId", row("unusable_trip", "trips",
    "trip_id NOT IN (SELECT trip_id FROM stop_times GROUP BY trip_id HAVING count(*) > 1)", tripId="trip_id"))
add("rule_default_categories", "FareProductDefaultRiderCategoriesValidator", "fareProductId riderCategoryId1 riderCategoryId2",
    "SELECT 'fare_product_with_multiple_default_rider_categories' AS code, CAST(NULL AS BIGINT) AS csv_row, CAST(NULL AS VARCHAR) AS field, "
    "CAST(NULL AS VARCHAR) AS fareProductId, 'C1' AS riderCategoryId1, 'C3' AS riderCategoryId2",
    "SELECT 'fare_product_with_multiple_default_rider_categories' AS code, min(_row) AS csv_row, "
    "CAST(NULL AS VARCHAR) AS field, fare_product_id AS fareProductId, arg_min(rider_category_id, _row) AS riderCategoryId1, arg_max(rider_category_id, "
    "_row) AS riderCategoryId2 FROM (SELECT *, row_number() OVER (PARTITION BY fare_product_id ORDER BY _row) AS k "
    "FROM (SELECT fare_product_id, rider_category_id, CAST(min(_row) AS BIGINT) AS _row FROM fare_products WHERE rider_category_id IN ('C1', 'C3') "
    "GROUP BY ALL) x) y WHERE k <= 2 GROUP BY fare_product_id HAVING count(*) > 1")  # fmt: skip

# calendars
_dow = "[sunday, monday, tuesday, wednesday, thursday, friday, saturday][dayofweek(d)::INT + 1] = 1"


def dates(clamp: bool, last: bool = False) -> str:
    """SQL of service_id, d."""
    source = "(SELECT * FROM calendar QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY _row DESC) = 1)" if last else "calendar"
    end = "greatest(start_date, end_date)" if clamp else "end_date"
    return f"""(SELECT service_id, d FROM (SELECT DISTINCT service_id, d FROM (SELECT *, unnest(generate_series(start_date::TIMESTAMP, ({end})::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d
        FROM {source} c) e WHERE {_dow}
        EXCEPT SELECT service_id, date FROM calendar_dates GROUP BY ALL HAVING arg_max(exception_type, _row) = 2) k UNION SELECT service_id, date FROM calendar_dates
            GROUP BY ALL HAVING arg_max(exception_type, _row) = 1)"""


add("rule_calendar", "CalendarValidator", "", row("start_and_end_range_out_of_order", "calendar", "start_date > end_date"), repeated("calendar_dates",
    "service_id, date").replace(", CAST(prev_ AS VARCHAR) AS prevCsvRowNumber", ""))
add("rule_expired_calendar", "ExpiredCalendarValidator", "serviceId", row("expired_calendar", f"calendar JOIN (SELECT service_id AS s, max(d) AS z FROM {dates(True)} x GROUP BY 1) y ON s = service_id",
    "z < DATE '2025-01-01'", serviceId="service_id"))
_runs = "CASE WHEN headway_secs > 0 AND end_time > start_time THEN 1 + (end_time - start_time - 1) // headway_secs ELSE 0 END"
_per = (
    f"(SELECT d, CAST(sum(k) AS BIGINT) AS n FROM {dates(True)} s JOIN (SELECT service_id, sum(coalesce(times, 1)) AS k FROM trips LEFT "
    f"JOIN (SELECT trip_id, sum({_runs}) AS times FROM frequencies GROUP BY 1) f USING (trip_id) GROUP BY 1) t USING (service_id) GROUP BY d)"
)
_window = (
    f"(SELECT min(d) AS a, max(d) AS z FROM (SELECT *, floor(0.75 * max(CASE "
    f"WHEN at_ = least(greatest(floor(0.9 * m)::BIGINT, m - 30), m - 1) THEN n END) OVER ()) AS low "
    f"FROM (SELECT *, row_number() OVER (ORDER BY n, d) - 1 AS at_, count(*) OVER () AS m FROM {_per} p) q) r WHERE n >= low)"
)
add("rule_date_trips", "DateTripsValidator", "serviceWindowStartDate serviceWindowEndDate", f"SELECT 'trip_coverage_not_active_for_next7_days' AS code, CAST(NULL AS BIGINT) AS csv_row, "
    f"CAST(NULL AS VARCHAR) AS field, {_day.format('a')} AS serviceWindowStartDate, {_day.format('z')} AS serviceWindowEndDate FROM {_window} w "
    f"WHERE a > DATE '2025-01-01' OR z < DATE '2025-01-08'")
add("rule_service_gap", "GoogleServiceGapValidator", "firstDate nextDate", f"SELECT 'too_many_days_without_service' AS code, CAST(NULL AS BIGINT) AS csv_row, "
    f"CAST(NULL AS VARCHAR) AS field, {_day.format('d')} AS firstDate, {_day.format('nd')} AS nextDate FROM (SELECT d, lead(d) OVER (ORDER BY d) AS nd "
    f"FROM (SELECT DISTINCT d FROM {dates(False, True)} x) y) z WHERE nd - d >= 14")
_span = (
    "(SELECT trip_id, max(a) AS a, max(z) AS z "
    "FROM (SELECT trip_id, first_value(coalesce(departure_time, arrival_time)) OVER w AS a, first_value(coalesce(arrival_time, departure_time)) OVER v AS z "
    "FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence, _row), v AS (PARTITION BY trip_id ORDER BY stop_sequence DESC, _row DESC)) q "
    "GROUP BY 1)"
)
add("rule_block_overlap", "BlockTripsWithOverlappingStopTimesValidator", "tripIdA tripIdB intersection", f"""SELECT 'block_trips_with_overlapping_stop_times' AS code, CAST(x._row AS BIGINT) AS csv_row, CAST(NULL AS VARCHAR) AS field, x.trip_id AS tripIdA, y.trip_id AS tripIdB,
    CAST(greatest(x.a, y.a) - least(x.z, y.z) AS VARCHAR) AS intersection
    FROM bt x JOIN bt y ON x.block_id = y.block_id AND (x.a, x._row) < (y.a, y._row) AND y.a < x.z WHERE x.service_id = y.service_id OR EXISTS (SELECT 1 FROM sd p
        JOIN sd q ON p.d = q.d WHERE p.service_id = x.service_id AND q.service_id = y.service_id)""")  # fmt: skip
ORACLE_SQL["rule_block_overlap"] = (
    synth.with_views("SELECT 1 FROM trips, stop_times, calendar, calendar_dates").removesuffix("\nSELECT 1 FROM trips, stop_times, calendar, calendar_dates") + f",\nbt AS (SELECT t.trip_id, t.block_id, t.service_id, t._row, s.a, s.z FROM trips t JOIN {_span} s USING (trip_id) WHERE t.block_id IS NOT NULL "
    f"AND s.a IS NOT NULL AND s.z IS NOT NULL),\nsd AS MATERIALIZED (SELECT * FROM {dates(False)} k)\nSELECT" + ORACLE_SQL["rule_block_overlap"].split("SELECT code, csv_row",
        1)[1].join([" code, csv_row", ""])
)

add("rule_zone_overlap", "OverlappingPickupDropOffZoneValidator", "tripId stopSequence1 stopSequence2", None)
add("rule_duplicate_trip", "DuplicateTripValidator", "tripCount exampleTripIds", None)

# stops, stations and pathways
_k = "coalesce(location_type, 0)"
add("rule_location_has_stop_times", "LocationHasStopTimesValidator", "stopId stopTimeCsvRowNumber", row("stop_without_stop_time", "stops",
    f"{_k} = 0 AND stop_id NOT IN (SELECT stop_id FROM stop_times WHERE stop_id IS NOT NULL) AND stop_id NOT IN (SELECT stop_id FROM location_group_stops "
    f"WHERE location_group_id IN (SELECT location_group_id FROM stop_times WHERE location_group_id IS NOT NULL))", stopId="stop_id", stopTimeCsvRowNumber="NULL"),
    row("location_with_unexpected_stop_time", "stops JOIN (SELECT stop_id AS s, min(_row) AS r FROM stop_times GROUP BY 1) t ON s = stop_id",
        f"{_k} <> 0", stopId="stop_id", stopTimeCsvRowNumber="r"))
_last = "(SELECT stop_id AS p_id, arg_max(coalesce(location_type, 0), _row) AS p_k, max(_row) AS p_row FROM stops GROUP BY 1) p"
add("rule_parent_station", "ParentStationValidator", "stopId parentCsvRowNumber", row("wrong_parent_location_type",
    f"stops JOIN {_last} ON parent_station = p_id", f"{_k} IN (0, 2, 3) AND p_k <> 1 OR {_k} = 4 AND p_k <> 0", stopId="stop_id",
    parentCsvRowNumber="p_row"), row("unused_station", "stops",
    f"{_k} = 1 AND stop_id NOT IN (SELECT parent_station FROM stops WHERE {_k} = 0 AND parent_station IS NOT NULL)", stopId="stop_id",
    parentCsvRowNumber="NULL"))
add("rule_location_type", "LocationTypeValidator", "stopId", row("station_with_parent_station", "stops", f"{_k} = 1 AND parent_station IS NOT NULL",
    stopId="stop_id"), row("location_without_parent_station", "stops", f"{_k} IN (2, 3, 4) AND parent_station IS NULL", stopId="stop_id"),
    row("platform_without_parent_station", "stops", f"{_k} = 0 AND platform_code IS NOT NULL AND parent_station IS NULL", stopId="stop_id"))
add("rule_stop_zone", "StopZoneIdValidator", "stopId", row("stop_without_zone_id", "stops",
    f"{_k} = 0 AND zone_id IS NULL AND stop_id IN (SELECT stop_id FROM stop_times WHERE trip_id IN (SELECT trip_id FROM trips "
    f"WHERE route_id IN (SELECT route_id FROM fare_rules WHERE origin_id IS NOT NULL)))", stopId="stop_id"))
_on = "SELECT from_stop_id FROM pathways UNION SELECT to_stop_id FROM pathways"
add("rule_missing_level", "MissingLevelIdValidator", "stopId", row("missing_level_id", "stops", f"level_id IS NULL AND stop_id IN ({_on})", stopId="stop_id"))
add("rule_pathways", "PathwaysValidator", "", row("number_out_of_range", "pathways", "traversal_time = 0", "'traversal_time'"),
    row("missing_recommended_field", "pathways", "length IS NULL AND pathway_mode <> 7", "'length'"), row("missing_recommended_field", "pathways",
    "pathway_mode = 2 AND stair_count IS NULL", "'stair_count'"))
add("rule_exit_gate", "BidirectionalExitGateValidator", "", row("bidirectional_exit_gate", "pathways", "pathway_mode = 7 AND is_bidirectional = 1"))
add("rule_pathway_loop", "PathwayLoopValidator", "pathwayId", row("pathway_loop", "pathways", "from_stop_id = to_stop_id", pathwayId="pathway_id"))
_sides = "(SELECT _row, pathway_id, 'from_stop_id' AS f, from_stop_id AS id FROM pathways UNION ALL SELECT _row, pathway_id, 'to_stop_id', to_stop_id FROM pathways) e"
add("rule_endpoint_type", "PathwayEndpointTypeValidator", "stopId", row("pathway_to_platform_with_boarding_areas",
    f"{_sides} JOIN {_last} ON id = p_id", "p_k = 0 AND id IN (SELECT parent_station FROM stops WHERE parent_station IS NOT NULL)", "f",
    stopId="id").replace("_row AS BIGINT", "e._row AS BIGINT"), row("pathway_to_wrong_location_type", f"{_sides} JOIN {_last} ON id = p_id",
    "p_k = 1", "f", stopId="id").replace("_row AS BIGINT", "e._row AS BIGINT"))
add("rule_dangling", "PathwayDanglingGenericNodeValidator", "stopId", row("pathway_dangling_generic_node", "stops",
    "location_type = 3 AND stop_id IN (SELECT a FROM (SELECT from_stop_id AS a, to_stop_id AS b FROM pathways UNION SELECT to_stop_id, from_stop_id "
    "FROM pathways) x GROUP BY a HAVING count(DISTINCT b) = 1)", stopId="stop_id"))
add("rule_unreachable", "PathwayReachableLocationValidator", "stopId hasEntrance hasExit", None)
add("rule_unused_stop", "UnusedStopValidator", "stopId", "SELECT 1")
ORACLE_SQL["rule_unused_stop"] = synth.with_views("SELECT 1 FROM stops, stop_times").replace("WITH ", "WITH RECURSIVE ", 1).removesuffix("\nSELECT 1 FROM stops, stop_times") + """,
up AS (SELECT stop_id AS a, arg_max_null(parent_station, _row) AS b FROM stops GROUP BY 1), seen(id) AS (SELECT DISTINCT stop_id FROM stop_times WHERE stop_id IS NOT NULL
    UNION SELECT b FROM seen JOIN up ON a = id WHERE b IS NOT NULL)
SELECT 'unused_stop' AS code, CAST(_row AS BIGINT) AS csv_row, CAST(NULL AS VARCHAR) AS field, stop_id AS stopId FROM stops WHERE stop_id NOT IN (SELECT id FROM seen)"""

# transfers
_side = (
    "(SELECT _row, transfer_type, 'from' AS side, from_stop_id AS stop_id, from_route_id AS route_id, from_trip_id AS trip_id FROM transfers UNION ALL "
    "SELECT _row, transfer_type, 'to', to_stop_id, to_route_id, to_trip_id FROM transfers) t"
)
add("rule_min_transfer_time", "TransfersValidator", "", row("missing_required_field", "transfers", "transfer_type = 2 AND min_transfer_time IS NULL", "'min_transfer_time'"))
_kind = f"{_side} JOIN {_last} ON stop_id = p_id"
add("rule_transfer_stop_type", "TransfersStopTypeValidator", "stopId", row("transfer_with_invalid_stop_location_type", _kind, "p_k NOT IN (0, 1)", "side || '_stop_id'", stopId="stop_id"))
_route = "(SELECT trip_id AS q_id, arg_max(route_id, _row) AS own FROM trips GROUP BY 1) q"
_places = f"(SELECT p_id AS st, p_id AS at_ FROM {_last} WHERE p_k = 0 UNION ALL SELECT p_id, stop_id FROM {_last} JOIN stops ON parent_station = p_id WHERE p_k = 1)"
add("rule_transfer_trip", "TransfersTripReferenceValidator", "tripId", row("transfer_with_invalid_trip_and_route",
    f"{_side} JOIN {_route} ON trip_id = q_id", "route_id <> own", tripId="trip_id"),
    row("transfer_with_invalid_trip_and_stop", f"{_side} JOIN {_route} ON trip_id = q_id JOIN {_last} ON stop_id = p_id", f"p_k IN (0, 1) AND NOT EXISTS (SELECT 1 FROM {_places} pl JOIN stop_times s ON s.stop_id = pl.at_ WHERE pl.st = t.stop_id AND s.trip_id = t.trip_id)",
        tripId="trip_id"))
add("rule_transfer_stop_ids", "TransferStopIdsConditionalValidator", "", each("missing_required_field", "transfers", {f: f"transfer_type NOT IN (4, 5) AND {f} IS NULL" for f in ("from_stop_id",
    "to_stop_id")}))
_ends = (
    "(SELECT trip_id AS z_id, max(f) AS first_, max(l) AS last_ FROM (SELECT trip_id, first_value(stop_id) OVER w AS f, first_value(stop_id) OVER v AS l "
    "FROM stop_times WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence, _row), v AS (PARTITION BY trip_id ORDER BY stop_sequence DESC, _row DESC)) x "
    "GROUP BY 1) z"
)
add("rule_in_seat", "TransfersInSeatTransferTypeValidator", "stopId", row("missing_required_field", _side, "transfer_type IN (4, 5) AND trip_id IS NULL",
    "side || '_trip_id'", stopId="NULL"), row("transfer_with_invalid_stop_location_type", _kind, "transfer_type IN (4, 5) AND p_k = 1",
    "side || '_stop_id'", stopId="stop_id"),
    row("transfer_with_suspicious_mid_trip_in_seat", f"{_side} JOIN {_ends} ON trip_id = z_id", "transfer_type IN (4, 5) AND EXISTS (SELECT 1 FROM stop_times s WHERE s.trip_id = t.trip_id AND s.stop_id = t.stop_id) AND (side = 'from' "
    "AND stop_id <> last_ OR side = 'to' AND stop_id <> first_)", stopId="stop_id"))  # fmt: skip
_hav = "2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - {a}))"


def haversine(y1: str, x1: str, y2: str, x2: str) -> str:
    return _hav.format(a=f"(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))")


_pt = "CASE WHEN stop_lat IS NOT NULL AND stop_lon IS NOT NULL THEN {'y': stop_lat, 'x': stop_lon} END"
_base = f"(SELECT stop_id, {_pt} AS at_, parent_station AS p FROM stops QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY _row DESC) = 1)"
_at = f"(SELECT a.stop_id, coalesce(a.at_, b.at_, c.at_) AS at_ FROM {_base} a LEFT JOIN {_base} b ON a.p = b.stop_id LEFT JOIN {_base} c ON b.p = c.stop_id)"
_dist = (
    f"(SELECT t._row, from_stop_id, {haversine('f.at_.y', 'f.at_.x', 'g.at_.y', 'g.at_.x')} / 1000 AS km FROM transfers t "
    f"JOIN {_at} f ON f.stop_id = from_stop_id JOIN {_at} g ON g.stop_id = to_stop_id) d"
)
add("rule_transfer_distance", "TransferDistanceValidator", "fromStopId", row("transfer_distance_too_large", _dist, "km > 10",
    fromStopId="from_stop_id"), row("transfer_distance_above_2_km", _dist, "km > 2 AND km <= 10", fromStopId="from_stop_id"))

# distances along shapes, speed, shape matching
_pts = (
    f"(SELECT *, {haversine('py', 'px', 'shape_pt_lat', 'shape_pt_lon')} AS m "
    f"FROM (SELECT *, lag(_row) OVER w AS pr, lag(shape_dist_traveled) OVER w AS pd, lag(shape_pt_lat) OVER w AS py, lag(shape_pt_lon) OVER w AS px "
    f"FROM shapes WINDOW w AS (PARTITION BY shape_id ORDER BY shape_pt_sequence, _row)) s) s"
)
_eq = "shape_dist_traveled = pd AND NOT (py = shape_pt_lat AND px = shape_pt_lon)"
add("rule_shape_distance", "ShapeIncreasingDistanceValidator", "shapeId prevCsvRowNumber", *[row(code, _pts, where, shapeId="shape_id",
    prevCsvRowNumber="pr") for code, where in (("decreasing_shape_distance", "shape_dist_traveled < pd"), ("equal_shape_distance_same_coordinates",
    "shape_dist_traveled = pd AND py = shape_pt_lat AND px = shape_pt_lon"), ("equal_shape_distance_diff_coordinates", f"{_eq} AND m >= 1.11"),
    ("equal_shape_distance_diff_coordinates_distance_below_threshold", f"{_eq} AND m > 0 AND m < 1.11"))])
add("rule_single_point", "SingleShapePointValidator", "shapeId", "SELECT 'single_shape_point' AS code, CAST(min(_row) AS BIGINT) AS csv_row, CAST(NULL AS VARCHAR) AS field, shape_id AS shapeId FROM shapes "
    "GROUP BY shape_id HAVING count(*) = 1")
_top = "(SELECT * FROM shapes WHERE shape_dist_traveled IS NOT NULL QUALIFY row_number() OVER (PARTITION BY shape_id ORDER BY shape_dist_traveled DESC, _row) = 1) m"
_end = "(SELECT * FROM stop_times QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY stop_sequence DESC, _row DESC) = 1) z"
_lst = "(SELECT stop_id, stop_lat, stop_lon FROM stops QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY _row DESC) = 1) s"
_ts = (
    f"(SELECT t._row, t.trip_id, {haversine('s.stop_lat', 's.stop_lon', 'm.shape_pt_lat', 'm.shape_pt_lon')} AS far FROM trips t "
    f"JOIN {_top} ON m.shape_id = t.shape_id JOIN {_end} ON z.trip_id = t.trip_id JOIN {_lst} ON s.stop_id = z.stop_id WHERE m.shape_dist_traveled > 0 "
    f"AND z.shape_dist_traveled > m.shape_dist_traveled) x"
)
add("rule_trip_and_shape", "TripAndShapeDistanceValidator", "tripId", row("trip_distance_exceeds_shape_distance", _ts, "far > 11.1",
    tripId="trip_id"), row("trip_distance_exceeds_shape_distance_below_threshold", _ts, "far <= 11.1 AND far > 0", tripId="trip_id"))
add("rule_travel_speed", "StopTimeTravelSpeedValidator", "tripId csvRowNumber1 csvRowNumber2", None)
add("rule_shape_matching", "ShapeToStopMatchingValidator", "tripId shapeId stopId", None)

# the rules whose SQL needs more than a few lines
_sig = (
    "(SELECT trip_id, string_agg(coalesce(stop_id, '-') || '/' || coalesce(CAST(arrival_time AS VARCHAR), '-') || '/' || coalesce(CAST(departure_time AS "
    "VARCHAR), '-'), ',' ORDER BY _row) AS sig FROM stop_times GROUP BY 1)"
)
add("rule_duplicate_trip", "DuplicateTripValidator", "tripCount exampleTripIds", f"""SELECT 'duplicate_trip' AS code, CAST(min(_row) AS BIGINT) AS csv_row, CAST(NULL AS VARCHAR) AS field, CAST(count(*) AS VARCHAR) AS tripCount,
    array_to_string(list_slice(list(trip_id ORDER BY _row), 1, 5), ',') AS exampleTripIds FROM trips JOIN {_sig} s USING (trip_id)
        GROUP BY service_id, route_id, direction_id, block_id, shape_id, sig HAVING count(*) > 1""")  # fmt: skip
_flex = "(SELECT * FROM stop_times WHERE start_pickup_drop_off_window IS NOT NULL AND end_pickup_drop_off_window IS NOT NULL)"
add("rule_zone_overlap", "OverlappingPickupDropOffZoneValidator", "tripId stopSequence1 stopSequence2", f"""SELECT 'overlapping_zone_and_pickup_drop_off_window' AS code, CAST(b._row AS BIGINT) AS csv_row, CAST(NULL AS VARCHAR) AS field, a.trip_id AS tripId,
    CAST(a.stop_sequence AS VARCHAR) AS stopSequence1, CAST(b.stop_sequence AS VARCHAR) AS stopSequence2
    FROM {_flex} a JOIN {_flex} b ON a.trip_id = b.trip_id AND (a.stop_sequence, a._row) < (b.stop_sequence, b._row)
        AND a.start_pickup_drop_off_window < b.end_pickup_drop_off_window AND b.start_pickup_drop_off_window < a.end_pickup_drop_off_window
    LEFT JOIN locations p ON p.location_id = a.location_id LEFT JOIN locations q ON q.location_id = b.location_id
    WHERE (coalesce(a.pickup_type, 0) = coalesce(b.pickup_type, 0) OR coalesce(a.drop_off_type, 0) = coalesce(b.drop_off_type, 0))
    AND (a.location_id = b.location_id OR a.location_group_id = b.location_group_id OR (p.minx <= q.maxx AND q.minx <= p.maxx AND p.miny <= q.maxy AND q.miny <= p.maxy))""")  # fmt: skip
_stops = "(SELECT stop_id, coalesce(location_type, 0) AS k, parent_station AS p FROM stops QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY _row DESC) = 1)"
add("rule_unreachable", "PathwayReachableLocationValidator", "stopId hasEntrance hasExit", "SELECT 1")
ORACLE_SQL["rule_unreachable"] = synth.with_views("SELECT 1 FROM stops, pathways").replace("WITH ", "WITH RECURSIVE ", 1).removesuffix("\nSELECT 1 FROM stops, pathways") + f""",
e AS (SELECT from_stop_id AS a, to_stop_id AS b FROM pathways UNION SELECT to_stop_id, from_stop_id FROM pathways
    WHERE is_bidirectional = 1), doors AS (SELECT DISTINCT stop_id AS id FROM stops WHERE location_type = 2),
ahead(id) AS (SELECT id FROM doors UNION SELECT b FROM ahead JOIN e ON a = id), back(id) AS (SELECT id FROM doors UNION SELECT a FROM back JOIN e ON b = id),
home AS (SELECT x.stop_id AS id, CASE WHEN x.k = 1 THEN x.stop_id WHEN y.k = 1 THEN y.stop_id WHEN z.k = 1 THEN z.stop_id END AS station FROM {_stops} x LEFT
    JOIN {_stops} y ON x.p = y.stop_id LEFT JOIN {_stops} z ON y.p = z.stop_id)
SELECT 'pathway_unreachable_location' AS code, CAST(_row AS BIGINT) AS csv_row, CAST(NULL AS VARCHAR) AS field, stop_id AS stopId, CAST(stop_id IN (SELECT id
    FROM ahead) AS VARCHAR) AS hasEntrance, CAST(stop_id IN (SELECT id FROM back) AS VARCHAR) AS hasExit
FROM stops JOIN home ON id = stop_id WHERE station IN (SELECT station FROM home WHERE station IS NOT NULL AND id IN ({_on})) AND (location_type IN (3, 4)
    OR coalesce(location_type, 0) = 0 AND stop_id NOT IN (SELECT parent_station FROM stops WHERE parent_station IS NOT NULL))
AND NOT (stop_id IN (SELECT id FROM ahead) AND stop_id IN (SELECT id FROM back))"""
_known = "'agency', 'stops', 'routes', 'trips', 'stop_times', 'calendar', 'feed_info'"
_tr = "(SELECT *, CASE WHEN table_name = 'feed_info' THEN 0 WHEN table_name = 'stop_times' THEN 2 ELSE 1 END AS arity FROM translations WHERE table_name IS NOT NULL AND language IS NOT NULL) t"
_use = f"field_value IS NULL AND table_name IN ({_known})"
add("rule_translations", "TranslationFieldAndReferenceValidator", "tableName", each("missing_required_field", "translations",
    {f: f"{f} IS NULL" for f in ("table_name", "language")}, tableName="NULL"),
    *[row("translation_unexpected_value", _tr, where, f"'{f}'", tableName="NULL") for f, least in (("record_id", 1), ("record_sub_id",
        2)) for where in (f"field_value IS NOT NULL AND {f} IS NOT NULL", f"{_use} AND arity < {least} AND {f} IS NOT NULL")],
    *[row("missing_required_field", _tr, f"{_use} AND arity >= {least} AND {f} IS NULL", f"'{f}'", tableName="NULL") for f, least in (("record_id", 1), ("record_sub_id", 2))],
    row("translation_unknown_table_name", _tr, f"table_name NOT IN ({_known})", tableName="table_name"),
    row("translation_foreign_key_violation", _tr, f"""{_use} AND (arity = 1 AND record_id IS NOT NULL AND record_sub_id IS NULL AND (table_name = 'agency' AND record_id NOT IN (SELECT agency_id FROM agency
        WHERE agency_id IS NOT NULL) OR table_name = 'routes' AND record_id NOT IN (SELECT route_id FROM routes))
    OR arity = 2 AND record_id IS NOT NULL AND record_sub_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stop_times s WHERE s.trip_id = t.record_id
        AND s.stop_sequence = TRY_CAST(t.record_sub_id AS BIGINT)))""", tableName="table_name"))  # fmt: skip
_speed = "CASE route_type WHEN 0 THEN 100 WHEN 1 THEN 150 WHEN 2 THEN 500 WHEN 3 THEN 150 WHEN 4 THEN 80 WHEN 5 THEN 30 WHEN 6 THEN 50 WHEN 7 THEN 50 ELSE 200 END"
_kph = "{km} / (CASE WHEN {a} - {d} <= 0 THEN 60 WHEN {d} % 60 = 0 AND {a} % 60 = 0 THEN {a} - {d} + 60 ELSE {a} - {d} END) * 3600"
add("rule_travel_speed", "StopTimeTravelSpeedValidator", "tripId csvRowNumber1 csvRowNumber2", "SELECT 1")
_front = synth.with_views("SELECT 1 FROM stops, stop_times, trips, routes").removesuffix("\nSELECT 1 FROM stops, stop_times, trips, routes")
ORACLE_SQL["rule_travel_speed"] = _front + f""",
tr AS MATERIALIZED (SELECT t.trip_id, t._row AS tr, t.route_id, {_speed} AS top FROM (SELECT * FROM trips QUALIFY row_number() OVER (PARTITION BY trip_id
    ORDER BY _row DESC) = 1) t JOIN (SELECT * FROM routes QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY _row DESC) = 1) r USING (route_id)),
pl AS MATERIALIZED {_at},
ok AS (SELECT stop_id FROM (SELECT * FROM stops QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY _row DESC) = 1) s WHERE coalesce(abs(stop_lat) <= 90, TRUE)
    AND coalesce(abs(stop_lon) <= 180, TRUE)),
c AS (SELECT s.trip_id, tr.tr, tr.top, s._row, s.stop_id, s.arrival_time AS a, s.departure_time AS d, row_number() OVER w AS i, coalesce(pl.at_.y, 0.0::DOUBLE)::DOUBLE AS y, coalesce(pl.at_.x, 0.0::DOUBLE)::DOUBLE AS x
    FROM stop_times s JOIN tr USING (trip_id) LEFT JOIN pl ON pl.stop_id = s.stop_id WINDOW w AS (PARTITION BY s.trip_id ORDER BY s.stop_sequence, s._row)),
l AS (SELECT *, lag(y) OVER w AS py, lag(x) OVER w AS px, lag(d) OVER w AS pd, lag(_row) OVER w AS pr, lag(stop_id) OVER w AS ps FROM c WINDOW w AS (PARTITION BY trip_id ORDER BY i)),
g AS MATERIALIZED (SELECT *, CASE WHEN i = 1 THEN 0 ELSE {haversine('py', 'px', 'y', 'x').replace('6371000.0', '6371.0')} END AS leg FROM l),
k AS MATERIALIZED (SELECT *, sum(leg) OVER (PARTITION BY trip_id ORDER BY i) AS km FROM g),
near AS (SELECT 'fast_travel_between_consecutive_stops' AS code, trip_id, tr, pr AS r1, _row AS r2, ps AS s1, stop_id AS s2 FROM g WHERE i > 1 AND pd IS NOT NULL
    AND a IS NOT NULL AND {_kph.format(km='leg', a='a', d='pd')} > top),
far AS (SELECT 'fast_travel_between_far_stops' AS code, p.trip_id, p.tr, p._row AS r1, q._row AS r2, p.stop_id AS s1, q.stop_id AS s2 FROM k p
    JOIN k q ON p.trip_id = q.trip_id AND p.i < q.i WHERE p.d IS NOT NULL AND q.a IS NOT NULL AND q.km - p.km > 10 AND {_kph.format(km='(q.km - p.km)', a='q.a', d='p.d')} > p.top
    QUALIFY row_number() OVER (PARTITION BY p.trip_id ORDER BY q.i, p.i DESC) = 1)
SELECT code, CAST(tr AS BIGINT) AS csv_row, CAST(NULL AS VARCHAR) AS field, trip_id AS tripId, CAST(r1 AS VARCHAR) AS csvRowNumber1, CAST(r2 AS VARCHAR) AS csvRowNumber2
    FROM (SELECT * FROM near UNION ALL SELECT * FROM far) z WHERE s1 IN (SELECT stop_id FROM ok) AND s2 IN (SELECT stop_id FROM ok)"""


# load and report analytics
def _analytic(name: str, make: Callable, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(synth.feed(spark, sf_dir))
    ORACLE_SQL[name] = synth.with_views(sql)


def _service_dates(feed):
    from .plans.service import service_dates

    return service_dates(feed, clamp=True)


def _counts(feed):
    from .sources.report import counts

    return counts(feed)


def _window_(feed):
    from .sources.report import service_window

    return service_window(feed).toDF("first_date", "last_date")


def _per_date(feed):
    from .operators.calendar import trips_per_date

    return trips_per_date(feed)


_analytic("service_dates", _service_dates, f"SELECT service_id, d AS date FROM {dates(True)} x")
_analytic("trips_per_date", _per_date, f"SELECT d AS date, n FROM {_per} x")
_analytic("feed_counts", _counts, " UNION ALL ".join(f"SELECT '{e}' AS entity, count(DISTINCT {k}) AS n FROM {t}" for e, t, k in (("Shapes", "shapes",
    "shape_id"), ("Stops", "stops", "stop_id"), ("Routes", "routes", "route_id"), ("Trips", "trips", "trip_id"), ("Blocks", "trips", "block_id"),
    ("Agencies", "agency", "agency_id"))))
_analytic("service_window", _window_, """
    , used AS (SELECT DISTINCT service_id FROM trips WHERE service_id IS NOT NULL),
    cal AS (SELECT service_id, arg_max(start_date, _row) AS a, arg_max(greatest(start_date, end_date), _row) AS z FROM calendar WHERE service_id IN (FROM used) GROUP BY 1),
    more AS (SELECT service_id, min(date) AS a, max(date) AS z FROM calendar_dates WHERE exception_type = 1 AND service_id IN (FROM used)
        AND service_id NOT IN (SELECT service_id FROM cal) GROUP BY 1),
    w AS (SELECT min(least(a, z)) AS a, max(greatest(a, z)) AS z FROM (FROM cal UNION ALL FROM more) x WHERE a IS NOT NULL AND z IS NOT NULL),
    gone AS (SELECT DISTINCT date FROM calendar_dates WHERE exception_type = 2 AND service_id IN (FROM used)),
    -- the first day from the start on that is not removed
    days AS (SELECT CAST(unnest(generate_series(a, z + 1, INTERVAL 1 DAY)) AS DATE) AS day FROM w)
    SELECT (SELECT min(day) FROM days WHERE day NOT IN (SELECT date FROM gone WHERE date <= (SELECT z FROM w))) AS first_date,
        CASE WHEN z IN (SELECT date FROM gone) THEN z - 1 ELSE z END AS last_date FROM w""".strip())


def notice_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by code and severity of some rules over stop_times, from one union of their plans."""
    feed = synth.feed(spark, sf_dir)
    names = ("TimepointTimeValidator", "StopTimesGeographyIdPresenceValidator", "MissingTripEdgeValidator")
    found = [run_rule(feed, all_rules()[n], synth.OPTIONS) for n in names]
    return found[0].unionAll(found[1]).unionAll(found[2]).groupBy("code", "severity").agg(F.count("*").alias("total"))


QUERIES["notice_rollup"] = notice_rollup
_parts = [ORACLE_SQL[n] for n in ("rule_timepoint", "rule_geography_presence", "rule_missing_trip_edge")]
ORACLE_SQL["notice_rollup"] = "SELECT code, CASE WHEN code = 'missing_timepoint_value' THEN 'WARNING' ELSE 'ERROR' END AS severity, count(*) AS total FROM (" + " UNION ALL ".join(f"SELECT code FROM ({p}) x" for p in _parts) + ") n GROUP BY 1"

# what the reader checks, sources, reports and streams
from . import load_queries, more_queries  # noqa: E402

QUERIES |= load_queries.QUERIES | more_queries.QUERIES
ORACLE_SQL |= load_queries.ORACLE_SQL | more_queries.ORACLE_SQL
ORACLE_SQL["notice_samples"] = more_queries.samples_sql([ORACLE_SQL[n] for n in ("rule_timepoint", "rule_missing_trip_edge")])

"""The feed model: tables, typed columns, keys and references."""

from __future__ import annotations

from dataclasses import dataclass

# Per table, columns in order; `!` required, `~` recommended, `-` not part of the header schema; `:kind` other than text.
_TABLES = {
    "agency": "agency_id agency_name! agency_url! agency_timezone! agency_lang~ agency_phone~ agency_fare_url~ agency_email~",
    "stops": "stop_id! stop_code stop_name~ tts_stop_name stop_desc~ stop_lat:double~ stop_lon:double~ zone_id stop_url~ location_type:enum parent_station stop_timezone "
    "wheelchair_boarding:enum~ level_id~ platform_code~ stop_address stop_city stop_region stop_postcode stop_country stop_phone signposted_as- vehicle_type:enum-",
    "routes": "route_id! agency_id route_short_name~ route_long_name~ route_desc~ route_type:enum! route_url~ route_color:color~ route_text_color:color~ route_sort_order:int "
    "continuous_pickup:enum continuous_drop_off:enum network_id route_branding_url checkin_duration:int-",
    "trips": "route_id! service_id! trip_id! trip_headsign~ trip_short_name~ direction_id:enum~ block_id~ shape_id~ wheelchair_accessible:enum~ bikes_allowed:enum~ "
    "continuous_pickup:enum continuous_drop_off:enum",
    "stop_times": "trip_id! arrival_time:time~ departure_time:time~ stop_id location_group_id location_id stop_sequence:int! stop_headsign~ pickup_type:enum~ drop_off_type:enum~ "
    "pickup_booking_rule_id drop_off_booking_rule_id continuous_pickup:enum continuous_drop_off:enum shape_dist_traveled:double~ timepoint:enum~ "
    "start_pickup_drop_off_window:time end_pickup_drop_off_window:time stop_direction_name-",
    "calendar": "service_id! monday:enum! tuesday:enum! wednesday:enum! thursday:enum! friday:enum! saturday:enum! sunday:enum! start_date:date! end_date:date!",
    "calendar_dates": "service_id! date:date! exception_type:enum!",
    "fare_attributes": "fare_id! price:double! currency_type! payment_method:enum! transfers:enum agency_id transfer_duration:int ic_price:double-",
    "fare_rules": "fare_id! route_id origin_id destination_id contains_id contains_route_id-",
    "shapes": "shape_id! shape_pt_lat:double! shape_pt_lon:double! shape_pt_sequence:int! shape_dist_traveled:double",
    "frequencies": "trip_id! start_time:time! end_time:time! headway_secs:int! exact_times:enum",
    "transfers": "from_stop_id to_stop_id transfer_type:enum min_transfer_time:int from_route_id to_route_id from_trip_id to_trip_id",
    "pathways": "pathway_id! from_stop_id! to_stop_id! pathway_mode:enum! is_bidirectional:enum! length:double traversal_time:int stair_count:int max_slope:double min_width:double "
    "signposted_as reversed_signposted_as",
    "feed_info": "feed_publisher_name! feed_publisher_url! feed_lang! feed_start_date:date~ feed_end_date:date~ feed_version~ feed_contact_email feed_contact_url default_lang",
    "attributions": "attribution_id agency_id route_id trip_id organization_name! is_producer:enum is_operator:enum is_authority:enum attribution_url attribution_email attribution_phone",
    "levels": "level_id! level_index:double! level_name",
    "translations": "table_name! field_name! language! translation! record_id record_sub_id field_value",
    "fare_media": "fare_media_id! fare_media_name fare_media_type:enum!",
    "fare_products": "fare_product_id! fare_product_name amount:double! currency! fare_media_id rider_category_id",
    "fare_leg_rules": "leg_group_id network_id from_area_id to_area_id from_timeframe_group_id to_timeframe_group_id fare_product_id! rule_priority:int",
    "fare_transfer_rules": "from_leg_group_id to_leg_group_id duration_limit:int duration_limit_type:enum fare_transfer_type:enum! transfer_count:int fare_product_id",
    "fare_leg_join_rules": "from_network_id! to_network_id! from_stop_id to_stop_id from_area_id to_area_id",
    "areas": "area_id! area_name",
    "stop_areas": "area_id! stop_id!",
    "timeframes": "timeframe_group_id start_time:time end_time:time service_id!",
    "rider_categories": "rider_category_id! rider_category_name! is_default_fare_category:enum! eligibility_url",
    "location_groups": "location_group_id! location_group_name location_group_desc-",
    "location_group_stops": "location_group_id! stop_id!",
    "networks": "network_id! network_name",
    "route_networks": "route_id! network_id!",
    "booking_rules": "booking_rule_id! booking_type:enum! prior_notice_duration_min:int prior_notice_duration_max:int prior_notice_last_day:int prior_notice_last_time:time "
    "prior_notice_start_day:int prior_notice_start_time:time prior_notice_service_id message pickup_message drop_off_message phone_number info_url booking_url",
}

SPARK_TYPE = {"text": "string", "double": "double", "int": "long", "enum": "int", "date": "date", "time": "int", "color": "int"}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    required: bool
    recommended: bool
    listed: bool


def _column(token: str) -> Column:
    mark = token[-1] if token[-1] in "!~-" else ""
    name, _, kind = token.removesuffix(mark).partition(":")
    return Column(name, kind or "text", mark == "!", mark == "~", mark != "-")


TABLES: dict[str, list[Column]] = {t: [_column(c) for c in spec.split()] for t, spec in _TABLES.items()}
REQUIRED_TABLES = ("agency", "stops", "routes", "trips", "stop_times")
GEOJSON = "locations.geojson"
OPTIONAL_KINDS = {"transfers"}


def file_of(table: str) -> str:
    return GEOJSON if table == "locations" else f"{table}.txt"


# Child table, child columns, parent table, parent column.
_EDGES = """
stop_times trip_id trips trip_id
stop_times stop_id stops stop_id
stop_times location_group_id location_groups location_group_id
stop_times pickup_booking_rule_id,drop_off_booking_rule_id booking_rules booking_rule_id
trips route_id routes route_id
trips shape_id shapes shape_id
routes agency_id agency agency_id
stops parent_station stops stop_id
stops level_id levels level_id
fare_products fare_media_id fare_media fare_media_id
fare_products rider_category_id rider_categories rider_category_id
fare_leg_rules fare_product_id fare_products fare_product_id
fare_leg_rules from_area_id,to_area_id areas area_id
fare_leg_rules from_timeframe_group_id,to_timeframe_group_id timeframes timeframe_group_id
fare_transfer_rules from_leg_group_id,to_leg_group_id fare_leg_rules leg_group_id
fare_transfer_rules fare_product_id fare_products fare_product_id
stop_areas area_id areas area_id
stop_areas stop_id stops stop_id
fare_leg_join_rules from_stop_id,to_stop_id stops stop_id
fare_leg_join_rules from_area_id,to_area_id areas area_id
route_networks route_id routes route_id
route_networks network_id networks network_id
location_group_stops location_group_id location_groups location_group_id
location_group_stops stop_id stops stop_id
transfers from_stop_id,to_stop_id stops stop_id
transfers from_route_id,to_route_id routes route_id
transfers from_trip_id,to_trip_id trips trip_id
fare_rules fare_id fare_attributes fare_id
fare_rules route_id routes route_id
fare_rules origin_id,destination_id,contains_id stops zone_id
fare_attributes agency_id agency agency_id
frequencies trip_id trips trip_id
pathways from_stop_id,to_stop_id stops stop_id
attributions agency_id agency agency_id
attributions route_id routes route_id
attributions trip_id trips trip_id
"""
EDGES: list[tuple[str, str, str, str]] = [(c, f, p, k) for line in _EDGES.split("\n") if line for c, fs, p, k in [line.split()] for f in fs.split(",")]

# Tables whose single key must be unique.
UNIQUE = {
    "agency": "agency_id", "stops": "stop_id", "routes": "route_id", "trips": "trip_id", "calendar": "service_id", "fare_attributes": "fare_id", "fare_media": "fare_media_id",
    "areas": "area_id", "levels": "level_id", "pathways": "pathway_id", "location_groups": "location_group_id", "booking_rules": "booking_rule_id", "networks": "network_id",
    "rider_categories": "rider_category_id",
}

# Fields that thorough mode finds blank.
_REQUIRED = """
agency agency_name,agency_url,agency_timezone
stops stop_id
routes route_id
trips route_id,service_id,trip_id
stop_times trip_id
calendar service_id
calendar_dates service_id
fare_attributes fare_id,currency_type
fare_rules fare_id
booking_rules booking_rule_id
fare_media fare_media_id
fare_products fare_product_id,currency
fare_leg_rules fare_product_id
fare_leg_join_rules from_network_id,to_network_id
shapes shape_id
frequencies trip_id
feed_info feed_publisher_name,feed_publisher_url,feed_lang
attributions organization_name
levels level_id
pathways pathway_id,from_stop_id,to_stop_id
areas area_id
stop_areas area_id,stop_id
timeframes service_id
rider_categories rider_category_id,rider_category_name
networks network_id
route_networks route_id,network_id
translations language,translation
location_groups location_group_id
location_group_stops location_group_id,stop_id
"""
REQUIRED_FIELDS = {t: fs.split(",") for line in _REQUIRED.split("\n") if line for t, fs in [line.split()]}

# Tables that translations may name, with the columns that identify a row.
TRANSLATED = {
    "feed_info": (), "stop_times": ("trip_id", "stop_sequence"), "calendar_dates": ("service_id", "date"), "shapes": ("shape_id", "shape_pt_sequence"),
    "frequencies": ("trip_id", "start_time"), "transfers": ("from_stop_id", "to_stop_id"), "agency": ("agency_id",), "stops": ("stop_id",), "routes": ("route_id",),
    "trips": ("trip_id",), "calendar": ("service_id",), "fare_attributes": ("fare_id",), "levels": ("level_id",), "pathways": ("pathway_id",), "attributions": ("attribution_id",),
    "areas": ("area_id",), "fare_media": ("fare_media_id",), "rider_categories": ("rider_category_id",), "location_groups": ("location_group_id",), "networks": ("network_id",),
    "route_networks": ("route_id",),
}

# Fastest km/h by route type, and for all others.
MAX_SPEED = {0: 100, 2: 500, 1: 150, 12: 150, 3: 150, 11: 150, 4: 80, 5: 30, 6: 50, 7: 50}
MAX_SPEED_OTHER = 200

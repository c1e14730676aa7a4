"""Feed-shaped tables projected from a star schema, in SQL text that Spark and DuckDB both run.

`{name}` stands for a source table. Orphans, blanks, repeats and odd values come from arithmetic on keys, so that every rule has
something to find. `_row` of a table is unique and follows its keys.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession

from .feed import Feed, RunOptions, complete
from .model import TABLES

OPTIONS = RunOptions(date=dt.date(2025, 1, 1), google=True, thorough=True)

VIEWS: dict[str, str] = {
    "agency": """
        SELECT n_nationkey + 2 AS _row, CASE WHEN n_nationkey % 12 = 11 THEN NULL ELSE 'A' || CAST(n_nationkey - CASE WHEN n_nationkey % 20 = 19 THEN 1 ELSE 0 END AS STRING) END AS agency_id,
            n_name AS agency_name, 'http://a' || CAST(n_nationkey AS STRING) || '.example.com' AS agency_url,
            CASE WHEN n_regionkey = 0 THEN 'Europe/Paris' ELSE 'America/New_York' END AS agency_timezone,
            CASE WHEN n_regionkey = 1 THEN NULL WHEN n_regionkey = 2 THEN 'FR ' ELSE 'en' END AS agency_lang,
            CASE WHEN n_nationkey % 3 = 0 THEN '12-3' ELSE '+1 555 123' END AS agency_phone FROM {nation}""",
    "routes": """
        SELECT c_custkey + 2 AS _row, CASE WHEN c_custkey % 61 = 0 THEN 'RX' ELSE 'R' END || CAST(c_custkey - CASE WHEN c_custkey % 150 = 149 THEN 1 ELSE 0 END AS STRING) AS route_id,
            CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 97 = 0 THEN 'A99'
                 ELSE 'A' || CAST(c_nationkey + CASE WHEN c_nationkey % 9 = 4 THEN 1 ELSE 0 END AS STRING) END AS agency_id,
            CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE substring(c_mktsegment, 1, 3 + CAST(c_custkey % 12 AS INT)) || CASE WHEN c_custkey % 13 = 0 THEN 'abcdefgh' ELSE '' END END AS route_short_name,
            CASE WHEN c_custkey % 40 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN lower(substring(c_mktsegment, 1, 3 + CAST(c_custkey % 12 AS INT))) || ' - line'
                 WHEN c_custkey % 5 = 0 THEN 'Line ' || c_mktsegment ELSE c_name END AS route_long_name,
            CASE WHEN c_custkey % 11 = 0 THEN upper(c_name) WHEN c_custkey % 17 = 0 THEN substring(c_mktsegment, 1, 3 + CAST(c_custkey % 12 AS INT)) END AS route_desc,
            CAST(c_custkey % 8 AS INT) AS route_type,
            CASE WHEN c_custkey % 15 = 0 THEN 'HTTP://A' || CAST(c_nationkey AS STRING) || '.example.com ' WHEN c_custkey % 9 = 0 THEN 'not a url' ELSE 'http://r' ||
                CAST(c_custkey AS STRING) || '.example.com' END AS route_url,
            CAST(c_custkey * 7919 % 16777216 AS INT) AS route_color, CAST(c_custkey * 104729 % 16777216 AS INT) AS route_text_color,
            CASE WHEN c_custkey % 6 < 4 THEN CAST(c_custkey % 6 AS INT) END AS continuous_pickup, CASE WHEN c_custkey % 10 = 3 THEN 1 END AS continuous_drop_off,
            CASE WHEN c_custkey % 4 = 0 THEN 'N' || CAST(c_custkey % 10 AS STRING) END AS network_id FROM {customer}""",
    "stops": """
        SELECT p_partkey + 2 AS _row, 'S' || CAST(p_partkey - CASE WHEN p_partkey % 199 = 198 THEN 1 ELSE 0 END AS STRING) AS stop_id,
            CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_name END AS stop_name, CASE WHEN p_partkey % 50 = 3 THEN lower(p_name) END AS tts_stop_name, CASE WHEN p_partkey % 17 = 0 THEN upper(p_name) ELSE p_type END AS stop_desc,
            CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 101 = 0 THEN 0.5 WHEN p_partkey % 211 = 0 THEN 95.0 WHEN p_partkey % 157 = 0 THEN 89.5
                ELSE 40 + (p_partkey % 1000) * 0.01 END AS stop_lat,
            CASE WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 101 = 0 THEN 0.5 ELSE -74 + p_size * 0.02 END AS stop_lon,
            CASE WHEN p_partkey % 3 = 0 THEN 'Z' || CAST(p_partkey % 20 AS STRING) END AS zone_id,
            CASE WHEN p_partkey % 29 = 0 THEN 'http://a' || CAST(p_partkey % 25 AS STRING) || '.example.com' WHEN p_partkey % 31 = 1 THEN 'http://' WHEN p_partkey % 37 = 1 THEN 'http://a b.example.com/x' WHEN p_partkey % 41 = 1 THEN 'mailto:x@example.com'
                 WHEN p_partkey % 59 = 1 THEN 'www.example.com/a' WHEN p_partkey % 61 = 1 THEN 'https:e.example.com?q=a b' WHEN p_partkey % 67 = 1 THEN '1http://e.example.com' WHEN p_partkey % 43 = 0 THEN 'http://R' ||
                CAST(p_partkey % 150 AS STRING) || '.example.com' END AS stop_url,
            CASE CAST(p_partkey % 10 AS INT) WHEN 0 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 6 THEN 4 WHEN 7 THEN NULL ELSE 0 END AS location_type,
            CASE WHEN p_partkey % 97 = 0 THEN 'S9999999' WHEN p_partkey % 130 = 0 THEN 'S10' WHEN p_partkey % 89 = 0 THEN NULL WHEN p_partkey % 10 = 6 THEN 'S' || CAST(p_partkey - 1 AS STRING)
                 WHEN p_partkey % 10 IN (3, 4, 5) THEN 'S' || CAST(p_partkey - p_partkey % 10 AS STRING) END AS parent_station,
            CASE WHEN p_partkey % 4 = 0 THEN 'L' || CAST(p_partkey % 7 AS STRING) END AS level_id, CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size AS STRING) END AS platform_code FROM {part}""",
    "trips": """
        SELECT o_orderkey + 2 AS _row, CASE WHEN o_orderkey % 97 = 0 THEN 'R1' WHEN o_orderkey % 89 = 0 THEN 'R9999999' ELSE 'R' || CAST(o_custkey AS STRING) END AS route_id,
            CASE WHEN o_orderkey % 97 = 0 THEN 'V1' WHEN o_orderkey % 83 = 0 THEN 'none' ELSE 'V' || CAST(o_orderkey % 40 AS STRING) END AS service_id,
            'T' || CAST(o_orderkey - CASE WHEN o_orderkey % 500 = 499 THEN 1 ELSE 0 END AS STRING) AS trip_id, CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE
                CAST(o_orderkey % 2 AS INT) END AS direction_id,
            CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 97 > 0 THEN 'B' || CAST(o_custkey AS STRING) END AS block_id,
            CASE WHEN o_orderkey % 5 < 2 AND o_orderkey % 97 > 0 THEN 'H' || CAST(o_orderkey % 210 AS STRING) END AS shape_id, CASE WHEN o_orderkey % 7 < 4 THEN
                CAST(o_orderkey % 7 AS INT) END AS bikes_allowed FROM {orders}""",
    "stop_times": """
        SELECT l_orderkey * 64 + n AS _row, CASE WHEN l_orderkey % 977 = 0 THEN 'T9999999' ELSE 'T' || CAST(l_orderkey AS STRING) END AS trip_id,
            CASE WHEN l_orderkey % 97 = 0 THEN 21600 + n * 600 WHEN n % 5 = 4 OR (n = 1 AND l_orderkey % 9 = 0) THEN NULL ELSE 21600 + n * 600 +
                CAST(l_partkey % 7 AS INT) * 60 - CASE WHEN l_suppkey % 11 = 0 THEN 1500 ELSE 0 END END AS arrival_time,
            CASE WHEN l_orderkey % 97 = 0 THEN 21600 + n * 600 WHEN n % 5 = 4 AND l_partkey % 2 = 0 THEN NULL ELSE 21600 + n * 600 + CAST(l_partkey % 5 AS INT) * 90 END AS departure_time,
            CASE WHEN l_orderkey % 97 = 0 THEN 'S' || CAST(n AS STRING) WHEN l_partkey % 61 = 0 THEN NULL WHEN l_partkey % 103 = 0 THEN 'S9999999' ELSE 'S' || CAST(l_partkey AS STRING) END AS stop_id,
            CASE WHEN l_partkey % 53 = 0 THEN 'G' || CAST(l_partkey % 9 AS STRING) END AS location_group_id, CASE WHEN l_partkey % 67 = 0
                OR l_suppkey % 35 = 2 THEN 'P' || CAST(l_partkey % 7 AS STRING) END AS location_id,
            CAST(l_linenumber AS BIGINT) AS stop_sequence, CASE WHEN l_partkey % 71 = 0 THEN 'To * Town' WHEN l_partkey % 2 = 0 THEN 'Town' END AS stop_headsign,
            CASE WHEN l_suppkey % 5 < 4 THEN CAST(l_suppkey % 5 AS INT) END AS pickup_type, CASE WHEN l_suppkey % 7 < 4 THEN CAST(l_suppkey % 7 AS INT) END AS drop_off_type,
            CASE WHEN l_partkey % 41 = 0 THEN 'K' || CAST(l_partkey % 30 AS STRING) END AS pickup_booking_rule_id,
            CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE floor(l_extendedprice / 100) + n * 100 END AS shape_dist_traveled, CASE WHEN l_partkey % 3 < 2 THEN CAST(l_partkey % 3 AS INT) END AS timepoint,
            CASE WHEN l_partkey % 47 = 0 OR l_suppkey % 35 = 2 THEN 30000 + n * 60 END AS start_pickup_drop_off_window, CASE WHEN (l_partkey % 47 = 0
                OR l_suppkey % 35 = 2) AND l_suppkey % 3 < 2 THEN 30600 - CAST(l_suppkey % 3 AS INT) * 3000 END AS end_pickup_drop_off_window
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS INT) AS n FROM {lineitem}) x""",
    "calendar": """
        SELECT s_suppkey + 2 AS _row, 'V' || CAST(s_suppkey % 36 AS STRING) AS service_id, CAST(s_suppkey % 2 AS INT) AS monday, 1 AS tuesday,
            CAST(s_suppkey % 3 % 2 AS INT) AS wednesday, 0 AS thursday, 1 AS friday,
            CAST(s_suppkey % 5 % 2 AS INT) AS saturday, 0 AS sunday, DATE '2024-01-01' + CAST(CASE WHEN s_suppkey % 90 = 89 THEN 900 ELSE s_suppkey % 300 END AS INT) AS start_date,
            DATE '2024-01-01' + CAST(CASE WHEN s_suppkey % 90 = 89 THEN 930 WHEN s_suppkey % 36 = 5 THEN 100 + s_suppkey % 60 ELSE s_suppkey * 7 % 400 - 5 END AS INT) AS end_date FROM {supplier}""",
    "calendar_dates": """
        SELECT event_id + 2 AS _row, 'V' || CAST(CASE WHEN user_id % 44 = 5 THEN 43 ELSE user_id % 44 END AS STRING) AS service_id, DATE '2024-02-01' +
            CAST(event_id * 31 % 420 AS INT) AS date, CAST(1 + event_id % 3 % 2 AS INT) AS exception_type
        FROM {events}""",
    "shapes": """
        SELECT p_partkey + 2 AS _row, 'H' || CAST(CASE WHEN p_partkey % 401 = 0 THEN p_partkey + 500 ELSE p_partkey % 190 END AS STRING) AS shape_id,
            CASE WHEN p_partkey % 211 = 0 THEN 0.2 ELSE 40 + (p_partkey % 190) * 0.01 + CAST(CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size END AS DOUBLE) * 0.0001 END AS shape_pt_lat,
            CASE WHEN p_partkey % 211 = 0 THEN 0.2 ELSE -74 + p_size * 0.02 END AS shape_pt_lon, CAST(floor(p_partkey / 190) AS BIGINT) AS shape_pt_sequence,
            CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_size % 7 * 50 AS DOUBLE) END AS shape_dist_traveled FROM {part}""",
    "frequencies": """
        SELECT event_id + 2 AS _row, CASE WHEN event_id % 91 = 0 THEN 'T9999999' ELSE 'T' || CAST(1 + user_id % 1000 AS STRING) END AS trip_id, CAST(event_id * 37 % 86400 AS INT) AS start_time,
            CAST(CASE WHEN event_id % 33 = 0 THEN event_id * 37 % 86400
                ELSE event_id * 37 % 86400 + event_id % 7200 - 300 END AS INT) AS end_time, event_id % 5000 + 1 AS headway_secs FROM {events}""",
    "timeframes": """
        SELECT event_id + 2 AS _row, 'F' || CAST(user_id % 50 AS STRING) AS timeframe_group_id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(event_id * 13 % 87000 AS INT) END AS start_time,
            CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(event_id * 13 % 87000 + 600 AS INT) END AS end_time, 'V' || CAST(event_id % 47 AS STRING) AS service_id FROM {events}""",
    "transfers": """
        SELECT event_id + 2 AS _row, CASE WHEN event_id % 27 = 0 THEN NULL ELSE 'S' || CAST(1 + event_id * 7 % 2300 AS STRING) END AS from_stop_id, CASE
            WHEN event_id % 26 = 0 THEN NULL ELSE 'S' || CAST(1 + event_id * 7 % 2300 + event_id % 9 AS STRING) END AS to_stop_id,
            CAST(event_id % 7 AS INT) AS transfer_type, CASE WHEN event_id % 3 = 0 THEN 60 END AS min_transfer_time, CASE WHEN event_id % 6 = 0 THEN 'R' ||
                CAST(1 + event_id % 170 AS STRING) END AS from_route_id,
            CAST(NULL AS STRING) AS to_route_id, CASE WHEN event_id % 4 = 0 THEN 'T' || CAST(1 + event_id % 1600 AS STRING) END AS from_trip_id, CASE
                WHEN event_id % 9 = 4 THEN 'T' || CAST(1 + event_id % 1500 AS STRING) END AS to_trip_id
        FROM {events}""",
    "pathways": """
        SELECT p_partkey + 2 AS _row, 'W' || CAST(p_partkey % 450 AS STRING) AS pathway_id, 'S' || CAST(p_partkey AS STRING) AS from_stop_id, 'S' || CAST(CASE
            WHEN p_partkey % 50 = 0 THEN p_partkey ELSE p_partkey + p_size % 3 + 1 END AS STRING) AS to_stop_id,
            CAST(1 + p_size % 7 AS INT) AS pathway_mode, CAST(p_size % 2 AS INT) AS is_bidirectional, CASE WHEN p_size % 4 = 0 THEN 12.5 END AS length, CASE
                WHEN p_size % 5 = 0 THEN p_size % 10 END AS traversal_time,
            CASE WHEN p_size % 3 = 0 THEN 10 END AS stair_count FROM {part}""",
    "levels": "SELECT n_nationkey + 2 AS _row, 'L' || CAST(n_nationkey % 6 AS STRING) AS level_id, CAST(n_nationkey AS DOUBLE) AS level_index FROM {nation}",
    "fare_attributes": """
        SELECT c_custkey + 2 AS _row, 'E' || CAST(c_custkey % 90 AS STRING) AS fare_id, c_acctbal AS price, CASE WHEN c_custkey % 25 = 0 THEN NULL ELSE 'USD' END AS currency_type, 0 AS payment_method,
            CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'A' || CAST(c_nationkey + 3 AS STRING) END AS agency_id, CASE WHEN c_custkey % 8 = 0 THEN -2.0
                WHEN c_custkey % 8 = 1 THEN -1.0 END AS ic_price FROM {customer}""",
    "fare_rules": """
        SELECT c_custkey + 2 AS _row, 'E' || CAST(c_custkey % 95 AS STRING) AS fare_id, CASE WHEN c_custkey % 3 < 2 THEN 'R' || CAST(c_custkey % 151 AS STRING) END AS route_id,
            CASE WHEN c_custkey % 4 = 0 THEN 'Z' || CAST(c_custkey % 24 AS STRING) END AS origin_id FROM {customer}""",
    "fare_media": "SELECT n_nationkey + 2 AS _row, 'M' || CAST(n_nationkey AS STRING) AS fare_media_id, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'Card ' || "
    "CAST(n_nationkey % 4 AS STRING) END AS fare_media_name, CAST(n_nationkey % 5 AS INT) AS fare_media_type FROM {nation}",
    "fare_products": """
        SELECT s_suppkey + 2 AS _row, 'D' || CAST(s_suppkey % 60 AS STRING) AS fare_product_id, s_acctbal AS amount, 'USD' AS currency, CASE
            WHEN s_suppkey % 3 = 0 THEN 'M' || CAST(s_suppkey % 30 AS STRING) END AS fare_media_id,
            'C' || CAST(s_suppkey % 8 AS STRING) AS rider_category_id FROM {supplier}""",
    "rider_categories": "SELECT r_regionkey + 2 AS _row, 'C' || CAST(r_regionkey AS STRING) AS rider_category_id, r_name AS rider_category_name, "
    "CAST(r_regionkey % 2 AS INT) AS is_default_fare_category FROM {region}",
    "fare_leg_rules": """
        SELECT s_suppkey + 2 AS _row, 'X' || CAST(s_suppkey % 20 AS STRING) AS leg_group_id, CASE WHEN s_suppkey % 4 = 0 THEN 'N' ||
            CAST(s_suppkey % 14 AS STRING) END AS network_id, 'Y' || CAST(s_suppkey % 30 AS STRING) AS from_area_id,
            'F' || CAST(s_suppkey % 60 AS STRING) AS from_timeframe_group_id, 'D' || CAST(s_suppkey % 66 AS STRING) AS fare_product_id FROM {supplier}""",
    "fare_transfer_rules": """
        SELECT s_suppkey + 2 AS _row, 'X' || CAST(s_suppkey % 22 AS STRING) AS from_leg_group_id, 'X' || CAST(s_suppkey % 11 AS STRING) AS to_leg_group_id, CASE
            WHEN s_suppkey % 3 = 0 THEN s_suppkey % 7 - 1 END AS duration_limit,
            CASE WHEN s_suppkey % 5 = 0 THEN 1 END AS duration_limit_type, 0 AS fare_transfer_type, CASE WHEN s_suppkey % 4 < 3 THEN s_suppkey % 5 - 2 END AS transfer_count FROM {supplier}""",
    "fare_leg_join_rules": "SELECT n_nationkey + 2 AS _row, 'N' || CAST(n_nationkey AS STRING) AS from_network_id, 'N' || CAST(n_nationkey % 4 AS STRING) AS to_network_id, CASE "
    "WHEN n_nationkey % 3 = 0 THEN 'S1' END AS from_stop_id, CASE WHEN n_nationkey % 4 = 0 THEN 'S2' END AS to_stop_id, 'Y' || "
    "CAST(n_nationkey AS STRING) AS from_area_id FROM {nation}",
    "areas": "SELECT n_nationkey + 2 AS _row, 'Y' || CAST(n_nationkey % 22 AS STRING) AS area_id FROM {nation}",
    "stop_areas": "SELECT p_partkey + 2 AS _row, 'Y' || CAST(p_size AS STRING) AS area_id, 'S' || CAST(p_partkey + 3 AS STRING) AS stop_id FROM {part}",
    "networks": "SELECT n_nationkey + 2 AS _row, 'N' || CAST(n_nationkey % 12 AS STRING) AS network_id FROM {nation}",
    "route_networks": "SELECT c_custkey + 2 AS _row, 'R' || CAST(c_custkey + 5 AS STRING) AS route_id, 'N' || CAST(c_custkey % 15 AS STRING) AS network_id FROM {customer}",
    "location_groups": "SELECT n_nationkey + 2 AS _row, 'G' || CAST(n_nationkey % 8 AS STRING) AS location_group_id FROM {nation}",
    "location_group_stops": "SELECT p_partkey + 2 AS _row, CASE WHEN p_partkey % 77 = 0 THEN 'S' || CAST(p_partkey AS STRING) ELSE 'G' || "
    "CAST(p_partkey % 9 AS STRING) END AS location_group_id, 'S' || CAST(p_partkey + 1 AS STRING) AS stop_id FROM {part}",
    "booking_rules": """
        SELECT s_suppkey + 2 AS _row, 'K' || CAST(s_suppkey % 28 AS STRING) AS booking_rule_id, CAST(s_suppkey % 3 AS INT) AS booking_type, CASE
            WHEN s_suppkey % 4 < 2 THEN s_suppkey % 50 END AS prior_notice_duration_min,
            CASE WHEN s_suppkey % 5 < 2 THEN 20 END AS prior_notice_duration_max, CASE WHEN s_suppkey % 7 < 3 THEN s_suppkey % 9 END AS prior_notice_last_day, CASE
                WHEN s_suppkey % 6 = 1 THEN 36000 END AS prior_notice_last_time,
            CASE WHEN s_suppkey % 8 < 3 THEN 4 END AS prior_notice_start_day, CASE WHEN s_suppkey % 9 < 3 THEN 32400 END AS prior_notice_start_time FROM {supplier}""",
    "attributions": "SELECT s_suppkey + 2 AS _row, 'Q' || CAST(s_suppkey AS STRING) AS attribution_id, 'A' || "
    "CAST(s_suppkey % 30 AS STRING) AS agency_id, s_name AS organization_name, CAST(s_suppkey % 3 % 2 AS INT) AS is_producer, CASE "
    "WHEN s_suppkey % 4 = 0 THEN 1 END AS is_operator FROM {supplier}",
    "feed_info": "SELECT r_regionkey + 2 AS _row, r_name AS feed_publisher_name, CASE WHEN r_regionkey = 3 THEN 'x y' "
    "ELSE 'http://f.example.com' END AS feed_publisher_url, 'en' AS feed_lang, CASE WHEN r_regionkey = 1 THEN NULL ELSE DATE '2024-12-20' + "
    "CAST(r_regionkey * 9 AS INT) END AS feed_start_date, CASE WHEN r_regionkey = 2 THEN NULL ELSE DATE '2025-01-05' + "
    "CAST(r_regionkey * 5 AS INT) END AS feed_end_date, CASE WHEN r_regionkey = 0 THEN 'm@f.example.com' END AS feed_contact_email FROM {region}",
    "translations": """
        SELECT n_nationkey + 2 AS _row, CASE CAST(n_nationkey % 6 AS INT) WHEN 0 THEN 'agency' WHEN 1 THEN 'routes' WHEN 2 THEN 'stop_times' WHEN 3 THEN 'nothing'
            WHEN 4 THEN 'feed_info' END AS table_name, 'name' AS field_name,
            CASE WHEN n_nationkey % 11 = 10 THEN NULL ELSE 'fr' END AS language, n_name AS translation, CASE WHEN n_nationkey % 6 = 0 THEN 'A' ||
                CAST(n_nationkey * 2 AS STRING) WHEN n_nationkey % 6 = 1 THEN 'R' || CAST(n_nationkey AS STRING) WHEN n_nationkey % 4 < 2 THEN 'T1' END AS record_id,
            CASE WHEN n_nationkey % 6 = 2 THEN CAST(n_nationkey % 4 AS STRING) END AS record_sub_id, CASE WHEN n_nationkey % 5 = 4 THEN 'x' END AS field_value FROM {nation}""",
    "locations": "SELECT 'P' || CAST(r_regionkey AS STRING) AS location_id, CAST(r_regionkey AS INT) AS feature_index, 'Polygon' AS geom_type, "
    "CAST(r_regionkey AS DOUBLE) AS minx, 0.0e0 AS miny, r_regionkey + 1.5e0 AS maxx, 1.0e0 AS maxy FROM {region}",
}


#: A second feed, for rules about files and tables that the first one has: absent files, and tables without rows or even a header.
BARE_ABSENT = ("calendar", "calendar_dates", "feed_info", "locations")
BARE_EMPTY = ("agency", "trips", "stops")
BARE_HEADLESS = ("stops",)


def view(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One projected table."""
    sources = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in set(re.findall(r"\{(\w+)\}", VIEWS[table]))}
    return spark.sql(VIEWS[table], **sources)


class Projected(dict):
    """Tables made when they are first asked for, so that a query plans only what it reads."""

    def __init__(self, spark: SparkSession, sf_dir: str, bare: bool = False):
        super().__init__()
        self.spark, self.sf_dir, self.bare = spark, sf_dir, bare

    def __contains__(self, table: object) -> bool:
        return table in VIEWS and not (self.bare and table in BARE_ABSENT)

    def __missing__(self, table: str) -> DataFrame:
        if table not in self:
            raise KeyError(table)
        df = view(self.spark, self.sf_dir, table)
        if self.bare and table in BARE_EMPTY:
            df = self.spark.createDataFrame([], df.schema)
        self[table] = df if table == "locations" else complete(df, table)
        return self[table]


def feed(spark: SparkSession, sf_dir: str, bare: bool = False) -> Feed:
    headers = {t: [c.name for c in TABLES[t] if f" {c.name}" in sql] for t, sql in VIEWS.items() if t != "locations"}
    if bare:
        headers = {t: [] if t in BARE_HEADLESS else names for t, names in headers.items() if t not in BARE_ABSENT}
    return Feed(spark, Projected(spark, sf_dir, bare), headers)


def with_views(sql: str, bare: bool = False) -> str:
    """DuckDB SQL that reads projected tables by name, with the projections in front. `catalog(name, has_header, n)` lists the files of a feed."""
    plain = {t: re.sub(r"[{}]", "", VIEWS[t]) for t in VIEWS if re.search(rf"\b{t}\b", sql) or "catalog" in sql}
    if "catalog" in sql:
        files = [t for t in plain if not (bare and t in BARE_ABSENT)]
        one = "SELECT '{0}' AS name, {1} AS has_header, {2} AS n"
        rows = [one.format(t, not (bare and t in BARE_HEADLESS), 0 if bare and t in BARE_EMPTY else f"(SELECT count(*) FROM {t})") for t in files]
        plain["catalog"] = " UNION ALL ".join(rows)
    return "WITH " + ",\n".join(f"{t} AS ({v})" for t, v in plain.items()) + ("" if sql.startswith(",") else "\n") + sql

"""Queries for sources, report analytics and streams, and the same in DuckDB SQL."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import synth
from .feed import RunOptions
from .functions.checkpoint import shared_dir
from .functions.workers import importable
from .operators import all_rules, index
from .plans.runner import run_rule
from .sources import report
from .sources.feed import local, read_feed
from .sources.table import read_table
from .streaming import sessions
from .streaming.changes import CHANGES, follow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# a small table as CSV text, given as the bytes of a zip
AGENCY = ("SELECT n_nationkey AS k, 'A' || CAST(n_nationkey AS STRING) AS agency_id, n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' \"Lines\"' ELSE '' END || CASE WHEN n_nationkey % 4 = 1 THEN chr(10) || 'East' ELSE '' END AS agency_name, "
    "CASE WHEN n_nationkey % 5 = 2 THEN 'http://a,b.example.com' ELSE 'http://a.example.com' END AS agency_url, 'UTC' AS agency_timezone FROM {nation}")  # fmt: skip


def _agency_csv(spark: SparkSession, sf_dir: str) -> str:
    """agency.txt: small by nature, a row for each operator."""
    rows = spark.sql(AGENCY, nation=spark.read.parquet(f"{sf_dir}/nation.parquet")).orderBy("k").collect()
    cell = lambda x: '"' + x.replace('"', '""') + '"' if re.search('[",\n]', x) else x
    return "agency_id,agency_name,agency_url,agency_timezone\n" + "".join(",".join(cell(x) for x in r[1:]) + "\n" for r in rows)


def _bytes(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("Agency.txt", "\ufeff" + text.replace("\n", "\r\n").replace("\r\nEast", "\nEast"))
        z.writestr("notes.md", "x")
    return out.getvalue()


QUERIES["source_bytes"] = lambda spark, sf_dir: read_feed(spark, _bytes(_agency_csv(spark, sf_dir)), RunOptions()).df("agency").select("_row", "agency_id", "agency_name", "agency_url")
ORACLE_SQL["source_bytes"] = f"""
    WITH a AS ({AGENCY.replace('{nation}', 'nation')}), l AS (SELECT *, CASE WHEN contains(agency_name, chr(10)) THEN 2 ELSE 1 END AS lines FROM a)
    SELECT CAST(2 + coalesce(sum(lines) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS _row, agency_id, agency_name, agency_url FROM l"""


# sources that executors write: stops.txt of a row for each part, read in many small splits
STOPS = """SELECT p_partkey AS k, 'S' || CAST(p_partkey AS STRING) AS stop_id, p_name || CASE WHEN p_partkey % 5 = 0 THEN chr(10) || 'Level "' || CAST(p_size AS STRING) || '"' WHEN p_partkey % 7 = 0 THEN ', Gate' ELSE '' END AS stop_name,
    CAST(CAST(40 + p_partkey % 1000 * 0.01 AS DECIMAL(9, 2)) AS STRING) AS stop_lat, CAST(CAST(-74 + p_size * 0.02 AS DECIMAL(9, 2)) AS STRING) AS stop_lon FROM {part}"""
SPLIT_BYTES = 16_384


def _stops_txt(spark: SparkSession, sf_dir: str, plain: bool) -> str:
    """A folder with stops.txt, in order of keys, written by a task as one file, as feeds have it; plain: without line ends within cells."""
    rows = spark.sql(STOPS, part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    name = F.replace("stop_name", F.lit("\n"), F.lit(" ")) if plain else F.col("stop_name")
    line = F.concat_ws(",", "stop_id", F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')), "stop_lat", "stop_lon")
    text = rows.select("k", line.alias("value")).unionByName(spark.createDataFrame([(-1, "stop_id,stop_name,stop_lat,stop_lon")], "k long, value string"))
    folder = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    text.repartitionByRange(1, "k").sortWithinPartitions("k").select("value").write.text(f"{folder}-parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    (part,) = [x.getPath() for x in fs.listStatus(path(f"{folder}-parts")) if x.getPath().getName().startswith("part-")]
    fs.rename(part, path(f"{folder}/stops.txt"))
    return local(folder)


def source_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stops.txt, whose records span lines, read by read_feed() in splits of 16 KB."""
    folder, conf = _stops_txt(spark, sf_dir, plain=False), spark.conf
    old = {k: conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
        conf.set("spark.sql.files.openCostInBytes", "1")
        feed = read_feed(spark, folder, RunOptions())  # records are stored here
    finally:
        for k, v in old.items():
            conf.set(k, v)
    return feed.df("stops").select("_row", "stop_id", "stop_name", "stop_lat", "stop_lon")


def _zipped(spark: SparkSession, folder: str) -> str:
    """A zip of the folder's stops.txt beside it, packed by a task."""
    target = f"{folder}.zip"

    def run(batches):
        for _ in batches:
            pass
        store, path = (pa_fs.LocalFileSystem(), folder) if "://" not in folder else pa_fs.FileSystem.from_uri(folder)
        with store.open_input_stream(f"{path}/stops.txt") as lines, store.open_output_stream(f"{path}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("Stops.txt", "w") as member:
            while piece := lines.read(1 << 20):
                member.write(piece)
        yield pa.RecordBatch.from_arrays([pa.array([target])], names=["path"])

    importable(spark)
    return spark.range(1, numPartitions=1).mapInArrow(run, "path string").first()["path"]


def _stops_of(source: Callable[[SparkSession, str], str]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        feed = read_feed(spark, source(spark, _stops_txt(spark, sf_dir, plain=False)), RunOptions())
        return feed.df("stops").select("_row", "stop_id", "stop_name", "stop_lat", "stop_lon")

    return query


def source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of stops.txt by the Spark source, in ranges of 16 KB."""
    return read_table(spark, _stops_txt(spark, sf_dir, plain=True), "stops", ["stop_id", "stop_name", "stop_lat"], splitbytes=str(SPLIT_BYTES)).withColumnRenamed("_row", "at_byte")


_stops = STOPS.replace("{part}", "part")
QUERIES |= {"source_splits": source_splits, "source_table": source_table, "source_directory": _stops_of(lambda spark, folder: folder), "source_zip": _stops_of(_zipped)}
ORACLE_SQL["source_splits"] = ORACLE_SQL["source_directory"] = ORACLE_SQL["source_zip"] = f"""
    WITH s AS ({_stops}), l AS (SELECT *, CASE WHEN contains(stop_name, chr(10)) THEN 2 ELSE 1 END AS lines FROM s)
    SELECT CAST(2 + coalesce(sum(lines) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS _row, stop_id, stop_name, CAST(stop_lat AS DOUBLE) AS stop_lat, CAST(stop_lon AS DOUBLE) AS stop_lon FROM l"""
ORACLE_SQL["source_table"] = f"""
    WITH s AS ({_stops}), p AS (SELECT k, stop_id, replace(stop_name, chr(10), ' ') AS stop_name, stop_lat, stop_lon FROM s),
    l AS (SELECT *, strlen(stop_id || ',"' || replace(stop_name, '"', '""') || '",' || stop_lat || ',' || stop_lon) + 1 AS bytes FROM p)
    SELECT CAST(strlen('stop_id,stop_name,stop_lat,stop_lon') + 1 + coalesce(sum(bytes) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_byte, stop_id, stop_name, CAST(stop_lat AS DOUBLE) AS stop_lat FROM l"""


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reader says about the files of a feed that has one known file, and a stray one."""
    found = read_feed(spark, _bytes(_agency_csv(spark, sf_dir)), RunOptions()).notices
    return found.where("csv_row is null and field is null").select("code", "severity", "filename")


QUERIES["load_file_list"] = file_list
ORACLE_SQL["load_file_list"] = """
    SELECT 'unknown_file' AS code, 'INFO' AS severity, 'notes.md' AS filename
    UNION ALL SELECT 'missing_required_file', 'ERROR', f || '.txt' FROM (VALUES ('stops'), ('routes'), ('trips'), ('stop_times')) v(f)"""


# report analytics
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.features(synth.feed(spark, sf_dir))


_any = {
    "Pathway Connections": "pathways", "Levels": "levels", "Transfers": "transfers", "Shapes": "shapes", "Frequencies": "frequencies", "Feed Information": "feed_info", "Attributions": "attributions", "Translations": "translations",
    "Fares V1": "fare_attributes", "Fare Products": "fare_products", "Fare Media": "fare_media", "Zone-Based Fares": "areas", "Fare Transfers": "fare_transfer_rules", "Time-Based Fares": "timeframes", "Rider Categories": "rider_categories",
    "Booking Rules": "booking_rules", "Fixed-Stops Demand Responsive Transit": "location_groups",
}
_some = {
    "Pathway Details": "EXISTS (FROM pathways WHERE length IS NOT NULL OR stair_count IS NOT NULL)", "Pathway Signs": "FALSE", "Route Colors": "EXISTS (FROM routes WHERE route_color IS NOT NULL OR route_text_color IS NOT NULL)",
    "Text-to-Speech": "EXISTS (FROM stops WHERE tts_stop_name IS NOT NULL)", "Headsigns": "EXISTS (FROM stop_times WHERE stop_headsign IS NOT NULL)", "Stops Wheelchair Accessibility": "FALSE", "Trips Wheelchair Accessibility": "FALSE", "Bike Allowed": "EXISTS (FROM trips WHERE bikes_allowed IS NOT NULL)",
    "Location Types": "EXISTS (FROM stops WHERE location_type IS NOT NULL)", "In-station Traversal Time": "EXISTS (FROM pathways WHERE traversal_time IS NOT NULL)", "Route-Based Fares": "EXISTS (FROM networks)",
    "Continuous Stops": "EXISTS (FROM routes WHERE continuous_pickup IS NOT NULL OR continuous_drop_off IS NOT NULL)", "Zone-Based Demand Responsive Services": "EXISTS (FROM stop_times WHERE location_id IS NOT NULL AND stop_id IS NULL)",
    "Predefined Routes with Deviation": "EXISTS (SELECT trip_id FROM stop_times GROUP BY trip_id HAVING count(location_id) > 0 AND count(stop_id) > 0 AND count(arrival_time) > 0 AND count(departure_time) > 0)",
}
QUERIES["report_features"] = features
ORACLE_SQL["report_features"] = synth.with_views(" UNION ALL ".join(f"SELECT '{n}' AS feature, {c} AS present" for n, c in [*((n, f"EXISTS (FROM {t})") for n, t in _any.items()), *_some.items()]))
QUERIES["report_agencies"] = lambda spark, sf_dir: report.agencies(synth.feed(spark, sf_dir))
ORACLE_SQL["report_agencies"] = synth.with_views("SELECT _row, agency_name AS name, agency_url AS url, agency_phone AS phone, CAST(NULL AS VARCHAR) AS email FROM agency")
QUERIES["report_files"] = lambda spark, sf_dir: spark.createDataFrame([(f,) for f in report.files(synth.feed(spark, sf_dir, bare=True))], "filename string")
ORACLE_SQL["report_files"] = synth.with_views("SELECT name || CASE WHEN name = 'locations' THEN '.geojson' ELSE '.txt' END AS filename FROM catalog", bare=True)


def notice_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five samples of each code of two rules, as reports hold them."""
    feed = synth.feed(spark, sf_dir)
    found = [run_rule(feed, all_rules()[n], synth.OPTIONS) for n in ("TimepointTimeValidator", "MissingTripEdgeValidator")]
    few = report.grouped(found[0].unionAll(found[1]), samples=5)
    return few.select("code", "total", F.posexplode("samples").alias("at", "s")).select("code", "total", F.col("at").cast("long").alias("at_"), F.col("s.csv_row").alias("csv_row"), F.col("s.field").alias("field"))


def samples_sql(parts: list[str]) -> str:
    return f"""
        WITH n AS ({' UNION ALL '.join(f'SELECT code, csv_row, field FROM ({p}) x' for p in parts)}),
        k AS (SELECT *, count(*) OVER (PARTITION BY code) AS total, row_number() OVER (PARTITION BY code ORDER BY csv_row, field NULLS FIRST) - 1 AS at_ FROM n)
        SELECT code, total, at_, csv_row, field FROM k WHERE at_ < 5"""


QUERIES["notice_samples"] = notice_samples


# streams
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return sessions(events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")).select("user_id", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"), "n")


QUERIES["stream_sessions"] = event_sessions
ORACLE_SQL["stream_sessions"] = """
    WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts FROM events),
    m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS BIGINT) AS end_s, count(*) AS n FROM s GROUP BY user_id, k"""


# totals of event types by user group and day stand for those of notices by feed and version
def version_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed from version to version of each feed, by the stream with state, run up to the end of what is there."""
    folder = f"{shared_dir(spark)}/changes-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    version = F.date_trunc("day", F.col("ts").cast("timestamp")).alias("version")
    totals = events.groupBy(F.concat(F.lit("F"), (F.col("user_id") % 50).cast("string")).alias("feed"), version, F.col("event_type").alias("code")).agg(F.count("*").alias("total"))
    totals.write.parquet(f"{folder}/totals")
    follow(spark, f"{folder}/totals", f"{folder}/checkpoint", lambda df: df.write.mode("append").parquet(f"{folder}/changes"), once=True).awaitTermination()
    return spark.read.schema(CHANGES).parquet(f"{folder}/changes").withColumn("version", F.unix_seconds("version"))


QUERIES["stream_changes"] = version_changes
ORACLE_SQL["stream_changes"] = """
    WITH t AS (SELECT 'F' || CAST(user_id % 50 AS VARCHAR) AS feed, CAST(epoch(date_trunc('day', CAST(ts AS TIMESTAMP))) AS BIGINT) AS version, event_type AS code, count(*) AS total FROM events GROUP BY ALL),
    v AS (SELECT feed, version FROM t GROUP BY ALL), c AS (SELECT feed, code FROM t WHERE code IS NOT NULL GROUP BY ALL),
    g AS (SELECT v.feed, v.version, c.code, coalesce(t.total, 0) AS after FROM v JOIN c ON c.feed = v.feed LEFT JOIN t ON t.feed = v.feed AND t.version = v.version AND t.code = c.code),
    b AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY feed, code ORDER BY version), 0) AS before FROM g)
    SELECT feed, version, code, before, after FROM b WHERE before <> after"""

# spatial index: every stop against a shape of its own
LOOK_M = 25_000.0


def _spots(feed) -> DataFrame:
    stops = feed.df("stops").where("stop_lat is not null and stop_lon is not null")
    return stops.select(F.col("_row").alias("spot"), F.concat(F.lit("H"), (F.col("_row") % 190).cast("string")).alias("shape_id"), F.col("stop_lat").cast("double").alias("lat"), F.col("stop_lon").cast("double").alias("lon"), F.lit(LOOK_M).alias("reach"))


def _tenths(x):
    """x to one place, halves away from zero, for x from 0 on: F.round() goes through decimals, which takes longer than all else in a row."""
    whole = F.floor(x * 10)
    return (whole + F.when(x * 10 - whole >= 0.5, 1).otherwise(0)) / 10


def segments_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of its shape within 25 km of each stop."""
    feed = synth.feed(spark, sf_dir)
    return index.gaps(_spots(feed), index.segments(feed.df("shapes"))).select("spot", F.col("j").cast("long").alias("segment"), _tenths(F.col("metres")).alias("metres"))


def segment_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest segment of its shape to each stop, in degrees."""
    feed = synth.feed(spark, sf_dir)
    found = index.nearest(_spots(feed), index.segments(feed.df("shapes")))
    return found.select("spot", F.col("nearest").cast("long").alias("segment"), F.round(F.sqrt("square"), 6).alias("degrees"))


_segments = """, p AS (SELECT shape_id, CAST(shape_pt_lat AS DOUBLE) AS y1, CAST(shape_pt_lon AS DOUBLE) AS x1, lead(CAST(shape_pt_lat AS DOUBLE)) OVER w AS y2, lead(CAST(shape_pt_lon AS DOUBLE)) OVER w AS x2, row_number() OVER w - 1 AS segment
        FROM shapes WINDOW w AS (PARTITION BY shape_id ORDER BY shape_pt_sequence, _row)),
    t AS (SELECT CAST(s._row AS BIGINT) AS spot, CAST(stop_lat AS DOUBLE) AS y, CAST(stop_lon AS DOUBLE) AS x, p.* FROM stops s JOIN p ON p.shape_id = 'H' || CAST(s._row % 190 AS VARCHAR) WHERE x2 IS NOT NULL AND stop_lat IS NOT NULL AND stop_lon IS NOT NULL)"""
# angles on the sphere by haversines and bearings: distance across the track between both ends, that to the nearer end elsewhere
_arc = "2 * asin(sqrt(least(1.0, pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2))))"
_bearing = "atan2(sin(radians({3} - {2})) * cos(radians({1})), cos(radians({0})) * sin(radians({1})) - sin(radians({0})) * cos(radians({1})) * cos(radians({3} - {2})))"
QUERIES["spatial_within"] = segments_within
ORACLE_SQL["spatial_within"] = synth.with_views(f"""{_segments},
    d AS (SELECT *, {_arc.format('y1', 'y', 'x1', 'x')} AS da, {_arc.format('y2', 'y', 'x2', 'x')} AS db, {_arc.format('y1', 'y2', 'x1', 'x2')} AS ab,
        {_bearing.format('y1', 'y', 'x1', 'x')} - {_bearing.format('y1', 'y2', 'x1', 'x2')} AS ta, {_bearing.format('y2', 'y', 'x2', 'x')} - {_bearing.format('y2', 'y1', 'x2', 'x1')} AS tb FROM t),
    m AS (SELECT spot, segment, 6371010.0 * CASE WHEN ab > 0 AND cos(ta) >= 0 AND cos(tb) >= 0 THEN asin(least(1.0, abs(sin(da) * sin(ta)))) ELSE least(da, db) END AS metres FROM d)
    SELECT spot, segment, round(metres, 1) AS metres FROM m WHERE metres <= {LOOK_M}""".strip())
QUERIES["spatial_nearest"] = segment_nearest
ORACLE_SQL["spatial_nearest"] = synth.with_views(f"""{_segments},
    f AS (SELECT *, coalesce(least(1.0, greatest(0.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0))), 0.0) AS part FROM t),
    q AS (SELECT *, (x1 + part * (x2 - x1) - x) * (x1 + part * (x2 - x1) - x) + (y1 + part * (y2 - y1) - y) * (y1 + part * (y2 - y1) - y) AS square FROM f)
    SELECT spot, segment, round(sqrt(square), 6) AS degrees FROM q QUALIFY row_number() OVER (PARTITION BY spot ORDER BY square, segment) = 1""".strip())

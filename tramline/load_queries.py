"""One query for each check of the reader, over raw cells projected from star-schema tables, and the same in DuckDB SQL.

The raw tables are what a CSV file's records are to the reader: a line and its cells as text. Arithmetic on keys plants what is wrong.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .feed import NOTICE, RunOptions
from .model import TABLES, file_of
from .sources.feed import CURRENCY_CODES, cell_notices, header_notices, typed
from .sources.geojson import places_of

OPTIONS = RunOptions(country="US", thorough=True)


def cases(key: str, default: str, *odd: str) -> str:
    """A text column: the odd values, as SQL, at keys divisible by 7, 8, 9 and so on; else the default."""
    return "CASE " + " ".join(f"WHEN {key} % {n} = 0 THEN {v}" for n, v in enumerate(odd, 7)) + f" ELSE {default} END"


def table(key: str, source: str, keep: str, **columns: str) -> tuple[str, str, str, dict[str, str]]:
    return key, source, keep, columns


P, C, N, S, E = "p_partkey", "c_custkey", "n_nationkey", "s_suppkey", "event_id"
NAMES = "'Main Street', 'x', ' Two  Words ', 'main', 'MAIN', 'main street', 'MAIN STREET', 'route 5', 'a b c', 'North-south line', 'é à'".split(", ")
RAW = {
    "stops": table(P, "part", f"CASE WHEN {P} % 41 = 0 THEN 0 WHEN {P} % 43 = 0 THEN 3 END",
        stop_id=cases(P, f"'S' || {P}", "''", f"'S' || chr(10) || {P}", f"'S' || chr(65533) || {P}", f"'Sé' || {P}", f"'S' || chr(9) || {P}", "'  '"),
        stop_name="CASE CAST(p_partkey % 11 AS INT) " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(NAMES)) + " END",
        stop_lat=cases(P, "'40.5'", "'95.0'", "'abc'", "''", "'-90'", "' 12 '", "'1e2'", "'12,5'"), stop_lon=cases(P, "'-74.25'", "'180.5'", "'x1'", "'-180'"),
        location_type=cases(P, "'0'", "'9'", "'x'", "''", "'1.5'", "'-1'", "' 4 '"), stop_timezone=cases(P, "''", "'Mars/Olympus'", "'Europe/Paris'", "'UTC'", "'europe/paris'"),
        stop_url=cases(P, "'http://e.example.com/a'", "'not a url'", "'example.com'", "'ftp://f.example.com'", "''", "'http:'", "'://x'", "'https://u:p@e.example.com:8080/x'", "'http://e.example.com:65536'", "'http://192.168.0.1/'", "'http://300.1.1.1'", "'http://[2001:db8::1]:80/'", "'http://[1::2::3]/'",
            "'http://e%2Eexample.com'", "'http://e%2Fexample.com'", "'http://e%zz.com'", "'http://e x.com'", "'mailto:a@b'", "'tel:+1 555'", "'http:e.example.com?a b'", "'foo://a<b/'", "'http://@/'", "'http://e.example.com/a b|c'", "'http://[::ffff:1.2.3.4]'", "'http://[::1'"), stop_phone=cases(P, "''", "'call me'", "'+1 555 0100'", "'1'", "'(0) 12-34.5'")),
    "agency": table(N, "nation", "CAST(NULL AS INT)", agency_id=f"'A' || {N}", agency_name=cases(N, "n_name", "''"), agency_url=cases(N, "'https://e.example.com'", "'www'"),
        agency_timezone=cases(N, "'America/New_York'", "''", "'Nowhere'"), agency_lang=cases(N, "'en'", "'english!'", "'e'", "'pt-BR'", "'zh-Hant-TW'"),
        agency_email=cases(N, "'a@b.example.com'", "'a@b'", "'ab.example.com'", "'a b@c.example.com'", "'a@@b.example.com'", "'a@.example.com'", "'a@b.example.'")),
    "routes": table(C, "customer", "CAST(NULL AS INT)", route_id=f"'R' || {C}", route_type=cases(C, "'3'", "'8'", "'11'", "''", "'bus'"),
        route_color=cases(C, "'00FF7f'", "'GG0000'", "'FFF'", "''", "'#FF0000'"), route_sort_order=cases(C, "'1'", "'-1'", "'2.5'", "'0'", "'+7'")),
    "calendar_dates": table(E, "events", f"CASE WHEN {E} % 97 = 0 THEN 2 END", service_id=f"'V' || {E}", date=cases(E, "'20240229'", "'20230229'", "'2024-01-01'", "'20241301'", "''", "'2024010'", "' 20240101 '"), exception_type=cases(E, "'1'", "'0'", "'2'", "'3'", "'a'")),
    "frequencies": table(E, "events", "CAST(NULL AS INT)", trip_id=f"'T' || {E}", start_time=cases(E, "'08:00:00'", "'8:00:00'", "'25:59:59'", "'08:60:00'", "'08:00'", "'ab:cd:ef'", "''", "'08:00:99'", "'-1:00:00'"),
        end_time="'30:00:00'", headway_secs=cases(E, "'600'", "'0'", "'-60'", "'6e2'", "''", "'1'")),
    "fare_products": table(S, "supplier", "CAST(NULL AS INT)", fare_product_id=f"'D' || {S}", amount=cases(S, "'12.50'", "'12'", "'12.5'", "'-1.00'", "'x'", "'1.234'"), currency=cases(f"({S} + 3)", "'USD'", "'JPY'", "'BHD'", "'ZZZ'", "'usd'", "''", "'EUR'")),
}


def raw_view(name: str) -> str:
    key, source, keep, columns = RAW[name]
    return f"SELECT CAST({key} + 2 AS BIGINT) AS line, {keep} AS keep, " + ", ".join(f"CAST({v} AS STRING) AS {c}" for c, v in columns.items()) + f" FROM {source}"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """line, cells."""
    source, columns = RAW[name][1], list(RAW[name][3])
    rows = spark.sql(raw_view(name).replace(f" FROM {source}", " FROM {t}").replace("chr(65533)", "'�'"), t=spark.read.parquet(f"{sf_dir}/{source}.parquet"))
    cells = F.array(*columns)
    return rows.select("line", F.when(F.col("keep").isNotNull(), F.slice(cells, F.lit(1), F.col("keep"))).otherwise(cells).alias("cells"))


def trimmed(column: str) -> str:
    return rf"regexp_replace({column}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def with_raw(sql: str) -> str:
    return "WITH " + ",\n".join(f"raw_{t} AS ({raw_view(t)})" for t in RAW if f"raw_{t}" in sql) + "\n" + sql


def cell(code: str, where: dict[str, str], shown: str = "{v}") -> None:
    """Notices of a code. where: by `table.column` the condition in SQL, in which {c} is the cell and {v} the cell without white space at its ends."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = None
        for name in dict.fromkeys(w.split(".")[0] for w in where):
            one = cell_notices(raw(spark, sf_dir, name), name, list(RAW[name][3]), OPTIONS).where(F.col("code") == code)
            out = one if out is None else out.unionByName(one)
        return out.select("filename", "csv_row", "field", F.col("context")["fieldValue"].alias("value"))

    QUERIES[f"cell_{code}"] = query
    parts = []
    for place, condition in where.items():
        name, _, column = place.partition(".")
        fill = {"c": column, "v": trimmed(column)} if column else {"c": "NULL", "v": "NULL"}
        whole = "keep IS NULL AND " if column else ""
        field = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT '{name}.txt' AS filename, line AS csv_row, {field} AS field, CAST({shown.format(**fill)} AS VARCHAR) AS value FROM raw_{name} WHERE {whole}({condition.format(**fill)})")
    ORACLE_SQL[f"cell_{code}"] = with_raw("\nUNION ALL ".join(parts))


INT, FLOAT = "regexp_full_match({v}, '[+-]?[0-9]+')", "try_cast({v} AS DOUBLE) IS NOT NULL"
there = lambda condition: "{v} <> '' AND " + condition
outside = lambda low, high: there(FLOAT) + f" AND try_cast({{v}} AS DOUBLE) NOT BETWEEN {low} AND {high}"
cell("missing_required_field", {p: "{v} = ''" for p in ("stops.stop_id", "agency.agency_name", "agency.agency_timezone", "routes.route_type", "calendar_dates.date", "frequencies.start_time", "frequencies.headway_secs", "fare_products.currency")}, "NULL")
cell("new_line_in_value", {"stops.stop_id": "contains({c}, chr(10))"}, "{c}")
cell("invalid_character", {"stops.stop_id": "contains({c}, chr(65533))"}, "{c}")
cell("non_ascii_or_non_printable_char", {"stops.stop_id": there("len(list_filter(string_split({c}, ''), lambda x: ord(x) NOT BETWEEN 32 AND 126)) > 0")}, "{c}")
_words = "list_filter(regexp_split_to_array({c}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_usable = f"list_filter({_words}, lambda w: length(w) > 1 AND NOT regexp_matches(w, '[0-9]'))"
cell("mixed_case_recommended_field", {"stops.stop_name": f"""CASE WHEN len({_words}) = 1 THEN len({_usable}) = 1 AND lower({{v}}) = {{v}}
    ELSE len({_usable}) >= 2 AND len(list_filter({_usable}, lambda w: w <> lower(w) AND w <> upper(w))) = 0 END"""}, "{c}")  # fmt: skip
cell("unexpected_enum_value", {"stops.location_type": there(INT + " AND {v}::INT NOT BETWEEN 0 AND 4"), "routes.route_type": there(INT + " AND {v}::INT NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 11, 12)"),
    "calendar_dates.exception_type": there(INT + " AND {v}::INT NOT IN (1, 2)")})
cell("invalid_integer", {p: there(f"NOT {INT}") for p in ("stops.location_type", "routes.route_type", "routes.route_sort_order", "calendar_dates.exception_type", "frequencies.headway_secs")})
cell("invalid_float", {p: there(f"NOT ({FLOAT})") for p in ("stops.stop_lat", "stops.stop_lon", "fare_products.amount")})
cell("number_out_of_range", {"stops.stop_lat": outside(-90, 90), "stops.stop_lon": outside(-180, 180), "routes.route_sort_order": there(INT + " AND {v}::INT < 0"), "frequencies.headway_secs": there(INT + " AND {v}::INT <= 0"),
    "fare_products.amount": there(FLOAT) + " AND try_cast({v} AS DOUBLE) < 0"})
cell("invalid_date", {"calendar_dates.date": there("(length({v}) <> 8 OR try_strptime({v}, '%Y%m%d') IS NULL)")})
_part = lambda n: f"try_cast(split_part({{v}}, ':', {n}) AS INT)"
cell("invalid_time", {"frequencies.start_time": there(f"coalesce(len(string_split({{v}}, ':')) <> 3 OR {_part(1)} < 0 OR {_part(2)} > 59 OR {_part(3)} > 59, TRUE)")})
cell("invalid_color", {"routes.route_color": there("(length({v}) <> 6 OR ltrim(upper({v}), '0123456789ABCDEF') <> '')")})
_no_zone = there("{v} NOT IN (SELECT name FROM pg_timezone_names())")
cell("invalid_timezone", {"stops.stop_timezone": _no_zone, "agency.agency_timezone": _no_zone})
cell("invalid_language_code", {"agency.agency_lang": there("NOT (length(split_part({v}, '-', 1)) BETWEEN 2 AND 3 AND regexp_full_match({v}, '[A-Za-z0-9-]+') AND NOT regexp_matches(split_part({v}, '-', 1), '[0-9]'))")})
cell("invalid_currency", {"fare_products.currency": there("{v} NOT IN (" + ", ".join(f"'{c}'" for c in CURRENCY_CODES) + ")")})
cell("invalid_currency_amount", {"fare_products.amount": FLOAT + " AND currency IN ('USD', 'EUR', 'JPY', 'BHD') AND length(split_part({v}, '.', 2)) <> CASE currency WHEN 'JPY' THEN 0 WHEN 'BHD' THEN 3 ELSE 2 END"})
_no_url = there("NOT " + oracles.url("{v}").replace("{", "{{").replace("}", "}}").replace("{{v}}", "{v}"))
cell("invalid_url", {"stops.stop_url": _no_url, "agency.agency_url": _no_url})
_domain = "split_part({v}, '@', 2)"
cell("invalid_email", {"agency.agency_email": there(f"NOT (len(string_split({{v}}, '@')) = 2 AND NOT contains({{v}}, ' ') AND contains({_domain}, '.') AND {_domain}[1] <> '.' AND {_domain}[-1] <> '.')")})
cell("invalid_phone_number", {"stops.stop_phone": there("(ltrim({v}, '0123456789+-(). ') <> '' OR len(list_filter(string_split({v}, ''), lambda x: x BETWEEN '0' AND '9')) < 2)")})
_time_fails = "NOT regexp_full_match(" + trimmed("start_time") + ", '[0-9]+:[0-5]?[0-9]:[0-5]?[0-9]')"
_date_fails = "NOT coalesce(length({0}) = 8 AND try_strptime({0}, '%Y%m%d') IS NOT NULL, FALSE)".format(trimmed("date"))
cell("csv_parsing_failed", {"frequencies": f"{_time_fails} OR NOT regexp_full_match({trimmed('headway_secs')}, '[+-]?[0-9]+')", "calendar_dates": f"keep IS NULL AND ({_date_fails} OR {trimmed('exception_type')} = '')"})
cell("empty_row", {"stops": "keep = 0"})
cell("invalid_row_length", {"stops": "keep > 0", "calendar_dates": "keep > 0"}, "keep")


def rows_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of raw tables that the reader keeps, with their typed values."""
    d = typed(raw(spark, sf_dir, "calendar_dates"), "calendar_dates", list(RAW["calendar_dates"][3])).select("_row", "service_id", F.col("date").cast("string").alias("a"), F.col("exception_type").alias("b"))
    f = typed(raw(spark, sf_dir, "frequencies"), "frequencies", list(RAW["frequencies"][3])).select("_row", F.col("trip_id").alias("service_id"), F.col("start_time").cast("string").alias("a"), F.col("headway_secs").cast("int").alias("b"))
    return d.unionByName(f)


QUERIES["load_rows_kept"] = rows_kept
_d, _e, _t, _h = (trimmed(x) for x in ("date", "exception_type", "start_time", "headway_secs"))
ORACLE_SQL["load_rows_kept"] = with_raw(rf"""
    SELECT line AS _row, service_id, CAST(CAST(try_strptime({_d}, '%Y%m%d') AS DATE) AS VARCHAR) AS a,
        CASE WHEN regexp_full_match({_e}, '[12]') THEN CAST({_e} AS INT) ELSE -1 END AS b
    FROM raw_calendar_dates WHERE keep IS NULL AND length({_d}) = 8 AND try_strptime({_d}, '%Y%m%d') IS NOT NULL AND {_e} <> ''
    UNION ALL
    SELECT line, trip_id, CAST(split_part({_t}, ':', 1)::INT * 3600 + split_part({_t}, ':', 2)::INT * 60 + split_part({_t}, ':', 3)::INT AS VARCHAR), CAST({_h} AS INT)
    FROM raw_frequencies WHERE regexp_full_match({_t}, '[0-9]+:[0-5]?[0-9]:[0-5]?[0-9]') AND regexp_full_match({_h}, '[+-]?[0-9]+')""")

HEADERS = {
    "stops": ["stop_id", "stop_name", "", "stop_lat", "color", "stop_lat"],
    "trips": ["trip_id", "route_id", "Shape_id"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"],
}


def header_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.createDataFrame([n for t, h in HEADERS.items() for n in header_notices(t, h, OPTIONS)], NOTICE)
    return found.select("code", "severity", "filename", "field", F.coalesce(F.col("context")["index"], F.col("context")["secondIndex"]).alias("position"))


QUERIES["load_header_checks"] = header_checks
_given = ", ".join(f"('{file_of(t)}', {i}, '{c}')" for t, h in HEADERS.items() for i, c in enumerate(h, 1))
_model = ", ".join(f"('{file_of(t)}', '{c.name}', {c.required}, {c.recommended})" for t in HEADERS for c in TABLES[t] if c.listed)
ORACLE_SQL["load_header_checks"] = f"""
    WITH h(filename, i, name) AS (VALUES {_given}), m(filename, name, required, recommended) AS (VALUES {_model}),
    k AS (SELECT *, row_number() OVER (PARTITION BY filename, name ORDER BY i) AS nth FROM h)
    SELECT 'empty_column_name' AS code, 'ERROR' AS severity, filename, CAST(NULL AS VARCHAR) AS field, CAST(i AS VARCHAR) AS position FROM k WHERE name = ''
    UNION ALL SELECT 'duplicated_column', 'ERROR', filename, name, CAST(i AS VARCHAR) FROM k WHERE name <> '' AND nth > 1
    UNION ALL SELECT 'unknown_column', 'INFO', filename, name, CAST(i AS VARCHAR) FROM k WHERE name <> '' AND nth = 1 AND NOT EXISTS (SELECT * FROM m WHERE m.filename = k.filename AND m.name = k.name)
    UNION ALL SELECT CASE WHEN required THEN 'missing_required_column' ELSE 'missing_recommended_column' END, CASE WHEN required THEN 'ERROR' ELSE 'WARNING' END, filename, name, NULL
        FROM m WHERE (required OR recommended) AND NOT EXISTS (SELECT * FROM h WHERE h.filename = m.filename AND h.name = m.name)"""

#: Features of a places file, one for each nation.
FEATURES = """SELECT CAST(n_nationkey AS INT) AS i, CASE WHEN n_nationkey % 11 = 10 THEN NULL ELSE 'P' || CAST(n_nationkey - CASE WHEN n_nationkey % 20 = 19 THEN 1 ELSE 0 END AS STRING) END AS id,
    CASE WHEN n_nationkey % 7 = 3 THEN 'Point' ELSE 'Polygon' END AS kind, CASE WHEN n_nationkey % 9 = 5 THEN 'open' WHEN n_nationkey % 9 = 7 THEN 'crossed' ELSE 'box' END AS ring,
    CAST(n_nationkey AS DOUBLE) AS x, CASE WHEN n_nationkey % 13 = 12 THEN 88.5e0 WHEN n_nationkey = 0 THEN 0.0e0 ELSE 40.0e0 END AS y, n_nationkey % 8 = 6 AS odd FROM {nation}"""


def locations_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of a places file, put together by tasks as one document, as such files are."""
    rows = spark.sql(FEATURES, nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    corner = [F.array(F.col("x") + dx, F.col("y") + dy) for dx, dy in ((0.0, 0.0), (0.5, 0.0), (0.5, 1.0), (0.0, 1.0))]
    a, b, c, d = corner
    ring = F.when(F.col("ring") == "open", F.array(*corner)).when(F.col("ring") == "crossed", F.array(a, c, b, d, a)).otherwise(F.array(*corner, a))
    coordinates = F.when(F.col("kind") == "Polygon", F.to_json(F.array(ring))).otherwise(F.to_json(a))
    own = [F.concat(F.lit('"id":"'), "id", F.lit('",')), F.when(F.col("odd"), F.lit('"odd":1,'))]
    feature = F.concat(F.lit('{"type":"Feature","properties":{},'), *[F.coalesce(x, F.lit("")) for x in own], F.lit('"geometry":{"type":"'), "kind", F.lit('","coordinates":'), coordinates, F.lit("}}"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", feature.alias("f")))), lambda x: x["f"]), ",")
    document = rows.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), listed, F.lit("]}")).alias("value"))
    _, found = places_of(document, OPTIONS)
    return found.select("code", "severity", F.coalesce(F.col("context")["featureIndex"], F.col("context")["secondIndex"]).alias("featureIndex"))


QUERIES["rule_locations_notices"] = locations_notices
_f = FEATURES.replace("{nation}", "nation")
ORACLE_SQL["rule_locations_notices"] = f"""
    WITH f AS ({_f}), g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) > 1 AS again FROM f), u AS (SELECT * FROM g WHERE id IS NOT NULL AND NOT again),
    s AS (SELECT * FROM u WHERE kind = 'Polygon' AND ring <> 'open')
    SELECT 'geo_json_unknown_element' AS code, 'INFO' AS severity, CAST(NULL AS VARCHAR) AS featureIndex FROM f WHERE odd
    UNION ALL SELECT 'missing_required_element', 'ERROR', CAST(i AS VARCHAR) FROM f WHERE id IS NULL
    UNION ALL SELECT 'duplicate_geo_json_key', 'ERROR', CAST(i AS VARCHAR) FROM g WHERE id IS NOT NULL AND again
    UNION ALL SELECT 'unsupported_geometry_type', 'ERROR', CAST(i AS VARCHAR) FROM u WHERE kind = 'Point'
    UNION ALL SELECT 'invalid_geometry', 'ERROR', CAST(i AS VARCHAR) FROM u WHERE kind = 'Polygon' AND ring <> 'box'
    UNION ALL SELECT 'point_near_origin', 'ERROR', CAST(i AS VARCHAR) FROM s WHERE abs(x) <= 1 AND abs(y) <= 1
    UNION ALL SELECT 'point_near_pole', 'ERROR', CAST(i AS VARCHAR) FROM s WHERE y + 1 >= 89"""

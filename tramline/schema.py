"""The schema of notices: for each code its severity and the types of its fields.

Rules are asked for their plans over two feeds without rows, one with every file and one with none, and what they would give is
noted; nothing runs. What the reader gives, and rules that make their notices by other means, is listed here.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import SparkSession

from .feed import Feed, RunOptions, recorded
from .model import SPARK_TYPE, TABLES

JSON_TYPE = {"int": "integer", "bigint": "integer", "smallint": "integer", "double": "number", "float": "number", "boolean": "boolean"}

# Codes, severities and fields of the reader's notices, and of rules that choose the code by row.
_CELL = {"fieldName": "string", "fieldValue": "string"}
_PLACE = {"featureIndex": "integer", "featureId": "string"}
_STOP = {"tripCsvRowNumber": "integer", "shapeId": "string", "tripId": "string", "stopTimeCsvRowNumber": "integer", "stopId": "string", "stopName": "string", "stopLocation": "array", "match": "array", "shapePath": "array", "matchIndex": "integer"}
_ORDER = {"tripCsvRowNumber": "integer", "shapeId": "string", "tripId": "string", "stopTimeCsvRowNumber1": "integer", "stopId1": "string", "stopName1": "string", "match1": "array",
    "stopTimeCsvRowNumber2": "integer", "stopId2": "string", "stopName2": "string", "match2": "array", "shapePath": "array", "matchIndex": "integer"}
LISTED: dict[str, tuple[str, dict[str, str]]] = {
    **{f"invalid_{x}": ("ERROR", _CELL) for x in "character color currency currency_amount date email float integer language_code phone_number time timezone url".split()},
    **{x: ("ERROR", _CELL) for x in ("missing_required_field", "new_line_in_value", "number_out_of_range")},
    **{x: ("WARNING", _CELL) for x in ("mixed_case_recommended_field", "non_ascii_or_non_printable_char", "unexpected_enum_value")},
    "csv_parsing_failed": ("ERROR", {"message": "string"}),
    "duplicated_column": ("ERROR", {"fieldName": "string", "firstIndex": "integer", "secondIndex": "integer"}),
    "empty_column_name": ("ERROR", {"index": "integer"}),
    "empty_file": ("ERROR", {}),
    "empty_row": ("WARNING", {}),
    "invalid_input_files_in_subfolder": ("ERROR", {}),
    "invalid_row_length": ("ERROR", {"fieldValue": "integer"}),
    "missing_recommended_column": ("WARNING", {"fieldName": "string"}),
    "missing_required_column": ("ERROR", {"fieldName": "string"}),
    "missing_required_file": ("ERROR", {}),
    "too_many_rows": ("ERROR", {"rowNumber": "integer"}),
    "unknown_column": ("INFO", {"fieldName": "string", "index": "integer"}),
    "unknown_file": ("INFO", {"filename": "string"}),
    "duplicate_geo_json_key": ("ERROR", {"featureId": "string", "firstIndex": "integer", "secondIndex": "integer"}),
    "geo_json_duplicated_element": ("ERROR", _PLACE | {"duplicatedElement": "string"}),
    "geo_json_unknown_element": ("INFO", {"unknownElement": "string"}),
    "invalid_geometry": ("ERROR", _PLACE | {"geometryType": "string", "message": "string"}),
    "malformed_json": ("ERROR", {"message": "string"}),
    "missing_required_element": ("ERROR", _PLACE | {"missingElement": "string"}),
    "point_near_origin": ("ERROR", {"featureIndex": "integer", "entityId": "string"}),
    "point_near_pole": ("ERROR", {"featureIndex": "integer", "entityId": "string"}),
    "unsupported_feature_type": ("ERROR", {"featureIndex": "integer", "featureType": "string"}),
    "unsupported_geo_json_type": ("ERROR", {"geoJsonType": "string"}),
    "unsupported_geometry_type": ("ERROR", _PLACE | {"geometryType": "string"}),
    "stop_has_too_many_matches_for_shape": ("WARNING", _STOP | {"matchCount": "integer"}),
    "stop_too_far_from_shape": ("WARNING", _STOP | {"geoDistanceToShape": "number"}),
    "stop_too_far_from_shape_using_user_distance": ("WARNING", _STOP | {"geoDistanceToShape": "number"}),
    "stops_match_shape_out_of_order": ("WARNING", _ORDER),
    "i_o_error": ("ERROR", {"exception": "string", "message": "string"}),
    "runtime_exception_in_loader_error": ("ERROR", {"exception": "string", "message": "string"}),
    "runtime_exception_in_validator_error": ("ERROR", {"validator": "string", "exception": "string", "message": "string"}),
}

_found: dict[str, dict] = {}


def _of_rules(spark: SparkSession) -> dict[str, tuple[str, dict[str, str]]]:
    from .operators import all_rules

    options = RunOptions(date=dt.date(2025, 1, 1), country="US", google=True, thorough=True)
    empty = {t: spark.createDataFrame([], "_row long, " + ", ".join(f"{c.name} {SPARK_TYPE[c.kind]}" for c in columns)) for t, columns in TABLES.items()}
    places = spark.createDataFrame([], "location_id string, feature_index int, geom_type string, minx double, miny double, maxx double, maxy double")
    headers = {t: [c.name for c in columns] for t, columns in TABLES.items()}
    some = lambda *gone: Feed(spark, {t: df for t, df in (empty | {"locations": places}).items() if t not in gone}, {t: h for t, h in headers.items() if t not in gone})
    out: dict[str, tuple[str, dict[str, str]]] = {}
    with recorded() as notes:
        for feed in (some(), some("calendar", "calendar_dates", "feed_info", "fare_attributes", "locations")):
            for rule in all_rules().values():
                rule.notices(feed, options)
        for code, severity, fields in notes:
            known = out.setdefault(code, (severity, {}))
            known[1].update({k: JSON_TYPE.get(t, "string") for k, t in fields.items()})
    return out


def notice_schema(spark: SparkSession | None = None) -> dict[str, dict]:
    """By code: severityLevel, type, and properties by name with their types."""
    if not _found:
        every = dict(LISTED)
        for code, (severity, fields) in _of_rules(spark or SparkSession.builder.getOrCreate()).items():
            every[code] = (every[code][0], every[code][1] | fields) if code in every else (severity, fields)
        for code, (severity, fields) in sorted(every.items()):
            properties = {"filename": "string", "csvRowNumber": "integer", "fieldName": "string"} | fields
            _found[code] = {"code": code, "severityLevel": severity, "type": "object", "deprecated": False,
                "properties": {k: {"type": t, "fieldName": k} for k, t in sorted(properties.items())}}
    return json.loads(json.dumps(_found))


def notice_codes(spark: SparkSession | None = None) -> list[str]:
    return list(notice_schema(spark))

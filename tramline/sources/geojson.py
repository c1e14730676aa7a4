"""locations.geojson: features with their boxes, and what is wrong with them.

The document is one value, read and cut into features in a task; features are dealt to tasks, which examine each by itself. What concerns several of
them, ids and geometries that come again, is found by windows over their ids and digests.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..feed import RunOptions
from ..functions.checkpoint import cut
from ..functions.workers import importable
from .rings import crosses_itself

FILE = "locations.geojson"
#: Notices after which the places can't be used.
FATAL = ("unsupported_geo_json_type", "malformed_json", "unsupported_feature_type", "duplicate_geo_json_key")
Said = tuple[str, str, dict[str, str]]
C = F.col


def _said(code: str, severity: str = "ERROR", **context: object) -> Said:
    return code, severity, {k: str(v) for k, v in context.items() if v is not None}


def _ring(ring: object) -> bool:
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    return isinstance(ring, list) and len(ring) >= 4 and all(isinstance(p, list) and len(p) >= 2 and number(p[0]) and number(p[1]) for p in ring) and ring[0] == ring[-1]


def examine_document(doc: object, options: RunOptions) -> tuple[list[Said], list | None]:
    """Notices of a document as a whole, and its features; None if it has none."""
    if not isinstance(doc, dict) or doc.get("type") != "FeatureCollection":
        kind = doc.get("type") if isinstance(doc, dict) else None
        lacking = [_said("missing_required_element", missingElement="type")] if kind is None and options.thorough else []
        return [*lacking, _said("unsupported_geo_json_type", geoJsonType=kind)], None
    said = [_said("geo_json_unknown_element", "INFO", unknownElement=key) for key in sorted(set(doc) - {"type", "features"})]
    features = doc.get("features")
    if not isinstance(features, list):
        return said + [_said("missing_required_element", missingElement="features")] * options.thorough, None
    return said, features


def examine(i: int, f: object, options: RunOptions) -> tuple[list[Said], str | None, list[Said], str | None, bool, tuple | None]:
    """Of a feature: notices in any case, its id, notices if its id comes first with it, the digest of its geometry, whether a geometry that came before is told, and its row."""
    if not isinstance(f, dict) or f.get("type") != "Feature":
        return [_said("unsupported_feature_type", featureIndex=i, featureType=f.get("type") if isinstance(f, dict) else None)], None, [], None, False, None
    name, shape = f.get("id"), f.get("geometry")
    said = [_said("geo_json_unknown_element", "INFO", unknownElement=key) for key in sorted(set(f) - {"type", "id", "properties", "geometry"})]
    if options.thorough:
        said += [_said("missing_required_element", featureIndex=i, featureId=name, missingElement=e) for e in ("id", "properties", "geometry") if f.get(e) is None]
    if name is None or not isinstance(shape, dict):
        return said, None if name is None else str(name), [], None, False, None
    name, kind, coordinates = str(name), shape.get("type"), shape.get("coordinates")
    if kind not in ("Polygon", "MultiPolygon"):
        return said, name, [_said("unsupported_geometry_type", featureIndex=i, featureId=name, geometryType=kind)] * options.thorough, None, False, None
    digest, again = hashlib.sha256(json.dumps(coordinates).encode()).hexdigest(), options.thorough or kind == "MultiPolygon"
    polygons = [coordinates] if kind == "Polygon" else coordinates
    if not isinstance(polygons, list) or not polygons or not all(isinstance(p, list) and p and all(map(_ring, p)) for p in polygons):
        wrong = _said("invalid_geometry", featureId=name, featureIndex=i, geometryType=kind, message="rings must be closed lists of positions")
        return said, name, [wrong], digest, again, None
    later = []
    if kind == "Polygon" and crosses_itself(np.array([p[:2] for p in polygons[0][0]], float)):
        later.append(_said("invalid_geometry", featureId=name, featureIndex=i, geometryType=kind, message="the ring crosses itself"))
    points = np.array([p[:2] for polygon in polygons for ring in polygon for p in ring], float)
    if options.thorough and (np.abs(points) <= 1).all(axis=1).any():
        later.append(_said("point_near_origin", featureIndex=i, entityId=name))
    if (np.abs(points[:, 1]) >= 89).any():
        later.append(_said("point_near_pole", featureIndex=i, entityId=name))
    return said, name, later, digest, again, (name, i, kind, *points.min(axis=0).tolist(), *points.max(axis=0).tolist())


PLACES = "location_id string, feature_index int, geom_type string, minx double, miny double, maxx double, maxy double"
_SAID = "array<struct<code:string,severity:string,context:map<string,string>>>"
_SAID_TYPE = pa.list_(pa.struct([("code", pa.string()), ("severity", pa.string()), ("context", pa.map_(pa.string(), pa.string()))]))


def _arrow(said: list[list[Said]]) -> pa.Array:
    return pa.array([[{"code": c, "severity": s, "context": list(x.items())} for c, s, x in one] for one in said], _SAID_TYPE)


def places_of(document: DataFrame, options: RunOptions) -> tuple[DataFrame, DataFrame]:
    """Places, and notices as the reader's, of document(value), one row with the text or the bytes of locations.geojson."""
    spark = document.sparkSession
    importable(spark)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                raw = raw.as_py() or b""
                try:
                    said, every = examine_document(json.loads(raw.removeprefix("﻿") if isinstance(raw, str) else raw.decode("utf-8-sig")), options)
                except ValueError as error:
                    said, every = [_said("malformed_json", message=error)], None
                rows = [(-1, None, said), *((i, json.dumps(f), []) for i, f in enumerate(every or ()))]
                for k in range(0, len(rows), 1000):
                    i, text, told = zip(*rows[k : k + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(text, pa.string()), _arrow(list(told))], names=["i", "feature", "said"])

    def examined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [(said.as_py(), None, [], None, False, None) if f.as_py() is None else examine(i.as_py(), json.loads(f.as_py()), options) for i, f, said in zip(*batch.columns, strict=True)]
            said = [[(x["code"], x["severity"], dict(x["context"])) if isinstance(x, dict) else x for x in one[0]] for one in some]
            boxes = [None if one[5] is None else dict(zip(("kind", "minx", "miny", "maxx", "maxy"), one[5][2:], strict=True)) for one in some]
            columns = [batch.column(0), _arrow(said), pa.array([one[1] for one in some], pa.string()), _arrow([one[2] for one in some]), pa.array([one[3] for one in some], pa.string()), pa.array([one[4] for one in some], pa.bool_())]
            box = pa.array(boxes, pa.struct([("kind", pa.string()), *((n, pa.float64()) for n in ("minx", "miny", "maxx", "maxy"))]))
            yield pa.RecordBatch.from_arrays([*columns, box], names=["i", "said", "name", "later", "digest", "again", "box"])

    cut_up = document.select("value").mapInArrow(features, f"i int, feature string, said {_SAID}")
    dealt = cut_up.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "i")
    schema = f"i int, said {_SAID}, name string, later {_SAID}, digest string, again boolean, box struct<kind:string,minx:double,miny:double,maxx:double,maxy:double>"
    found = cut(dealt.mapInArrow(examined, schema))
    named = found.where("name is not null").withColumn("first", F.min("i").over(Window.partitionBy("name")))
    own = named.where("i = first")
    shaped = own.where("digest is not null").withColumn("before", F.min("i").over(Window.partitionBy("digest")))
    context = lambda **c: F.create_map(*[x for k, v in c.items() for x in (F.lit(k), v.cast("string"))])
    plain = lambda df, column: df.select("i", F.explode(column).alias("n")).select("n.code", "n.severity", "n.context")
    told = lambda df, code, **c: df.select(F.lit(code).alias("code"), F.lit("ERROR").alias("severity"), context(**c).alias("context"))
    notices = plain(found, "said").unionByName(plain(own, "later"))
    notices = notices.unionByName(told(named.where("i > first"), "duplicate_geo_json_key", featureId=C("name"), firstIndex=C("first"), secondIndex=C("i")))
    notices = notices.unionByName(told(shaped.where("i > before and again"), "geo_json_duplicated_element", duplicatedElement=C("digest")))
    none = lambda kind: F.lit(None).cast(kind)
    notices = notices.select("code", "severity", F.lit(FILE).alias("filename"), none("long").alias("csv_row"), none("string").alias("field"), "context")
    places = own.where("box is not null").select(C("name").alias("location_id"), C("i").alias("feature_index"), C("box.kind").alias("geom_type"), "box.minx", "box.miny", "box.maxx", "box.maxy")
    return places, notices


def read_locations(raw: bytes, options: RunOptions) -> tuple[list[tuple], list[tuple], bool]:
    """The same of a small document's bytes, without Spark: rows of PLACES, notices, and whether the file can't be used."""
    try:
        said, features = examine_document(json.loads(raw.decode("utf-8-sig")), options)
    except ValueError as error:
        said, features = [_said("malformed_json", message=error)], None
    rows: list[tuple] = []
    first: dict[str, int] = {}
    shapes: set[str] = set()
    for i, f in enumerate(features or ()):
        own, name, later, digest, again, row = examine(i, f, options)
        said += own
        if name is None:
            continue
        if name in first:
            said.append(_said("duplicate_geo_json_key", featureId=name, firstIndex=first[name], secondIndex=i))
            continue
        first[name] = i
        if digest in shapes and again:
            said.append(_said("geo_json_duplicated_element", duplicatedElement=digest))
        shapes |= {digest} - {None}
        said += later
        rows += [row] if row else []
    notices = [(code, severity, FILE, None, None, context) for code, severity, context in said]
    return rows, notices, any(code in FATAL for code, _, _ in said)

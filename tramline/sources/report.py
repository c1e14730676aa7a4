"""Reports: grouped notices, a summary of the feed, and JSON, HTML and SARIF files."""

from __future__ import annotations

import datetime as dt
import html
import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..feed import Feed
from ..functions.exprs import full
from ..model import GEOJSON, TABLES, file_of

C = F.col
SAMPLES = 1000
_LEVEL = {"INFO": 0, "WARNING": 1, "ERROR": 2}


def grouped(notices: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """code, severity, total and at most `samples` sample notices of each; samples are chosen by file and row."""
    total = notices.groupBy("code", "severity").agg(F.count("*").alias("total"))
    w = Window.partitionBy("code", "severity").orderBy(C("filename").asc_nulls_first(), C("csv_row").asc_nulls_first(), C("field").asc_nulls_first(), F.to_json("context"))
    few = notices.withColumn("_at", F.row_number().over(w)).where(C("_at") <= samples)
    one = F.struct("_at", "filename", "csv_row", "field", F.map_entries("context").alias("context"))
    few = few.groupBy("code", "severity").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x.dropFields("_at")).alias("samples"))
    return total.join(few, ["code", "severity"])


def counts(feed: Feed) -> DataFrame:
    """entity, n: distinct non-blank ids; agencies without any id count as rows."""
    out = None
    for entity, table, key in (("Shapes", "shapes", "shape_id"), ("Stops", "stops", "stop_id"), ("Routes", "routes", "route_id"), ("Trips", "trips", "trip_id"), ("Blocks", "trips", "block_id"), ("Agencies", "agency", "agency_id")):
        n = F.countDistinct(F.when(full(C(key)), C(key)))
        if entity == "Agencies":
            n = F.when(n == 0, F.count("*")).otherwise(n)
        one = feed.df(table).groupBy().agg(n.cast("long").alias("n")).select(F.lit(entity).alias("entity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def features(feed: Feed) -> DataFrame:
    """feature, present: in one pass over each table."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    any_ = F.count("*") > 0
    has: list[tuple[str, str, Column]] = [
        *[(name, table, any_) for name, table in (
            ("Pathway Connections", "pathways"), ("Levels", "levels"), ("Transfers", "transfers"), ("Shapes", "shapes"), ("Frequencies", "frequencies"), ("Feed Information", "feed_info"), ("Attributions", "attributions"),
            ("Translations", "translations"), ("Fares V1", "fare_attributes"), ("Fare Products", "fare_products"), ("Fare Media", "fare_media"), ("Zone-Based Fares", "areas"), ("Fare Transfers", "fare_transfer_rules"),
            ("Time-Based Fares", "timeframes"), ("Rider Categories", "rider_categories"), ("Booking Rules", "booking_rules"), ("Fixed-Stops Demand Responsive Transit", "location_groups"))],
        ("Pathway Signs", "pathways", some(full(C("signposted_as")) | full(C("reversed_signposted_as")))),
        ("Pathway Details", "pathways", some(C("max_slope").isNotNull() | C("min_width").isNotNull() | C("length").isNotNull() | C("stair_count").isNotNull())),
        ("Route Colors", "routes", some(C("route_color").isNotNull() | C("route_text_color").isNotNull())),
        ("Headsigns", "trips", some(full(C("trip_headsign")))), ("Headsigns", "stop_times", some(full(C("stop_headsign")))),
        ("Stops Wheelchair Accessibility", "stops", some(C("wheelchair_boarding").isNotNull())), ("Trips Wheelchair Accessibility", "trips", some(C("wheelchair_accessible").isNotNull())),
        ("Text-to-Speech", "stops", some(full(C("tts_stop_name")))), ("Bike Allowed", "trips", some(C("bikes_allowed").isNotNull())), ("Location Types", "stops", some(C("location_type").isNotNull())),
        ("In-station Traversal Time", "pathways", some(C("traversal_time").isNotNull())), ("Route-Based Fares", "routes", some(full(C("network_id")))), ("Route-Based Fares", "networks", any_),
        ("Continuous Stops", "routes", some(C("continuous_pickup").isNotNull() | C("continuous_drop_off").isNotNull())), ("Continuous Stops", "stop_times", some(C("continuous_pickup").isNotNull() | C("continuous_drop_off").isNotNull())),
        ("Zone-Based Demand Responsive Services", "stop_times", some(full(C("location_id")) & ~full(C("stop_id")))),
    ]
    out = None
    for table in dict.fromkeys(t for _, t, _ in has):
        mine = [(n, c) for n, t, c in has if t == table]
        one = feed.df(table).groupBy().agg(F.map_from_arrays(F.array(*[F.lit(n) for n, _ in mine]), F.array(*[c for _, c in mine])).alias("m")).select(F.explode("m").alias("feature", "present"))
        out = one if out is None else out.unionByName(one)
    legs = feed.df("stop_times").groupBy("trip_id").agg(*[F.bool_or(c).alias(n) for n, c in (("a", full(C("location_id"))), ("b", full(C("stop_id"))), ("c", C("arrival_time").isNotNull()), ("d", C("departure_time").isNotNull()))])
    deviating = legs.groupBy().agg(some(C("a") & C("b") & C("c") & C("d")).alias("present")).select(F.lit("Predefined Routes with Deviation").alias("feature"), "present")
    return out.unionByName(deviating).groupBy("feature").agg(F.bool_or("present").alias("present"))


def service_window(feed: Feed) -> DataFrame:
    """start, end: bounds of the services that trips use; one row.

    With both files, a service's bounds are those of its last calendar row, a late start moving the end, or of its added dates where it has no
    such row; then removed dates of these services, in order of dates, move a bound that they meet by a day. With one file the
    bounds are those of all its rows.
    """
    used = feed.df("trips").where(full(C("service_id"))).select("service_id").distinct()
    of_used = lambda table: feed.df(table).join(used, "service_id", "left_semi")
    bounds = lambda df, *columns: df.groupBy().agg(F.min(F.least(*columns, F.lit(None))).alias("start"), F.max(F.greatest(*columns, F.lit(None))).alias("end"))
    if not feed.has("calendar_dates"):
        return bounds(of_used("calendar").where("start_date is not null and end_date is not null"), "start_date", "end_date")
    dates = of_used("calendar_dates").where("date is not null")
    if not feed.has("calendar"):
        return bounds(dates, "date", "date")
    last = of_used("calendar").groupBy("service_id").agg(F.max_by(F.struct("start_date", "end_date"), "_row").alias("c"))
    last = last.select("service_id", C("c.start_date").alias("start"), F.greatest("c.start_date", "c.end_date").alias("end"))
    added = dates.where("exception_type = 1").join(last, "service_id", "left_anti").groupBy("service_id").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    whole = bounds(last.unionByName(added).where("start is not null and end is not null"), "start", "end")
    removed = dates.where("exception_type = 2").select("date").distinct()  # a row per date
    met = removed.crossJoin(F.broadcast(whole)).where("date between start and end")  # one row is broadcast
    met = met.withColumn("k", F.row_number().over(Window.partitionBy("start").orderBy("date")) - 1)
    moved = met.groupBy().agg(F.sum(F.when(F.datediff("date", "start") == C("k"), 1).otherwise(0)).alias("up"), F.max(F.when(C("date") == C("end"), 1).otherwise(0)).alias("down"))
    return whole.crossJoin(F.broadcast(moved)).select(F.date_add("start", F.coalesce("up", F.lit(0)).cast("int")).alias("start"), F.date_sub("end", F.coalesce("down", F.lit(0)).cast("int")).alias("end"))


def agencies(feed: Feed) -> DataFrame:
    """_row, name, url, phone, email of each agency."""
    return feed.df("agency").select("_row", *[C(f"agency_{n}").alias(n) for n in ("name", "url", "phone", "email")])


def files(feed: Feed) -> list[str]:
    """Names of the files that the feed has."""
    return sorted(file_of(t) if t != "locations" else GEOJSON for t in [*TABLES, "locations"] if feed.has(t))


def summary(feed: Feed, date: dt.date) -> dict:
    first = feed.df("feed_info").orderBy("_row").limit(1).collect()
    info = {k: (v.isoformat() if isinstance(v, dt.date) else v) for k, v in first[0].asDict().items() if k != "_row" and v is not None} if first else {}
    window = service_window(feed).collect()[0]
    if info.get("feed_lang"):
        # the JVM knows the names of languages
        locale = feed.spark._jvm.java.util.Locale
        info["feed_lang_name"] = locale.forLanguageTag(info["feed_lang"]).getDisplayName(locale.ENGLISH)
    return {
        "validationDate": date.isoformat(),
        "feedInfo": info | {"serviceWindowStart": window["start"] and window["start"].isoformat(), "serviceWindowEnd": window["end"] and window["end"].isoformat()},
        "agencies": [{k: r[k] for k in ("name", "url", "phone", "email")} for r in agencies(feed).orderBy("_row").toLocalIterator()],
        "files": sorted({*files(feed), "agency.txt", "routes.txt", "trips.txt", "stop_times.txt"}),
        "counts": {r["entity"]: r["n"] for r in counts(feed).collect()},
        "gtfsFeatures": sorted(r["feature"] for r in features(feed).where("present").collect()),
    }


def as_dict(notices: DataFrame, about: dict, samples: int = SAMPLES) -> dict:
    rows = sorted(grouped(notices, samples).collect(), key=lambda r: (r["code"], _LEVEL[r["severity"]]))
    one = lambda s: {"filename": s["filename"], "csvRowNumber": s["csv_row"], "fieldName": s["field"]} | {e["key"]: e["value"] for e in s["context"] or ()}
    return {"summary": about, "notices": [{"code": r["code"], "severity": r["severity"], "totalNotices": r["total"], "sampleNotices": [{k: v for k, v in one(s).items() if v is not None} for s in r["samples"]]} for r in rows]}


def _write(path: str, content: str) -> None:
    """Whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(content)
    os.replace(temporary, path)


def write_json(report: dict, path: str, pretty: bool = False) -> None:
    _write(path, json.dumps(report, indent=2 if pretty else None, ensure_ascii=False))


STYLE = "body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}"


def _point(value: object) -> tuple[float, float] | None:
    """A latitude and longitude written as a list of two."""
    try:
        lat, lon = json.loads(str(value))
        return float(lat), float(lon)
    except (TypeError, ValueError):
        return None


def _cell(key: str, value: object) -> str:
    """A value in a table; places link to a map."""
    said = html.escape("" if value is None else str(value))
    if (key.startswith("match") or key.endswith("Location")) and (p := _point(value)):
        return f"<a href='https://www.openstreetmap.org/?mlat={p[0]}&amp;mlon={p[1]}#map=17/{p[0]}/{p[1]}'>{said}</a>"
    return said


def _list(items: list[str]) -> str:
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"


def write_html(report: dict, path: str) -> None:
    e = lambda x: html.escape("" if x is None else str(x))
    about = report["summary"]
    parts = [f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>Feed report</title><style>{STYLE}</style></head><body><h1>Feed report</h1>"]
    parts.append(f"<p>Validated for {e(about.get('validationDate'))}</p>")
    info = {k: v for k, v in about.get("feedInfo", {}).items() if v is not None}
    parts.append("<h2>Feed info</h2><table>" + "".join(f"<tr><th>{e(k)}</th><td>{e(v)}</td></tr>" for k, v in info.items()) + "</table>")
    parts.append("<h2>Counts</h2>" + _list([f"{e(k)}: {e(v)}" for k, v in about.get("counts", {}).items()]))
    parts.append("<h2>Agencies</h2>" + _list([" ".join(e(a[k]) for k in ("name", "url", "phone", "email") if a.get(k)) for a in about.get("agencies", [])]))
    parts.append(f"<h2>Files</h2><p>{e(', '.join(about.get('files', [])))}</p><h2>Features</h2><p>{e(', '.join(about.get('gtfsFeatures', [])))}</p>")
    for n in report["notices"]:
        keys = list(dict.fromkeys(k for s in n["sampleNotices"] for k in s))
        body = "".join("<tr>" + "".join(f"<td>{_cell(k, s.get(k))}</td>" for k in keys) + "</tr>" for s in n["sampleNotices"])
        heads = "".join(f"<th>{e(k)}</th>" for k in keys)
        parts.append(f"<h3>{e(n['severity'])}: {e(n['code'])} ({n['totalNotices']})</h3><table><tr>{heads}</tr>{body}</table>")
    _write(path, "".join(parts) + "</body></html>")


def write_sarif(report: dict, path: str) -> None:
    level = {"ERROR": "error", "WARNING": "warning", "INFO": "note"}
    rules, results = [], []
    for n in report["notices"]:
        rules.append({"id": n["code"], "defaultConfiguration": {"level": level[n["severity"]]}})
        for s in n["sampleNotices"]:
            place = {"physicalLocation": {"artifactLocation": {"uri": s["filename"]}, **({"region": {"startLine": int(s["csvRowNumber"])}} if s.get("csvRowNumber") else {})}} if s.get("filename") else None
            words = n["code"].replace("_", " ") + "".join(f" | {k}: {v}" for k, v in s.items() if k not in ("filename", "csvRowNumber"))
            results.append({"ruleId": n["code"], "level": level[n["severity"]], "message": {"text": words}} | ({"locations": [place]} if place else {}))
    run = {"tool": {"driver": {"name": "tramline", "rules": list({r["id"]: r for r in rules}.values())}}, "results": results}
    _write(path, json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}))

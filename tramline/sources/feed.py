"""Reading feeds: folders, zips or bytes of CSV files, with the notices that reading gives.

The files of a folder, local or of any store that Spark reads, are read in splits (see lines.py). A zip can't be split: each of its members is
decoded by one task, members side by side. Cell checks are columns over the raw text, made from the model, and typed tables are projections
of rows that pass. So a row is dropped if a required typed cell doesn't parse.
"""

from __future__ import annotations

import csv
import io
import itertools
import os
import re
import urllib.request
import uuid
import zipfile
import zoneinfo
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..feed import NOTICE, Feed, RunOptions
from ..functions import exprs
from ..functions.checkpoint import cut, shared_dir
from ..functions.urls import valid_url
from ..functions.workers import importable
from ..model import GEOJSON, REQUIRED_TABLES, SPARK_TYPE, TABLES, file_of
from .geojson import FATAL, places_of
from .lines import literal, records_of, stored

C = F.col
# Fields by kind of check.
MIXED_CASE = set("agency_name drop_off_message level_name location_group_name message network_name pickup_message reversed_signposted_as route_desc route_long_name route_short_name signposted_as stop_name trip_headsign trip_short_name".split())
NOT_NEGATIVE = set("min_transfer_time route_sort_order rule_priority shape_pt_sequence stop_sequence transfer_duration length shape_dist_traveled amount price".split())
POSITIVE = set("duration_limit headway_secs traversal_time min_width".split())
NOT_ZERO = {"stair_count"}
BOUNDS = {"stop_lat": 90, "shape_pt_lat": 90, "stop_lon": 180, "shape_pt_lon": 180}
TIMEZONES = {"agency_timezone", "stop_timezone"}
LANGUAGES = {"agency_lang", "feed_lang", "language"}
CURRENCIES = {"currency", "currency_type"}
URLS = set("agency_fare_url agency_url attribution_url booking_url eligibility_url feed_contact_url feed_publisher_url info_url route_branding_url route_url stop_url".split())
EMAILS = {"agency_email", "attribution_email", "feed_contact_email"}
PHONES = {"agency_phone", "attribution_phone", "phone_number", "stop_phone"}
ENUMS = {
    "location_type": range(5), "wheelchair_boarding": range(3), "route_type": [*range(8), 11, 12], "continuous_pickup": range(4), "continuous_drop_off": range(4), "pickup_type": range(4),
    "drop_off_type": range(4), "booking_type": range(3), "direction_id": range(2), "wheelchair_accessible": range(3), "bikes_allowed": range(3), "monday": range(2), "tuesday": range(2),
    "wednesday": range(2), "thursday": range(2), "friday": range(2), "saturday": range(2), "sunday": range(2), "exception_type": (1, 2), "payment_method": range(2), "transfers": range(3),
    "exact_times": range(2), "transfer_type": range(6), "pathway_mode": range(1, 8), "is_bidirectional": range(2), "is_producer": range(2), "is_operator": range(2), "is_authority": range(2),
    "timepoint": range(2), "fare_media_type": range(5), "duration_limit_type": range(4), "fare_transfer_type": range(3), "is_default_fare_category": range(2),
}
#: The last line that a row may begin on.
MOST_ROWS = 1_000_000_000
#: Decimals of currencies that don't have two.
DECIMALS = {0: "BIF CLP DJF GNF ISK JPY KMF KRW PYG RWF UGX UYI VND VUV XAF XOF XPF".split(), 3: "BHD IQD JOD KWD LYD OMR TND".split(), 4: "CLF UYW".split()}
CURRENCY_CODES = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP "
    "GMD GNF GTQ GYD HKD HNL HRK HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB "
    "PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SLL SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU UYW UZS VED VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWL"
).split()


def opened(source: str):
    """A file to read from anywhere in it: a local path, or a URI of a store, by Arrow's file systems."""
    if "://" not in source:
        return open(source, "rb")  # noqa: SIM115
    store, path = pa_fs.FileSystem.from_uri(source)
    return store.open_input_file(path)


class Files:
    """Names and bytes of a feed: a folder, a zip, or bytes of one. Names match by case first, then without."""

    def __init__(self, source: str | bytes):
        self.source = source
        if isinstance(source, bytes):
            self.zip: zipfile.ZipFile | None = zipfile.ZipFile(io.BytesIO(source))
        else:
            self.zip = None if os.path.isdir(source) else zipfile.ZipFile(opened(source))
        every = self.zip.namelist() if self.zip else os.listdir(source)
        self.nested = [n for n in every if self.zip and "/" in n.strip("/") and n.rpartition("/")[2].lower() in KNOWN]
        self.names = sorted(n for n in every if "/" not in n) if self.zip else sorted(n for n in every if os.path.isfile(os.path.join(source, n)))

    def find(self, name: str) -> str | None:
        if name in self.names:
            return name
        return min((n for n in self.names if n.lower() == name), key=str.lower, default=None)

    def stream(self, name: str) -> io.BufferedIOBase:
        return self.zip.open(name) if self.zip else open(os.path.join(self.source, name), "rb")  # noqa: SIM115

    def read(self, name: str) -> bytes:
        with self.stream(name) as f:
            return f.read()

    def head(self, name: str, most: int = 1 << 20) -> bytes:
        """The beginning of a file, up to the end of a line: enough for its header."""
        with self.stream(name) as f:
            raw = f.read(most)
        return raw if len(raw) < most else raw[: raw.rfind(b"\n") + 1]


class SharedFolder:
    """Names and bytes of a feed in a folder of a store that Spark reads, by its URI."""

    def __init__(self, spark: SparkSession, uri: str):
        self.uri, self._path = uri.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.uri).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path(self.uri)):
            raise FileNotFoundError(uri)
        self.zip, self.nested = None, []
        self.names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.uri)) if s.isFile())

    find = Files.find

    def head(self, name: str, most: int = 1 << 20) -> bytes:
        stream = self._fs.open(self._path(f"{self.uri}/{name}"))
        raw = bytes(stream.readNBytes(most))
        stream.close()
        return raw if len(raw) < most else raw[: raw.rfind(b"\n") + 1]

    def read(self, name: str) -> bytes:
        return self.head(name, (1 << 31) - 9)


KNOWN = {file_of(t) for t in TABLES} | {GEOJSON}


def fetch(spark: SparkSession, url: str, folder: str | None = None) -> str:
    """Download a zip into a folder that executors see too, the shared one by default, in pieces; returns its path or URI."""
    jvm = spark._jvm
    path = f"{(folder or shared_dir(spark)).rstrip('/')}/{uuid.uuid4().hex}-{re.sub('[^A-Za-z0-9._-]', '_', url.rpartition('/')[2]) or 'feed.zip'}"
    to = jvm.org.apache.hadoop.fs.Path(path)
    with urllib.request.urlopen(url) as got:  # noqa: S310
        out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
        while piece := got.read(1 << 22):
            out.write(bytearray(piece))
        out.close()
    return local(path)


def local(uri: str) -> str:
    """A URI of the local file system as a path; others as they are."""
    return re.sub("^file:/+", "/", uri)


def records(raw: bytes | io.BufferedIOBase) -> Iterator[tuple[int, list[str]]]:
    """Line (from 1) and cells of each record, of bytes or, a buffer at a time, of a stream. A byte-order mark goes; bytes that are no UTF-8 become U+FFFD; blank
    lines give no cells."""
    reader = csv.reader(io.TextIOWrapper(io.BytesIO(raw) if isinstance(raw, bytes) else raw, "utf-8-sig", "replace", newline=""))
    line = 1
    for cells in reader:
        yield line, cells
        line = reader.line_num + 1


def _cells(spark: SparkSession, files: list[tuple[str, str | None, str, bytes | None]]) -> DataFrame:
    """file, line, cells: records of all files(file, source, member, raw) but their headers. Tasks read the source themselves, unless raw is given; a member of a zip is
    unpacked as it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, source, member, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = records(Files(source).stream(member) if raw is None else raw)
                next(body, None)
                while some := list(itertools.islice(body, 20_000)):
                    lines, rows = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(lines, pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["file", "line", "cells"])

    importable(spark)
    return spark.createDataFrame(files, "file string, source string, member string, raw binary").repartition(max(1, len(files)), "file").mapInArrow(run, "file string, line long, cells array<string>")


def header_notices(table: str, header: list[str], options: RunOptions) -> list[tuple]:
    file, out, seen = file_of(table), [], {}
    known = {c.name for c in TABLES[table] if c.listed}
    for i, name in enumerate(header, 1):
        if not name:
            out.append(("empty_column_name", "ERROR", file, None, None, {"index": str(i)}))
        elif name in seen:
            out.append(("duplicated_column", "ERROR", file, None, name, {"fieldName": name, "firstIndex": str(seen[name]), "secondIndex": str(i)}))
        else:
            seen[name] = i
            if name not in known:
                out.append(("unknown_column", "INFO", file, None, name, {"fieldName": name, "index": str(i)}))
    for c in TABLES[table]:
        if c.name not in seen and c.required:
            out.append(("missing_required_column", "ERROR", file, None, c.name, {"fieldName": c.name}))
        elif c.name not in seen and c.recommended and options.thorough:
            out.append(("missing_recommended_column", "WARNING", file, None, c.name, {"fieldName": c.name}))
    return out


def _first(value: Column, field: str, kind: str, options: RunOptions) -> list[tuple[Column, str, str]]:
    """(fails, code, severity) of a non-blank cell; the first that fails counts."""
    number = exprs.parse_int(value) if kind in ("int", "enum") else exprs.parse_double(value)
    if field in ENUMS:
        return [(number.isNull(), "invalid_integer", "ERROR"), (~number.isin(list(ENUMS[field])), "unexpected_enum_value", "WARNING")]
    if kind in ("int", "double"):
        out = [(number.isNull(), "invalid_integer" if kind == "int" else "invalid_float", "ERROR")]
        bad = F.lit(False)
        if field in NOT_NEGATIVE:
            bad = number < 0
        elif field in POSITIVE:
            bad = number <= 0
        elif field in NOT_ZERO:
            bad = number == 0
        elif field in BOUNDS:
            bad = F.abs(number) > BOUNDS[field]
        return [*out, (bad, "number_out_of_range", "ERROR")]
    if kind in ("date", "time", "color"):
        return [({"date": exprs.parse_date, "time": exprs.parse_time, "color": exprs.parse_color}[kind](value).isNull(), f"invalid_{kind}", "ERROR")]
    if field in TIMEZONES:
        return [(~value.isin(sorted(zoneinfo.available_timezones())), "invalid_timezone", "ERROR")]
    if field in LANGUAGES and options.thorough:
        return [(~value.rlike("^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*$"), "invalid_language_code", "ERROR")]
    if field in CURRENCIES:
        return [(~value.isin(CURRENCY_CODES), "invalid_currency", "ERROR")]
    if field in URLS:
        return [(~valid_url(value), "invalid_url", "ERROR")]
    if field in EMAILS:
        return [(~value.rlike(r"^[^@\s]+@[^@\s.]([^@\s]*\.[^@\s]*)?[^@\s.]$") | ~value.rlike(r"@[^@]*\."), "invalid_email", "ERROR")]
    if field in PHONES and options.country:
        return [(~value.rlike(r"^[0-9+\-(). ]+$") | (F.length(F.regexp_replace(value, "[^0-9]", "")) < 2), "invalid_phone_number", "ERROR")]
    return []


def cell_notices(raw: DataFrame, table: str, header: list[str], options: RunOptions) -> DataFrame:
    """Notices of rows(line, cells): blank and ragged rows, then cells."""
    file = file_of(table)
    names = ("code", "severity", "field")
    one = lambda code, severity, field, value: F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, (code, severity, field))], value.cast("string").alias("value"))  # noqa: B905, E731
    empty = (F.size("cells") == 0) | ~F.exists("cells", lambda c: F.trim(c) != "")
    ragged = F.size("cells") != len(header)
    checks: list[Column] = []
    for c in TABLES[table]:
        if c.name not in header or not c.listed:
            continue
        cell = F.get("cells", F.lit(header.index(c.name)))
        value = F.regexp_replace(cell, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
        there = value != ""
        if c.required:
            checks.append(F.when(~there, one("missing_required_field", "ERROR", c.name, F.lit(None))))
        checks.append(F.when(cell.rlike(r"[\n\r]"), one("new_line_in_value", "ERROR", c.name, cell)))
        checks.append(F.when(F.contains(cell, F.lit("�")), one("invalid_character", "ERROR", c.name, cell)))
        if c.name.endswith("_id") or c.name == "parent_station":
            checks.append(F.when(there & cell.rlike(r"[^\x20-\x7E]"), one("non_ascii_or_non_printable_char", "WARNING", c.name, cell)))
        if c.name in MIXED_CASE:
            checks.append(F.when(there & exprs.mixed_case(value), one("mixed_case_recommended_field", "WARNING", c.name, cell)))
        picked = F.lit(None)
        for fails, code, severity in reversed(_first(value, c.name, c.kind, options)):
            picked = F.when(F.coalesce(fails, F.lit(False)), one(code, severity, c.name, value)).otherwise(picked)
        if _first(value, c.name, c.kind, options):
            checks.append(F.when(there, picked))
    if table == "fare_products" and {"amount", "currency"} <= set(header):
        amount, currency = (F.trim(F.get("cells", F.lit(header.index(n)))) for n in ("amount", "currency"))
        scale = F.length(F.coalesce(F.try_element_at(F.split(amount, r"\."), F.lit(2)), F.lit("")))
        want = F.lit(2)
        for n, codes in DECIMALS.items():
            want = F.when(currency.isin(codes), n).otherwise(want)
        checks.append(F.when(currency.isin(CURRENCY_CODES) & exprs.parse_double(amount).isNotNull() & (scale != want), one("invalid_currency_amount", "ERROR", "amount", amount)))
    nothing = F.array().cast("array<struct<code:string,severity:string,field:string,value:string>>")
    if options.thorough:
        checks.append(F.when(~parses(table, header), one("csv_parsing_failed", "ERROR", None, F.lit(None))))
    picked = F.when(C("line") > MOST_ROWS, F.array(one("too_many_rows", "ERROR", None, C("line"))))
    picked = picked.when(empty, F.array(one("empty_row", "WARNING", None, F.lit(None))) if options.thorough else nothing)
    picked = picked.when(ragged, F.array(one("invalid_row_length", "ERROR", None, F.size("cells")))).otherwise(F.array_compact(F.array(*checks)))
    each = raw.select("line", F.explode(picked).alias("n"))
    context = F.map_filter(F.create_map(F.lit("fieldName"), C("n.field"), F.lit("fieldValue"), C("n.value")), lambda k, v: v.isNotNull())
    return each.select(C("n.code").alias("code"), C("n.severity").alias("severity"), F.lit(file).alias("filename"), C("line").alias("csv_row"), C("n.field").alias("field"), context.alias("context"))


def cells_of(table: str, header: list[str]) -> tuple[list[Column], Column]:
    """The typed columns of a table, from trimmed cells, and whether the row is kept: each number, date or time that is there or required parses."""
    parse = {"int": exprs.parse_int, "enum": exprs.parse_int, "double": exprs.parse_double, "date": exprs.parse_date, "time": exprs.parse_time, "color": exprs.parse_color}
    columns, kept = [], F.lit(True)
    for c in TABLES[table]:
        if c.name not in header:
            columns.append(F.lit(None).cast(SPARK_TYPE[c.kind]).alias(c.name))
            continue
        value = F.regexp_replace(F.get("cells", F.lit(header.index(c.name))), r"^\s+|\s+$", "")
        value = F.when(value != "", value)
        if c.kind == "text":
            columns.append(value.alias(c.name))
            continue
        got = parse[c.kind](value)
        if c.kind == "enum":
            got = F.when(value.isNotNull(), F.coalesce(got, F.lit(-1)))
            if c.name in ENUMS and c.name != "route_type":
                got = F.when(got.isin(list(ENUMS[c.name])), got).otherwise(F.when(got.isNotNull(), -1))
        columns.append(got.cast(SPARK_TYPE[c.kind]).alias(c.name))
        kept &= got.isNotNull() if c.required else (value.isNull() | got.isNotNull())
    return columns, kept


def parses(table: str, header: list[str]) -> Column:
    return cells_of(table, header)[1]


def typed(raw: DataFrame, table: str, header: list[str]) -> DataFrame:
    """Rows of the right length, trimmed and typed. One whose required number, date or time doesn't parse is left out."""
    columns, kept = cells_of(table, header)
    whole = (F.size("cells") == len(header)) & F.exists("cells", lambda c: F.trim(c) != "")
    return raw.where(whole & kept).select(C("line").alias("_row"), *columns)


def read_feed(spark: SparkSession, source: str | bytes, options: RunOptions | None = None) -> Feed:
    """A feed from a folder, a zip, a URL's download or bytes, with its notices and the tables that had errors."""
    options = options or RunOptions()
    zip_uri = isinstance(source, str) and "://" in source and source.lower().endswith(".zip")
    uri = source if isinstance(source, str) and "://" in source and not zip_uri else None
    files = SharedFolder(spark, uri) if uri else Files(source)
    notices: list[tuple] = [("unknown_file", "INFO", n, None, None, {"filename": n}) for n in files.names if n.lower() not in KNOWN and n != ".DS_Store"]
    if files.nested and not any(n.lower() in KNOWN for n in files.names):
        notices.append(("invalid_input_files_in_subfolder", "ERROR", None, None, None, {}))
    headers: dict[str, list[str]] = {}
    raw_files: list[tuple[str, str | None, str, bytes | None]] = []
    for table in TABLES:
        name = files.find(file_of(table))
        if name is None:
            if table in REQUIRED_TABLES and not (table == "stops" and files.find(GEOJSON)):
                notices.append(("missing_required_file", "ERROR", file_of(table), None, None, {"filename": file_of(table)}))
            continue
        header = next((cells for _, cells in records(files.head(name))), [])
        headers[table] = [h.strip() for h in header]
        if not header:
            notices.append(("empty_file", "ERROR", file_of(table), None, None, {"filename": file_of(table)}))
            continue
        notices += header_notices(table, headers[table], options)
        raw_files.append((table, None, name, files.read(name)) if isinstance(source, bytes) else (table, source if uri or zip_uri else os.path.abspath(source), name, None))
    if not raw_files:
        cells = None
    elif files.zip:
        cells = stored(_cells(spark, raw_files))
    else:
        cells = records_of(spark, {table: f"{at if uri else 'file://' + at}/{name}" for table, at, name, _ in raw_files})
    lacking = {n[2] for n in notices if n[0] in ("missing_required_column", "duplicated_column")}
    tables: dict[str, DataFrame] = {}
    frames = [spark.createDataFrame(notices, NOTICE)]
    for table, header in headers.items():
        mine = cells.where(C("file") == table) if cells is not None and header else None
        if mine is None or file_of(table) in lacking:
            tables[table] = spark.createDataFrame([], "_row long, " + ", ".join(f"{c.name} {SPARK_TYPE[c.kind]}" for c in TABLES[table]))
            continue
        tables[table] = typed(mine, table, header)
        frames.append(cell_notices(mine, table, header, options))
    feed = Feed(spark, tables, headers, files=files.names)
    name = files.find(GEOJSON)
    if name is not None:
        if isinstance(files, SharedFolder) or not files.zip:
            document = spark.read.option("wholetext", True).text(literal(f"{files.uri}/{name}" if uri else f"file://{os.path.abspath(source)}/{name}"))
        else:
            document = spark.createDataFrame([(files.read(name),)], "value binary")
        tables["locations"], feed.geojson_notices = map(cut, places_of(document, options))
        feed.geojson_fatal = not feed.geojson_notices.where(C("code").isin(*FATAL)).isEmpty()
    feed.notices = cut(reduce(DataFrame.unionAll, frames))
    bad = feed.notices.where("severity = 'ERROR' and filename is not null").select("filename").distinct().collect()  # at most a row per file
    feed.broken = {r["filename"].removesuffix(".txt") for r in bad if r["filename"].removesuffix(".txt") in tables}
    return feed

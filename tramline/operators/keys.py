"""Presence, required fields, unique keys and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..feed import BROKEN, Feed, RunOptions, note, said
from ..functions.exprs import blank, full
from ..model import EDGES, REQUIRED_FIELDS, TRANSLATED, UNIQUE, file_of
from . import rule


@rule("CalendarPresenceValidator")
def calendar_presence(feed: Feed, options: RunOptions):
    if not feed.has("calendar") and not feed.has("calendar_dates"):
        return said(feed, "missing_calendar_and_calendar_date_files", "ERROR", None)


def _is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


@rule("MissingStopsFileValidator")
def missing_stops_file(feed: Feed, options: RunOptions):
    if feed.has("stops") and not feed.has("locations") and not feed.headers.get("stops") and _is_empty(feed.df("stops")):
        return said(feed, "missing_required_file", "ERROR", "stops.txt")


@rule("RequiredTablesNotEmptyValidator", thorough=True)
def required_not_empty(feed: Feed, options: RunOptions):
    tables = [t for t in ("agency", "routes", "trips", "stop_times", "stops") if feed.has(t) and (t != "stops" or feed.headers.get("stops"))]
    return [said(feed, "empty_file", "ERROR", file_of(t)) for t in tables if _is_empty(feed.df(t))]


@rule("RequiredFieldsNonEmptyValidator", thorough=True)
def required_fields(feed: Feed, options: RunOptions):
    out = []
    for table, fields in REQUIRED_FIELDS.items():
        if feed.has(table):
            lacking = F.array_compact(F.array(*[F.when(blank(F.col(f)), F.lit(f)) for f in fields]))
            out.append(note(feed.df(table).select("_row", F.explode(lacking).alias("f")), "missing_required_field", "ERROR", table, at=F.col("f")))
    return out


def missing_parents(child: DataFrame, field: str, parent: DataFrame, key: str, child_table: str, parent_file: str | None = None, parent_table: str = "") -> DataFrame:
    """foreign_key_violation of rows whose non-blank field is no key of parent."""
    keys = parent.select(F.col(key).alias("_key")).where(full(F.col("_key"))).distinct()
    lost = child.where(full(F.col(field))).join(keys, F.col(field) == F.col("_key"), "left_anti")
    context = {"childFilename": file_of(child_table), "childFieldName": field, "parentFilename": parent_file or file_of(parent_table), "parentFieldName": key, "fieldValue": F.col(field)}
    return note(lost, "foreign_key_violation", "ERROR", child_table, context, at=field)


def checked_edges(feed: Feed, options: RunOptions) -> list[tuple[str, str, str, str]]:
    """(child, field, parent, key) of the references that hold for this feed."""
    out = []
    for child, field, parent, key in EDGES:
        if not feed.has(child) or feed.status(child) == BROKEN or feed.status(parent) == BROKEN:
            continue
        # a reference to an absent file fails for each row, where the file is one that such a reference presumes
        if not feed.has(parent) and ((child, field) in {("routes", "agency_id"), ("trips", "route_id"), ("stop_times", "trip_id")} or parent in ("booking_rules", "levels")):
            continue
        if (child, field) == ("stops", "level_id") and not feed.has("levels"):
            continue
        if child == "route_networks" and field == "network_id" and (not feed.has(parent) or _is_empty(feed.df(parent).where(full(F.col("network_id"))))):
            continue
        if child == "fare_transfer_rules" and key == "leg_group_id":
            if not feed.has(parent) or not _is_empty(feed.df(parent).where(blank(F.col("fare_product_id")) | blank(F.col("leg_group_id")))):
                continue
        if child == "fare_leg_join_rules" and field.endswith("area_id") and not options.thorough:
            continue
        out.append((child, field, parent, key))
    return out


@rule("ReferentialIntegrityValidator")
def referential_integrity(feed: Feed, options: RunOptions):
    """One scan of each table, and one join of all references with all keys."""
    edges = checked_edges(feed, options)
    if not edges:
        return None
    keys = list(dict.fromkeys((parent, key) for _, _, parent, key in edges))

    def stacked(table: str, cells: list[tuple[int, int, str]]) -> DataFrame:
        """_row, edge, key and value of the non-blank cells(edge, key, column) of a table."""
        each = F.array(*[F.struct(F.lit(e).alias("edge"), F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for e, k, c in cells])
        return feed.df(table).select("_row", F.explode(each).alias("x")).select("_row", "x.*").where(full(F.col("value")))

    children = [stacked(t, [(e, keys.index((p, k)), f) for e, (c, f, p, k) in enumerate(edges) if c == t]) for t in dict.fromkeys(c for c, _, _, _ in edges)]
    parents = [stacked(t, [(0, i, k) for i, (p, k) in enumerate(keys) if p == t]) for t in dict.fromkeys(p for p, _ in keys)]
    known = reduce(DataFrame.unionAll, parents).select("key", "value").distinct().withColumn("known", F.lit(True))
    # not as an anti-join: Spark would push that into the union, so that each task sorts all keys again for each child table
    lost = reduce(DataFrame.unionAll, children).join(known, ["key", "value"], "left").where("known is null")
    of = lambda said: F.element_at(F.array(*[F.lit(said(*e)) for e in edges]), F.col("edge") + 1)
    child, field = of(lambda c, f, p, k: file_of(c)), of(lambda c, f, p, k: f)
    context = {"childFilename": child, "childFieldName": field, "parentFilename": of(lambda c, f, p, k: file_of(p)), "parentFieldName": of(lambda c, f, p, k: k), "fieldValue": F.col("value")}
    return note(lost, "foreign_key_violation", "ERROR", None, context, at=field).withColumn("filename", F.col("context")["childFilename"])


def repeats(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows whose keys an earlier row has, with that row's `_first`."""
    columns = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    w = Window.partitionBy(*names).orderBy("_row")
    return df.select("*", *columns).withColumn("_at", F.row_number().over(w)).withColumn("_first", F.first("_row").over(w)).where("_at > 1")


def _duplicates(feed: Feed, table: str, keys: list[str], df: DataFrame | None = None) -> DataFrame:
    rows = repeats(feed.df(table) if df is None else df, [F.col(k) for k in keys])
    if len(keys) == 1:
        context = {"fieldName": keys[0], "fieldValue": F.col(keys[0]), "prevCsvRowNumber": F.col("_first")}
        return note(rows, "duplicate_key", "ERROR", table, context, at=keys[0])
    context = {"oldCsvRowNumber": F.col("_first"), "newCsvRowNumber": F.col("_row")}
    for i, k in enumerate(keys, 1):
        context |= {f"fieldName{i}": k, f"fieldValue{i}": F.col(k)}
    return note(rows, "duplicate_key", "ERROR", table, context)


@rule("DuplicateKeyValidator")
def duplicate_key(feed: Feed, options: RunOptions):
    out = []
    for table, key in UNIQUE.items():
        if feed.has(table):
            rows = feed.df(table).where(full(F.col(key)))
            if table == "agency":
                several = feed.df("agency").groupBy().count().where("count > 1").select(F.lit(1).alias("_one"))
                rows = rows.withColumn("_one", F.lit(1)).join(several, "_one", "left_semi")
            out.append(_duplicates(feed, table, [key], rows))
    if feed.has("fare_products"):
        rows = feed.df("fare_products").where(full(F.col("fare_product_id")))
        if options.thorough:
            out.append(_duplicates(feed, "fare_products", ["fare_product_id"], rows))
        else:
            out.append(_duplicates(feed, "fare_products", ["fare_product_id", "fare_media_id"], rows))
    if feed.has("transfers"):
        out.append(_duplicates(feed, "transfers", ["from_stop_id", "to_stop_id", "from_trip_id", "to_trip_id", "from_route_id", "to_route_id"]))
    return out


@rule("DuplicateStopSequenceValidator", needs="stop_times")
def duplicate_stop_sequence(feed: Feed, options: RunOptions):
    return _duplicates(feed, "stop_times", ["trip_id", "stop_sequence"], feed.df("stop_times").where(full(F.col("trip_id"))))


@rule("DuplicateFareMediaValidator", needs="fare_media")
def duplicate_fare_media(feed: Feed, options: RunOptions):
    keyed = feed.df("fare_media")
    w = Window.partitionBy(F.trim(F.coalesce("fare_media_name", F.lit(""))), "fare_media_type").orderBy("_row")
    rows = keyed.withColumn("_at", F.row_number().over(w)).withColumn("_old", F.first(F.struct("_row", "fare_media_id")).over(w)).where("_at > 1")
    context = {"csvRowNumber1": F.col("_old._row"), "fareMediaId1": F.col("_old.fare_media_id"), "csvRowNumber2": F.col("_row"), "fareMediaId2": F.col("fare_media_id")}
    return note(rows, "duplicate_fare_media", "WARNING", "fare_media", context)


@rule("DuplicateRouteNameValidator", needs="routes")
def duplicate_route_name(feed: Feed, options: RunOptions):
    short, long = (F.trim(F.coalesce(c, F.lit(""))) for c in ("route_short_name", "route_long_name"))
    rows = feed.df("routes").withColumn("_s", short).withColumn("_l", long).where((F.col("_s") != "") | (F.col("_l") != ""))
    w = Window.partitionBy("_s", "_l", "route_type", "agency_id").orderBy("_row")
    rows = rows.withColumn("_at", F.row_number().over(w)).withColumn("_old", F.first(F.struct("_row", "route_id")).over(w)).where("_at > 1")
    context = {"csvRowNumber1": F.col("_old._row"), "routeId1": F.col("_old.route_id"), "csvRowNumber2": F.col("_row"), "routeId2": F.col("route_id"), "routeShortName": F.col("_s"), "routeLongName": F.col("_l"), "routeTypeValue": F.col("route_type"), "agencyId": F.col("agency_id")}
    return note(rows, "duplicate_route_name", "WARNING", "routes", context)


def _services(feed: Feed) -> DataFrame:
    return feed.df("calendar").select("service_id").unionByName(feed.df("calendar_dates").select("service_id"))


@rule("TripServiceIdForeignKeyValidator", gated="trips calendar calendar_dates", needs="trips")
def trip_service(feed: Feed, options: RunOptions):
    return missing_parents(feed.df("trips"), "service_id", _services(feed), "service_id", "trips", "calendar.txt or calendar_dates.txt")


@rule("TimeframeServiceIdForeignKeyValidator", gated="timeframes calendar calendar_dates", needs="timeframes")
def timeframe_service(feed: Feed, options: RunOptions):
    if feed.header("timeframes", "service_id"):
        return missing_parents(feed.df("timeframes"), "service_id", _services(feed), "service_id", "timeframes", "calendar.txt or calendar_dates.txt")


@rule("LocationIdForeignKeyValidator", gated="stop_times", needs="stop_times")
def location_id_foreign_key(feed: Feed, options: RunOptions):
    if not feed.geojson_fatal:
        places = feed.tables["locations"].select(F.col("location_id").alias("id")) if feed.has("locations") else feed.spark.createDataFrame([], "id string")
        return missing_parents(feed.df("stop_times"), "location_id", places, "id", "stop_times", "locations.geojson")


@rule("LocationsGeoJsonPresenceValidator", needs="stop_times", thorough=True)
def locations_presence(feed: Feed, options: RunOptions):
    if not feed.has("locations") and not _is_empty(feed.df("stop_times").where(full(F.col("location_id")))):
        return said(feed, "missing_required_file", "ERROR", "locations.geojson")


@rule("LocationsGeoJsonNoticesValidator")
def locations_notices(feed: Feed, options: RunOptions):
    return feed.geojson_notices if getattr(feed, "geojson_notices", None) is not None else None


@rule("FareRulesValidator", needs="fare_rules", gated="fare_rules fare_attributes routes")
def fare_rules(feed: Feed, options: RunOptions):
    if not feed.has("fare_attributes"):
        return said(feed, "missing_required_file", "ERROR", "fare_attributes.txt")
    rows = feed.df("fare_rules")
    return [missing_parents(rows, f, feed.df(p), f, "fare_rules", parent_table=p) for f, p in (("fare_id", "fare_attributes"), ("route_id", "routes"))]


def _networks(feed: Feed) -> DataFrame:
    return feed.df("routes").select("network_id").unionByName(feed.df("networks").select("network_id"))


@rule("FareLegRuleNetworkIdForeignKeyValidator", needs="fare_leg_rules", gated="fare_leg_rules routes networks")
def fare_leg_network(feed: Feed, options: RunOptions):
    return missing_parents(feed.df("fare_leg_rules"), "network_id", _networks(feed), "network_id", "fare_leg_rules", "routes.txt or networks.txt")


@rule("FareLegJoinRuleValidator", needs="fare_leg_join_rules")
def fare_leg_join(feed: Feed, options: RunOptions):
    rows = feed.df("fare_leg_join_rules")
    known = _networks(feed)
    out = [missing_parents(rows.withColumn("network_id", F.col(f)), f, known, "network_id", "fare_leg_join_rules", "routes.txt or networks.txt") for f in ("from_network_id", "to_network_id")]
    sides = F.array_compact(F.array(*[F.when(blank(F.col(a)) & full(F.col(b)), F.lit(a)) for a, b in (("from_stop_id", "to_stop_id"), ("to_stop_id", "from_stop_id"))]))
    return [*out, note(rows.select("_row", F.explode(sides).alias("f")), "missing_required_field", "ERROR", "fare_leg_join_rules", at=F.col("f"))]


def _unused(feed: Feed, table: str, key: str, users: DataFrame, code: str, context: dict, once: bool = False, severity: str = "WARNING") -> DataFrame:
    rows = feed.df(table).where(full(F.col(key)))
    if once:
        rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy("_row"))).where("_at = 1")
    used = users.select(F.col(users.columns[0]).alias("_used")).where("_used is not null").distinct()
    return note(rows.join(used, F.col(key) == F.col("_used"), "left_anti"), code, severity, table, context)


@rule("TripUsageValidator", needs="trips", gated="trips stop_times")
def unused_trip(feed: Feed, options: RunOptions):
    return _unused(feed, "trips", "trip_id", feed.df("stop_times").select("trip_id"), "unused_trip", {"tripId": F.col("trip_id")}, once=True)


@rule("UnusedRouteValidator", needs="routes", thorough=True)
def unused_route(feed: Feed, options: RunOptions):
    context = {"routeId": F.col("route_id"), "routeShortName": F.col("route_short_name"), "routeLongName": F.col("route_long_name")}
    return _unused(feed, "routes", "route_id", feed.df("trips").select("route_id"), "unused_route", context)


@rule("UnusedAgencyValidator", needs="agency", thorough=True)
def unused_agency(feed: Feed, options: RunOptions):
    found = _unused(feed, "agency", "agency_id", feed.df("routes").select("agency_id"), "unused_agency", {"agencyId": F.col("agency_id"), "agencyName": F.col("agency_name")})
    several = feed.df("agency").groupBy().count().where("count > 1").select(F.lit("WARNING").alias("severity"))
    return found.join(several, "severity", "left_semi").select(found.columns)


@rule("ShapeUsageValidator", needs="shapes trips")
def unused_shape(feed: Feed, options: RunOptions):
    first = feed.df("shapes").where(full(F.col("shape_id"))).groupBy("shape_id").agg(F.min("_row").alias("_row"))
    used = feed.df("trips").select(F.col("shape_id").alias("_used")).where("_used is not null").distinct()
    return note(first.join(used, F.col("shape_id") == F.col("_used"), "left_anti"), "unused_shape", "WARNING", "shapes", {"shapeId": F.col("shape_id")})


@rule("UniqueGeographyIdValidator")
def unique_geography_id(feed: Feed, options: RunOptions):
    parts = [feed.df("stops").select(F.col("stop_id").alias("id"), F.lit("stops").alias("src"), F.col("_row").alias("at"))]
    parts.append(feed.df("location_group_stops").select(F.col("location_group_id").alias("id"), F.lit("groups").alias("src"), F.col("_row").alias("at")))
    if feed.has("locations"):
        parts.append(feed.tables["locations"].select(F.col("location_id").alias("id"), F.lit("places").alias("src"), F.col("feature_index").cast("long").alias("at")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = lambda s: F.min(F.when(F.col("src") == s, F.col("at")))
    rows = every.where(full(F.col("id"))).groupBy("id").agg(F.countDistinct("src").alias("n"), first("stops").alias("a"), first("groups").alias("b"), first("places").alias("f")).where("n > 1")
    return note(rows, "duplicate_geography_id", "ERROR", None, {"geographyId": F.col("id"), "csvRowNumberA": F.col("a"), "csvRowNumberB": F.col("b"), "featureIndex": F.col("f")}, row=None)


@rule("NetworkIdConsistencyValidator", needs="routes")
def network_consistency(feed: Feed, options: RunOptions):
    if feed.header("routes", "network_id"):
        return [said(feed, "route_networks_specified_in_more_than_one_file", "ERROR", None, fieldName="network_id", fileNameA="routes.txt", fileNameB=file_of(t)) for t in ("route_networks", "networks") if feed.has(t)]


@rule("MissingFeedInfoValidator")
def missing_feed_info(feed: Feed, options: RunOptions):
    if not feed.has("feed_info") and feed.status("translations") != BROKEN:
        if feed.header("translations", "table_name"):
            return said(feed, "missing_required_file", "ERROR", "feed_info.txt")
        return said(feed, "missing_recommended_file", "WARNING", "feed_info.txt")


@rule("TranslationFieldAndReferenceValidator", needs="translations")
def translations(feed: Feed, options: RunOptions):
    if not feed.header("translations", "table_name", "field_name"):
        return None
    rows = feed.df("translations")
    first = F.array_compact(F.array(*[F.when(blank(F.col(c)), F.lit(c)) for c in ("table_name", "field_name", "language")]))
    out = [note(rows.select("_row", F.explode(first).alias("f")), "missing_required_field", "ERROR", "translations", at=F.col("f"))]
    rows = rows.where(F.size(first) == 0)
    unexpected = lambda where, f: note(rows.where(where), "translation_unexpected_value", "ERROR", "translations", {"fieldName": f, "fieldValue": F.col(f)}, at=f)
    by_value = full(F.col("field_value"))
    out += [unexpected(by_value & full(F.col(f)), f) for f in ("record_id", "record_sub_id")]
    known = {t: keys for t, keys in TRANSLATED.items() if t in ("agency", "stops", "routes", "trips", "stop_times") or feed.has(t)}
    out.append(note(rows.where(~F.col("table_name").isin(list(known))), "translation_unknown_table_name", "WARNING", "translations", {"tableName": F.col("table_name")}))
    rows = rows.where(~by_value & F.col("table_name").isin(list(known)))
    arity = F.lit(0)
    for t, keys in known.items():
        arity = F.when(F.col("table_name") == t, len(keys)).otherwise(arity)
    rows = rows.withColumn("_n", arity)
    for f, least in (("record_id", 1), ("record_sub_id", 2)):
        out.append(unexpected((F.lit(False) | (arity < least)) & full(F.col(f)) & ~by_value & F.col("table_name").isin(list(known)), f))
        out.append(note(rows.where((F.col("_n") >= least) & blank(F.col(f))), "missing_required_field", "ERROR", "translations", at=f))
    fits = rows.where(((F.col("_n") >= 1) & full(F.col("record_id"))) & ((F.col("_n") == 2) & full(F.col("record_sub_id")) | (F.col("_n") == 1) & blank(F.col("record_sub_id"))))
    keys = None
    for t, names in known.items():
        if not names:
            continue
        k = feed.df(t).select(F.lit(t).alias("kt"), *[_as_key(t, c).alias(f"k{i}") for i, c in enumerate(names)])
        k = k if len(names) == 2 else k.withColumn("k1", F.lit(""))
        keys = k if keys is None else keys.unionByName(k)
    sub = F.when(F.col("table_name").isin("stop_times", "shapes"), F.col("record_sub_id").try_cast("long").cast("string")).otherwise(F.coalesce("record_sub_id", F.lit("")))
    lost = fits.withColumn("_sub", sub).join(keys, (F.col("table_name") == F.col("kt")) & (F.col("record_id") == F.col("k0")) & (F.col("_sub") == F.col("k1")), "left_anti")
    return [*out, note(lost, "translation_foreign_key_violation", "ERROR", "translations", {"tableName": F.col("table_name"), "recordId": F.col("record_id"), "recordSubId": F.col("record_sub_id")})]


def _as_key(table: str, column: str) -> Column:
    from ..functions.exprs import clock

    if column == "date":
        return F.date_format("date", "yyyyMMdd")
    if column == "start_time":
        return clock(F.col(column))
    return F.coalesce(F.col(column).cast("string"), F.lit(""))

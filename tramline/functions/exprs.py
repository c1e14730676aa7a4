"""Column expressions for feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MAX_SPEED, MAX_SPEED_OTHER

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def luma(rgb: Column) -> Column:
    """The whole part of 0.30 r + 0.59 g + 0.11 b, in integers: as doubles, sums that are whole may come out just below."""
    r, g, b = (F.shiftright(rgb, n).bitwiseAND(255) for n in (16, 8, 0))
    return F.floor((30 * r + 59 * g + 11 * b) / 100).cast("int")


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def full(c: Column) -> Column:
    return ~blank(c)


def clock(seconds: Column) -> Column:
    """HH:MM:SS of seconds since the start of the service day; hours may exceed 24."""
    h = F.floor(seconds / 3600).cast("string")
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.when(F.length(h) < 2, F.lpad(h, 2, "0")).otherwise(h), F.lit(":"), part(F.floor(seconds / 60) % 60), F.lit(":"), part(seconds % 60))


def max_speed(route_type: Column) -> Column:
    out = F.lit(float(MAX_SPEED_OTHER))
    for kind, kmh in MAX_SPEED.items():
        out = F.when(route_type == kind, float(kmh)).otherwise(out)
    return out


def speed_kph(km: Column, departure: Column, arrival: Column) -> Column:
    """A minute is the least time; whole minutes on both sides may hide almost one more."""
    took = arrival - departure
    took = F.when(took <= 0, 60).when((departure % 60 == 0) & (arrival % 60 == 0), took + 60).otherwise(took)
    return km / took * 3600.0


def parse_time(raw: Column) -> Column:
    """Seconds of H:M:S; null if malformed."""
    ok = raw.rlike(r"^\d+:\d{1,2}:\d{1,2}$")
    part = lambda k: F.try_element_at(F.split(raw, ":"), F.lit(k)).try_cast("int")
    return F.when(ok & (part(2) < 60) & (part(3) < 60), part(1) * 3600 + part(2) * 60 + part(3))


def parse_date(raw: Column) -> Column:
    return F.when(raw.rlike("^[0-9]{8}$"), F.try_to_date(raw, "yyyyMMdd"))


def parse_color(raw: Column) -> Column:
    return F.when(raw.rlike("^[0-9A-Fa-f]{6}$"), F.conv(raw, 16, 10).cast("int"))


def parse_double(raw: Column) -> Column:
    return F.when(raw.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"), raw.try_cast("double"))


def parse_int(raw: Column) -> Column:
    return F.when(raw.rlike(r"^[+-]?\d+$"), raw.try_cast("long"))


def mixed_case(value: Column) -> Column:
    """Whether a name lacks mixed case: a single word in lower case, or several of which none has both cases."""
    words = F.filter(F.split(value, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    usable = F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike("[0-9]"))
    one = (F.size(words) == 1) & (F.size(usable) == 1) & (F.lower(value) == value)
    many = (F.size(usable) >= 2) & ~F.exists(usable, lambda w: (F.lower(w) != w) & (F.upper(w) != w))
    return F.when(F.size(words) == 1, one).otherwise(many)

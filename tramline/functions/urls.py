"""Whether a text is an absolute URL by the URL standard (WHATWG), as columns.

The states of the standard's parser are columns in turn: scheme, authority, credentials, host and port, and the host by its form: a domain, an IPv4
address in its many notations, an IPv6 address, or an opaque host. Domains beyond ASCII are mapped in part (full-width forms, ideographic dots, ignorable
characters) and refused for code points that no domain has; punycode labels are judged by their letters and not decoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes that have a host of the web.
WEB = ("http", "https", "ws", "wss", "ftp")
#: Characters that no host has, and those that no domain has either.
IN_NO_HOST = r"\x00\t\n\r #/:<>?@\[\\\]^|"
IN_NO_DOMAIN = IN_NO_HOST + r"%\x01-\x1F\x7F"
_WIDE, _PLAIN = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(map(chr, range(0x21, 0x7F)))
_ALL = r"(?s)"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _part(value: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(value, _ALL + pattern, group)


def _ipv4_part(part: Column) -> Column:
    """The value of a part of an IPv4 address: decimal, octal after 0, hexadecimal after 0x; null if it is none."""
    number = lambda digits, base: F.conv(digits, base, 10).cast("decimal(20,0)")
    hexadecimal = F.coalesce(number(F.nullif(F.substring(part, 3, 99), F.lit("")), 16), F.lit(0))
    octal, decimal = number(F.substring(part, 2, 99), 8), number(part, 10)
    return F.when(part.rlike("^0[xX][0-9A-Fa-f]*$"), hexadecimal).when(part.rlike("^0[0-7]+$"), octal).when(part.rlike("^(0|[1-9][0-9]*)$"), decimal)


def ipv4(host: Column) -> Column:
    """Whether a host that ends in a number is an IPv4 address: one to four parts, of which the last one fills what the others leave."""

    def fits(values: Column) -> Column:
        n = F.size(values)
        last, others = F.element_at(values, -1), F.slice(values, 1, F.greatest(n - 1, F.lit(0)))
        return (n <= 4) & ~F.exists(values, lambda v: v.isNull()) & F.forall(others, lambda v: v <= 255) & (last < F.pow(F.lit(256.0), 5 - n))

    return F.coalesce(once(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), _ipv4_part), fits), F.lit(False))


def ipv6(body: Column) -> Column:
    """Whether a text is an IPv6 address: eight groups, or fewer and one gap; the last two may be a dotted quad."""
    byte = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    body = F.regexp_replace(body, rf"(^|:){byte}\.{byte}\.{byte}\.{byte}$", "$10:0")

    def fits(sides: Column) -> Column:
        groups = F.flatten(F.transform(sides, lambda side: F.filter(F.split(side, ":"), lambda _: side != "")))
        n = F.when(F.size(sides) == 1, F.size(groups) == 8).when(F.size(sides) == 2, F.size(groups) <= 7).otherwise(False)
        return n & F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))

    return once(F.split(body, "::"), fits)


def domain(host: Column) -> Column:
    """Whether a host of a web scheme, not in brackets, is a domain or an IPv4 address."""
    plain = F.when(F.contains(host, F.lit("%")), F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))).otherwise(host)
    beyond = r"[^\x00-\x7F]"
    mapped = lambda x: F.regexp_replace(F.translate(x, _WIDE + "。｡", _PLAIN + ".."), r"[\x{AD}\x{200B}\x{2060}\x{FEFF}\x{FE00}-\x{FE0F}]", "")

    def good(name: Column) -> Column:
        odd = name.rlike(beyond) & name.rlike(r"[\p{Cn}\p{Co}\p{Cs}\p{Cc}\p{Z}]|(^|\.)\p{M}|�")
        puny = name.rlike(r"(^|\.)xn--([^.]*[^a-z0-9.-][^.]*|[^.]*-)?(\.|$)")
        number = name.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
        return (name != "") & ~name.rlike(f"[{IN_NO_DOMAIN}]") & ~odd & ~puny & F.when(number, ipv4(name)).otherwise(True)

    name = once(plain, lambda x: F.lower(F.when(x.rlike(beyond), mapped(x)).otherwise(x)))
    return F.coalesce(once(name, good), F.lit(False))


def _place(authority: Column, web: bool) -> Column:
    """Whether what stands between scheme and path is a host, with or without credentials and a port; of a web scheme, or of another."""

    def told(x: Column) -> Column:
        boxed, host, after = F.startswith(x["place"], F.lit("[")), x["host"], x["after"]
        digits = F.regexp_replace(F.substring(after, 2, 1 << 30), "^0+", "")
        port = (after == "") | (after.rlike("^:[0-9]*$") & (F.length(digits) <= 5) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 65535))
        plain = domain(host) if web else ~host.rlike(f"[{IN_NO_HOST}]") & ((host != "") | (~x["signed"] & (after == "")))
        return port & F.when(boxed, ipv6(host)).otherwise(plain)

    def split(place: Column) -> Column:
        boxed = F.startswith(place, F.lit("["))
        after = F.when(boxed & ~place.rlike(r"^\[[^\]]*\]"), "?").when(boxed, _part(place, r"^\[[^\]]*\](.*)$")).otherwise(_part(place, "^[^:]*(.*)$"))
        host = F.when(boxed, _part(place, r"^\[([^\]]*)\]")).otherwise(_part(place, "^([^:]*)"))
        return F.struct(place.alias("place"), host.alias("host"), after.alias("after"), F.contains(authority, F.lit("@")).alias("signed"))

    return once(once(F.regexp_replace(authority, _ALL + "^.*@", ""), split), told)


def _file(rest: Column) -> Column:
    host = lambda h: (h == "") | h.rlike("^[A-Za-z][:|]$") | F.when(h.rlike(r"^\[[^\]]*\]$"), ipv6(F.regexp_replace(h, r"[\[\]]", ""))).otherwise(domain(h))
    return once(_part(rest, r"^[/\\]{2}([^/\\?#]*)"), host)


def valid_url(value: Column) -> Column:
    """Whether a text is an absolute URL. Null for null."""
    trimmed = F.regexp_replace(F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")

    def judged(x: Column) -> Column:
        scheme, rest = x["scheme"], x["rest"]
        other = F.when(F.startswith(rest, F.lit("//")), once(_part(rest, "^//([^/?#]*)"), lambda a: _place(a, False))).otherwise(True)
        web = once(_part(rest, r"^[/\\]*([^/\\?#]*)"), lambda a: _place(a, True))
        return F.when(scheme == "", False).when(scheme.isin(*WEB), web).when(scheme == "file", _file(rest)).otherwise(other)

    parts = once(trimmed, lambda s: F.struct(F.lower(_part(s, r"^([A-Za-z][A-Za-z0-9+.\-]*):")).alias("scheme"), _part(s, r"^[^:]*:(.*)$").alias("rest")))
    return F.when(value.isNotNull(), once(parts, judged))

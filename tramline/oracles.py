"""Conditions in DuckDB SQL that several comparisons share, each stated as a rule of its own, without what the tables hold."""

from __future__ import annotations

_BYTE = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _ipv6() -> str:
    """The grammar of IPv6 addresses, form by form: n groups, the gap, and what may follow it."""
    h, quad = "[0-9a-f]{1,4}", rf"{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}"
    tail = f"({h}:{h}|{quad})"
    forms = [f"({h}:){{6}}{tail}"]
    for left in range(8):  # groups before the gap
        before = "" if not left else f"({h}:){{{left - 1}}}{h}"
        forms += [f"{before}::({h}:){{0,{5 - left}}}{tail}"] if left <= 5 else []
        forms += [f"{before}::({h})?"] if left <= 6 else [f"{before}::"]
    return "|".join(forms)


def url(value: str) -> str:
    """Whether a text, white space at its ends left out, is an absolute URL; IPv4 addresses in decimal."""
    s = rf"regexp_replace({value}, '[\t\n\r]', '', 'g')"
    rest = rf"regexp_replace({s}, '^(?is)(https?|wss?|ftp):[/\\]*', '')"
    place = rf"lower(regexp_replace(regexp_extract({rest}, '^[^/\\?#]*'), '^(?s).*@', ''))"
    host = f"regexp_replace({place}, ':[0-9]*$', '')"
    name = f"url_decode({host})"
    web = rf"""CASE WHEN NOT regexp_matches({place}, '(^[^:]*|\])(:0*([0-9]{{0,4}}|[1-5][0-9]{{4}}|6[0-4][0-9]{{3}}|65[0-4][0-9]{{2}}|655[0-2][0-9]|6553[0-5]))?$') THEN FALSE
        WHEN starts_with({host}, '[') THEN regexp_full_match({host}, '\[({_ipv6()})\]')
        WHEN {host} = '' OR regexp_matches({name}, '[\x00-\x20#/:<>?@\[\\\]^|%\x7F]') OR regexp_matches({host}, '%([^0-9a-f]|.[^0-9a-f]|.?$)') THEN FALSE
        WHEN regexp_matches({name}, '(^|\.)[0-9]+\.?$') THEN regexp_full_match({name}, '({_BYTE}\.){{3}}{_BYTE}\.?') ELSE TRUE END"""
    other = rf"NOT regexp_matches({s}, '^[^:]*://[^/?#]*[\x00-\x20<>^|\\]')"
    return rf"(CASE WHEN NOT regexp_matches({s}, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN FALSE WHEN regexp_matches({s}, '^(?i)(https?|wss?|ftp):') THEN {web} ELSE {other} END)"

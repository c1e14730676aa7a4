"""Personal data in texts: base patterns, and a semi-Markov conditional random field that adds what they miss.

The base spans are exact: their patterns are matched whole, leftmost first, by scans whose time is proportional to the
text. The field looks at the surroundings of at signs, plain or written out, of dotted octets and of long runs of digits. Such a run is cut
into units (letters, digits, written-out signs, single marks); each segment of up to MAX_UNITS units is a candidate for each kind,
scored by features of the whole span. Dynamic programming over unit borders sums over all ways to cut a run into segments and
other units, and chooses the best of them jointly; a chosen segment counts if its probability is at least SURE and it overlaps no base span.

The field is trained on runs of a bounded sample of documents, `SAMPLE` of them by lowest hash and of their runs the TRAIN_RUNS of
lowest hash, whose gold segments are base spans (runs without any are left out, as they may hold what the patterns miss); and on MADE_UP texts whose gold the base patterns miss, in surroundings of that
sample: valid cards side by side or with other marks, addresses with written-out signs, octets with guarded or spaced dots, and
phone numbers without a plus. Dates, plain and grouped numbers, sets of digits of which none is a card, octets over 255 and the like stand among them; and, as
often, the very forms of phone numbers and spaced octets without a word before that tells what they are, which are none.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_workers, pick

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end
#: Documents and runs of theirs that training sees, its rounds, and the texts made up for it.
SAMPLE, TRAIN_RUNS, EPOCHS, MADE_UP = 300, 1200, 6, 2200
#: SURE: the highest of 0.5, 0.8, 0.9 and 0.95 that keeps 98 % of the spans of made-up texts of another seed.
MAX_UNITS, SURE = 16, 0.8
#: The longest address, of the mail standard: how far the field looks to the left of an at sign.
ADDRESS = 254
#: Units of a long run that are decoded together; such windows share 2 * MAX_UNITS units, and more digits than MOST are no candidate.
WINDOW, MOST = 512, 22

_LOCAL_CHARS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*\.[0-9.]*[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# What the field looks at: at signs with what stands before and after, four octets, runs of digits.
_DOT = r"(?:\.| ?[\[(](?:dot|\.)[\])] ?)"
_AT = re.compile(r" ?[\[(]at[\])] ?| ?@ ?")
_BEFORE = re.compile(rf"[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*\Z")
_AFTER = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*")
_OCTETS = re.compile(r"[0-9]{1,3}(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}")
_DIGITS = re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,3}[0-9]){6,}")
_UNIT = re.compile(r" ?[\[(](?:at|dot|\.)[\])] ?|[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_WRITTEN_AT, _WRITTEN_DOT = re.compile(r" ?[\[(]at[\])] ?| ?@ ?"), re.compile(r" ?[\[(](?:dot|\.)[\])] ?| ?\. ?")
# Words that tell a phone number or an address of a host.
_PHONE_CUE = re.compile(r"\b(?:tel|telephone|phone|call|mobile|cell|fax|dial|sms|whatsapp|hotline|telefon|handy|anrufen|rufnummer|téléphone|portable|appelez|teléfono|móvil|llame)\b[^\n]{0,8}\Z", re.I)
_HOST_CUE = re.compile(r"\b(?:ip|ips|ipv4|host|server|address|addr|ping|gateway|dns|node|client|adresse|dirección)\b[^\n]{0,8}\Z", re.I)
CUES = ("tel", "Tel.", "phone", "Phone:", "call", "mobile", "fax", "Telefon", "téléphone", "teléfono", "cell:"), ("ip", "IP:", "host", "server", "address", "ping", "gateway")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return not total % 10


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))
        if not m:
            done = max(done, start)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if text.count(".", run.start(), run.end()) < 3:
            continue
        at, pieces = run.start(), []
        for part in run[0].split("."):
            pieces.append((at, at + len(part), part))
            at += len(part) + 1
        k = 0
        while k + 3 < len(pieces):
            four = pieces[k : k + 4]
            empty = next((j for j in (3, 2, 1, 0) if not four[j][2]), None)
            if empty is not None:
                k += empty + 1
                continue
            if all(_octet(p[2]) for p in four):
                yield four[0][0], four[3][1]
            k += 4


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind, then start. Code points; the end is exclusive. Failing matches are not retried."""
    out: list[Span] = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _side(c: str) -> str:
    return "end" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in ".,-+@()" else "mark"


def span_features(text: str, start: int, end: int, units: int) -> list[str]:
    """Of the whole span and its borders; without the kind."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n = len(digits)
    left, right = _side(text[start - 1 : start]), _side(text[end : end + 1])
    out = ["bias", f"digits {min(n, 20)}", f"units {min(units, 8)}", f"left {left}", f"right {right}", f"first {_side(s[0])}"]
    if "@" in s or "at]" in s or "at)" in s:
        plain = _WRITTEN_DOT.sub(".", _WRITTEN_AT.sub("@", s))
        more = re.match(r" ?[\[(]?\.?(?:dot)?[\])]? ?[A-Za-z0-9-]", text[end : end + 8]) and right not in ("space", ",") or re.search(r"[A-Za-z0-9._%+-]\Z", text[max(0, start - 1) : start])
        whole = _ADDRESS.fullmatch(plain) is not None
        out.append("part of an address" if whole and more else "address" if whole else "at sign")
    if s.count(".") == 3 and not re.search("[A-Za-z]", s):
        parts = _WRITTEN_DOT.split(s)
        whole = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
        out.append("octets" if whole else "dotted")
        form = "guarded" if "[" in s or "(" in s else "spaced" if " " in s else "close"
        out.append(f"{'cued' if _HOST_CUE.search(text, max(0, start - 32), start) else 'bare'} {out[-1]} {form}")
    if 16 <= n <= 19:
        out.append(("luhn" if _luhn(digits) else "no luhn") + (" plain" if not re.search(r"[^0-9 -]", s) else " mixed"))
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    if not re.search("[A-Za-z@]", s):
        if s[0] == "+":
            out.append("international" if 8 <= n <= 15 else "plus")
        sizes = "-".join(map(str, groups[:6]))
        marks = "".join(sorted(set(re.sub("[0-9]", "", s))))
        out += [f"groups {sizes}", f"marks {marks}", f"groups {sizes} marks {marks}", f"zeros {min(2, len(digits) - len(digits.lstrip('0')))} of {len(groups)}"]
        form = "+" if s[0] == "+" else "(" if s[0] == "(" else "00" if digits[:2] == "00" else "0" if digits[0] == "0" else "other"
        out.append(f"{'cued' if _PHONE_CUE.search(text, max(0, start - 32), start) else 'bare'} number {form}")
        if len(groups) > 1 and 8 <= n <= 15:
            out.append(f"grouped {'(' * (s[0] == '(')}{'00' if digits[:2] == '00' else digits[0] if digits[0] == '0' else ''}")
    else:
        out.append("letters")
    # the span breaks off where its characters go on
    if re.match(r"[ .-]?[0-9]", text[end : end + 2]):
        out.append("digits follow")
    if re.search(r"[0-9][ .-]?\Z", text[max(0, start - 2) : start]):
        out.append("digits before")
    if text[start - 1 : start] in ("(", "+"):
        out.append("opened before")
    before = re.search(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}\Z", text[max(0, start - 24) : start])
    if before:
        out.append(f"after {before[1].lower()}")
    return out


class Run:
    """A piece of text, cut into units at the given borders, and its candidate segments. Those that start before `until` count."""

    def __init__(self, text: str, borders: list[int], until: int | None = None):
        cuts, self.borders = borders[:-1], borders
        self.n, self.until = len(cuts), borders[-1] if until is None else until
        self.segments: list[tuple[int, int]] = []
        self.features: list[list[str]] = []
        for i in range(self.n):
            if not (text[cuts[i]].isalnum() or text[cuts[i]] in "+("):
                continue
            if "[" in text[cuts[i] : self.borders[i + 1]] or self.borders[i + 1] - cuts[i] > 1 and text[cuts[i]] == "(":
                continue  # a written-out sign
            digits, at, dots = 0, False, 0
            for j in range(i, min(self.n, i + MAX_UNITS)):
                a, b = self.borders[j], self.borders[j + 1]
                at = at or text[a] == "@" or "at" in text[a:b] and not text[a].isalpha()
                dots += "." in text[a:b]
                if "0" <= text[a] <= "9":
                    digits += b - a
                if digits > MOST and not at:
                    break
                if text[b - 1].isalnum() and (at or digits >= 7 or dots == 3 and digits >= 4):
                    self.segments.append((i, j + 1))
                    self.features.append(span_features(text, cuts[i], b, j + 1 - i))


def regions(text: str) -> list[tuple[int, int]]:
    """Where the field looks, in order; regions that overlap are one."""
    found = [m.span() for m in _DIGITS.finditer(text)]
    found += [m.span() for m in _OCTETS.finditer(text)]
    for m in _AT.finditer(text):
        left, right = _BEFORE.search(text, max(0, m.start() - ADDRESS), m.start()), _AFTER.match(text, m.end())
        if left and right:
            found.append((left.start(), right.end()))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs(text: str) -> Iterator[Run]:
    """Regions with candidates; long ones window by window."""
    for a, b in regions(text):
        borders = [*(m.start() for m in _UNIT.finditer(text, a, b)), b]
        for k in range(0, max(1, len(borders) - 1 - 2 * MAX_UNITS), WINDOW - 2 * MAX_UNITS):
            part = borders[k : k + WINDOW + 1]
            last = k + WINDOW >= len(borders) - 1
            if (r := Run(text, part, None if last else part[-1 - MAX_UNITS])).segments:
                yield r
            if last:
                break


class SemiMarkov:
    """Weights of (feature, kind); the score of other units is 0."""

    def __init__(self, index: dict[str, int] | None = None):
        self.index = index or {}
        self.weights = np.zeros((len(self.index), len(KINDS)))

    def scores(self, run: Run) -> np.ndarray:
        get = self.index.get
        return np.array([self.weights[[i for f in fs if (i := get(f)) is not None]].sum(axis=0) for fs in run.features])

    def sums(self, run: Run, scores: np.ndarray) -> tuple[np.ndarray, float]:
        """Probability of each (segment, kind), and the log of the sum over all cuttings."""
        n = run.n
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        begins: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(run.segments):
            ends[j].append(k)
            begins[i].append(k)
        whole = np.logaddexp.reduce(scores, axis=1)
        forward, back = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[run.segments[k][0]] + whole[k] for k in ends[j])])
        for i in range(n - 1, -1, -1):
            back[i] = np.logaddexp.reduce([back[i + 1], *(back[run.segments[k][1]] + whole[k] for k in begins[i])])
        at = np.array(run.segments)
        return np.exp(forward[at[:, 0]][:, None] + scores + back[at[:, 1]][:, None] - forward[n]), float(forward[n])

    def best(self, run: Run) -> list[tuple[int, int, int, float]]:
        """Kind, start, end and probability of the segments of the best cutting."""
        scores = self.scores(run)
        kind, top = scores.argmax(axis=1), scores.max(axis=1)
        if not (top > 0).any():
            return []
        value, last = np.zeros(run.n + 1), [-1] * (run.n + 1)
        ends: list[list[int]] = [[] for _ in range(run.n + 1)]
        for k, (_, j) in enumerate(run.segments):
            ends[j].append(k)
        for j in range(1, run.n + 1):
            value[j] = value[j - 1]
            for k in ends[j]:
                if (v := value[run.segments[k][0]] + top[k]) > value[j]:
                    value[j], last[j] = v, k
        chance, _ = self.sums(run, scores)
        out, j = [], run.n
        while j > 0:
            if (k := last[j]) < 0:
                j -= 1
                continue
            i = run.segments[k][0]
            out.append((int(kind[k]), run.borders[i], run.borders[j], float(chance[k, kind[k]])))
            j = i
        return out[::-1]


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _card(r: random.Random, valid: bool, marks: tuple[str, ...]) -> str:
    while _luhn(digits := _digits(r, 16)) != valid:
        pass
    mark = r.choice(marks)
    return mark.join(digits[k : k + 4] for k in range(0, 16, 4))


def _phone(r: random.Random) -> tuple[str, bool]:
    """Forms without a plus, and whether they need a word that tells what they are: an area in brackets or a leading 00 don't, a trunk zero or three groups do."""
    mark = r.choice([" ", "-", "."])
    return r.choice([
        (f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", False), (f"({r.choice(['0', ''])}{_digits(r, 3)}) {_digits(r, 3)}{r.choice([' ', '-'])}{_digits(r, 4)}", False),
        (f"00{r.choice('123456789')}{_digits(r, r.choice([0, 1, 1, 2]))} {_digits(r, 3)} {_digits(r, r.choice([6, 7]))}", False), (f"00{r.choice('123456789')}{_digits(r, 1)} {_digits(r, 2)} {_digits(r, 3)} {_digits(r, 4)}", False),
        (f"0{_digits(r, r.choice([2, 3, 4]))}{r.choice([' ', '/', '-'])}{_digits(r, r.choice([6, 7]))}", True), (mark.join([_digits(r, 3), _digits(r, 3), _digits(r, 4)]), True),
    ])


def _number(r: random.Random) -> str:
    """What is none of the four kinds: dates, times, counts, identifiers and lists of numbers."""
    day, month, year = f"{r.randint(1, 28):02d}", f"{r.randint(1, 12):02d}", str(r.randint(1950, 2030))
    return r.choice([
        f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{year}-{month}-{day} {_digits(r, 2)}:{_digits(r, 2)}", f"{day}.{month}.{year} - {month}.{day}.{year}", f"{year}{month}{day}",
        _digits(r, r.randint(7, 15)), _digits(r, r.randint(17, 22)), f"{r.randint(1, 999)} {_digits(r, 3)} {_digits(r, 3)}", f"{r.randint(1, 999)} {_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}",
        f"978-{_digits(r, 1)}-{_digits(r, 2)}-{_digits(r, 6)}-{_digits(r, 1)}", f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}", " ".join(_digits(r, 2) for _ in range(r.randint(4, 8))), f"{_digits(r, 8)}-{_digits(r, 4)}-{_digits(r, 4)}",
        f"{_digits(r, 5)}.{_digits(r, 4)}", f"{r.choice('abcdef')}{_digits(r, 9)}{r.choice('abcdef')}{_digits(r, 7)}", f"{year}-{str(int(year) + 1)}",
    ])


def made_up(texts: list[str], n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """n texts with the spans that the base patterns miss in them, between pieces of the given texts."""
    r = random.Random(seed)
    word = lambda least: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(least, 8)))
    around = lambda: re.sub(r"[0-9@+()\[\]]+", "", t[(at := r.randrange(len(t))) : at + 24]) if (t := r.choice(texts)) else ""
    out = []
    for _ in range(n if texts else 0):
        before, after = around() + " ", r.choice([" ", ". ", ", "]) + around()
        spans: list[Span] = []
        body = ""

        def put(kind: int | None, said: str, before: str = before, spans: list[Span] = spans) -> str:
            if kind is not None:
                spans.append((kind, len(before + body), len(before + body + said)))
            return said

        form = r.random()
        if form < 0.25:  # cards side by side
            for k in range(r.choice([2, 2, 3])):
                body += " " * (k > 0)
                body += put(2 if (valid := r.random() < 0.7) else None, _card(r, valid, ("", "", " ", "-")))
        elif form < 0.33:  # cards with other marks
            body += put(2 if (valid := r.random() < 0.6) else None, _card(r, valid, (".", "  ", "/")))
        elif form < 0.53:
            dot = r.choice([".", ".", "[dot]", " [dot] ", "(dot)", " (dot) ", "[.]"])
            parts = [word(1) for _ in range(r.randint(1, 2))]
            local = (dot if r.random() < 0.3 else r.choice([".", "_", "-"])).join(parts) + r.choice(["", "", str(r.randrange(100))])
            host = [word(2) for _ in range(r.choice([1, 2, 2, 2, 3]))]
            body += put(0 if len(host) > 1 else None, local + r.choice(["(at)", "[at]", " [at] ", " (at) ", " @ "]) + dot.join(host))
        elif form < 0.66:
            octets = [str(r.randint(0, 255 if r.random() < 0.9 else 999)) for _ in range(4)]
            mark = r.choice(["[.]", "(.)", " . ", " . "])
            if told := r.random() < 0.5:
                body += f"{r.choice(CUES[1])} "
            elif r.random() < 0.7:
                body += f"{word(3)} "
            body += put(1 if all(int(x) < 256 for x in octets) and (told or mark != " . ") else None, mark.join(octets))
        elif form < 0.86:
            said, needs = _phone(r)
            if told := r.random() < 0.5:
                body += f"{r.choice(CUES[0])} "
            elif r.random() < 0.8:
                body += f"{word(3)} "
            body += put(3 if told or not needs else None, said)
            if not told and r.random() < 0.6:
                body += f" {word(3)}"
        else:
            body += put(None, _number(r))
        out.append((before + body + after, spans))
    # a text in which the base patterns find something has no gold of its own to learn from
    return [(t, found) for t, found in out if not base_spans(t)]


def train(texts: list[str], seed: int = 11) -> SemiMarkov:
    """Climb the likelihood of base spans, and of made-up ones, as segments, run by run (AdaGrad)."""
    examples: list[tuple[Run, set[tuple[int, int, int]]]] = []
    # runs in which the base patterns find nothing may still hold personal data: they teach nothing
    seen = [(r, spans) for t in texts for spans in [base_spans(t)] for r in (runs(t) if spans else ()) if any(a < r.borders[-1] and r.borders[0] < b for _, a, b in spans)]
    lot = lambda x: hashlib.sha256(repr((x[0].borders, x[0].features)).encode()).digest()
    chosen = sorted(seen, key=lot)[:TRAIN_RUNS]
    for r, spans in [*((r, spans) for t, spans in made_up(texts, MADE_UP, seed) for r in runs(t)), *chosen]:
        place = {b: i for i, b in enumerate(r.borders)}
        gold = {(place[a], place[b], kind) for kind, a, b in spans if a in place and b in place}
        taken: set[tuple[int, int, int]] = set()
        for i, j, kind in sorted(gold, key=lambda g: g[0] - g[1]):  # of overlapping base spans the longest
            if all(j <= x or y <= i for x, y, _ in taken):
                taken.add((i, j, kind))
        examples.append((r, taken))
    model = SemiMarkov({f: i for i, f in enumerate(dict.fromkeys(f for r, _ in examples for fs in r.features for f in fs))})
    if not examples:
        return model
    ids = [[[model.index[f] for f in fs] for fs in r.features] for r, _ in examples]
    golds = []
    for r, taken in examples:
        hot = np.zeros((len(r.segments), len(KINDS)))
        for k, (i, j) in enumerate(r.segments):
            for kind in range(len(KINDS)):
                hot[k, kind] = (i, j, kind) in taken
        golds.append(hot)
    rng, square = np.random.default_rng(seed), np.full_like(model.weights, 1e-6)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            r = examples[k][0]
            chance, _ = model.sums(r, model.scores(r))
            change = golds[k] - chance
            step = np.zeros_like(model.weights)
            for fs, d in zip(ids[k], change, strict=True):
                step[fs] += d
            used = np.unique(np.concatenate([np.array(x) for x in ids[k]]))
            g = step[used] - 1e-4 * model.weights[used]
            square[used] += g * g
            model.weights[used] += 0.3 * g / np.sqrt(square[used])
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> SemiMarkov:
    """The field trained on `sample` rows of lowest hash of id and then of text, however many rows share an id."""
    rows = pick(docs, "doc_id", "text").where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull())
    rows = rows.select("text", F.xxhash64("doc_id").alias("lot"), F.xxhash64("text").alias("name"))
    lots = [tuple(r) for r in rows.select("lot", "name").orderBy("lot", "name").limit(sample).distinct().collect()]
    if not lots:
        return train([])
    chosen = docs.sparkSession.createDataFrame(lots, "lot long, name long")
    return train(sorted(r["text"] for r in rows.join(F.broadcast(chosen), ["lot", "name"]).select("text").distinct().limit(sample).collect()))


def all_spans(text: str, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with what the field adds, by kind, then start."""
    base = base_spans(text)
    added: list[Span] = []
    taken = sorted((a, b) for _, a, b in base)
    begins = [a for a, _ in taken]
    done = 0  # where the last added span ends
    for r in runs(text) if model.index else ():
        near = taken[max(0, bisect_left(begins, r.borders[0]) - len(KINDS)) : bisect_left(begins, r.borders[-1])]
        for kind, start, end, chance in model.best(r):
            if chance >= SURE and done <= start < r.until and all(end <= x or y <= start for x, y in near):
                added.append((kind, start, end))
                done = end
    return base, sorted([*base, *added], key=lambda s: (s[0], s[1]))


def written(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in spans])


def find_pii(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added.

    Null texts count as empty: no spans. Repeated rows give repeated rows; other columns are ignored. Where no text has a digit
    or `@`, the field knows nothing and adds nothing.
    """
    model = fit(docs, sample)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = []
            sums, spans = [], []
            for text in batch.column(1):
                base, every = all_spans(text.as_py() or "", model)
                counts.append([sum(s[0] == k for s in base) for k in range(len(KINDS))] + [len(every) - len(base)])
                sums.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS) + 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n[:4], pa.array(sums, pa.string()), pa.array(spans, pa.string()), n[4]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = pick(docs, "doc_id", "text")
    return on_workers(rows.select(rows["doc_id"].cast("long"), rows["text"]), run, schema)

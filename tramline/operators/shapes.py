"""Matching of a trip's stops to its shape.

Trips of a shape that make the same calls are examined once. A spatial index (index.py) finds the segments that may be within reach of a
stop, or the nearest one if none is. Points, stops with these segments, and calls meet by shape, the calls of a shape with many patterns in several tasks,
and NumPy does the geometry of the found stop-segment pairs alone, in blocks of BLOCK. A stop's candidates are the nearest points of runs of segments
within reach; dynamic programming picks one for each stop, in order along the shape, at the least total distance. Where trip and shape have users' distances, a second pass takes the points at these instead.
Patterns for which there is nothing to pick, as a stop has no candidate or each has the one point at its distance, are examined together, call by call of all of them (Together).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..feed import Feed, RunOptions, note
from ..functions.checkpoint import cut
from ..functions.exprs import full
from ..functions.workers import importable
from . import rule
from .index import RADIUS, looked_up, segments
from .stations import last_by
from .transfers import located

C = F.col
REACH, LARGE, MANY = 100.0, 4.0, 20
FAR, FAR_USER, TOO_MANY, NO_ORDER = "stop_too_far_from_shape", "stop_too_far_from_shape_using_user_distance", "stop_has_too_many_matches_for_shape", "stops_match_shape_out_of_order"
#: What a notice shows of a shape: points on each side, and how far from the match.
SHOWN, SHOWN_M = 10, 500.0
#: Patterns of a shape that one task examines, and stop-segment pairs that are held at once.
TOGETHER, BLOCK = 4_096, 1 << 20


def vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=-1)


def degrees(v: np.ndarray) -> list[float]:
    return [float(np.degrees(np.arctan2(v[2], np.hypot(v[0], v[1])))), float(np.degrees(np.arctan2(v[1], v[0])))]


def metres(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return RADIUS * np.arctan2(np.linalg.norm(np.cross(a, b), axis=-1), np.sum(a * b, axis=-1))


def alike(x: float, y: float) -> bool:
    """Whether two users' distances are too close to tell apart."""
    margin = 32e-9
    return bool(np.isfinite(x) and np.isfinite(y) and abs(x - y) <= max(margin, margin * max(abs(x), abs(y))))


@dataclass
class Match:
    """A point of a shape: segment, metres along the shape and away from the stop, and where."""

    index: int
    along: float
    away: float
    at: np.ndarray


class Line:
    """A shape's points as unit vectors, with distances along it and, if given, users' distances (never falling)."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, user: np.ndarray):
        self.lat, self.lon, self.v = lat, lon, vectors(lat, lon)
        self.a, self.b = self.v[:-1], self.v[1:]
        self.geo = np.r_[0.0, np.cumsum(metres(self.a, self.b))]
        self.user = np.maximum.accumulate(np.maximum(0.0, np.nan_to_num(user)))
        normal = np.cross(self.a, self.b)
        size = np.linalg.norm(normal, axis=1, keepdims=True)
        self.normal = np.divide(normal, size, out=np.zeros_like(normal), where=size > 0)
        self.degenerate = size[:, 0] == 0

    def examined(self, stops: np.ndarray, reaches: np.ndarray, near: list | None = None, nearest: list | None = None) -> list[tuple[list[Match], Match | None]]:
        """For each stop (lat, lon) the candidates within its reach, and the point of the nearest segment in degrees.

        near: the segments to look at for each stop, all by default. nearest: the nearest segment in degrees, or None where a candidate is known to be there."""
        p = vectors(stops[:, 0], stops[:, 1])
        if not len(self.a):
            return [([], Match(0, 0.0, float(metres(x, self.v[0])), self.v[0])) for x in p]
        every = np.arange(len(self.a))
        near = [every] * len(p) if near is None else near
        nearest = [self._nearest_in_degrees(s) for s in stops] if nearest is None else nearest
        out: list[tuple[list[Match], Match | None]] = []
        at, held = 0, 0
        for k in range(len(p)):
            held += len(near[k]) + 1
            if held >= BLOCK or k == len(p) - 1:
                some = slice(at, k + 1)
                out += self._block(p[some], reaches[some], near[some], nearest[some])
                at, held = k + 1, 0
        return out

    def measured(self, q: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of a place and a segment: metres along the shape to the point nearest to the place, metres between, that point, and metres from the segment's end."""
        a, b, normal = self.a[j], self.b[j], self.normal[j]
        foot = q - np.sum(q * normal, axis=1, keepdims=True) * normal
        size = np.linalg.norm(foot, axis=1, keepdims=True)
        foot = np.divide(foot, size, out=a.copy(), where=size > 1e-15)
        onto = (np.sum(np.cross(a, foot) * normal, axis=1) >= 0) & (np.sum(np.cross(foot, b) * normal, axis=1) >= 0) & ~self.degenerate[j]
        from_a, from_b = metres(a, q), metres(b, q)
        away = np.where(onto, metres(foot, q), np.minimum(from_a, from_b))
        at = np.where(onto[:, None], foot, np.where((from_a <= from_b)[:, None], a, b))
        along = self.geo[j] + metres(at, a)
        return along, away, at, from_b

    def _block(self, p: np.ndarray, reaches: np.ndarray, near: list, nearest: list) -> list[tuple[list[Match], Match | None]]:
        # the stop's own segments, then its nearest one
        looked = [np.r_[np.asarray(own, np.int64), [] if one is None else [one]].astype(np.int64) for own, one in zip(near, nearest, strict=True)]
        sizes = [len(x) for x in looked]
        j, q = np.concatenate(looked), np.repeat(p, sizes, axis=0)
        along, away, at, from_b = self.measured(q, j)

        def match(k: int) -> Match:
            return Match(int(j[k]), float(along[k]), float(away[k]), at[k])

        out, start = [], 0
        for i, (own, one) in enumerate(zip(near, nearest, strict=True)):
            end = start + len(own)
            found = []
            if len(own):
                of = np.arange(start, end)[away[start:end] <= reaches[i]]
                # a run ends where segments are left out, or where the last one led away and this one comes closer than its end
                last = of[:-1]
                ends = (np.diff(j[of]) > 1) | (from_b[last] > away[last]) & (away[of[1:]] < from_b[last])
                runs = np.split(of, np.flatnonzero(ends) + 1) if len(of) else []
                found = [match(int(run[away[run].argmin()])) for run in runs]
            out.append((found, None if one is None else match(end)))
            start = end + (one is not None)
        return out

    def _nearest_in_degrees(self, stop: np.ndarray) -> int:
        a = np.stack([self.lat[:-1], self.lon[:-1]], axis=1)
        way = np.stack([np.diff(self.lat), np.diff(self.lon)], axis=1)
        size = np.sum(way * way, axis=1)
        part = np.clip(np.divide(np.sum((stop - a) * way, axis=1), size, out=np.zeros_like(size), where=size > 0), 0.0, 1.0)
        return int(np.sum((a + part[:, None] * way - stop) ** 2, axis=1).argmin())

    def at_user(self, d: float, first: int, stop: np.ndarray) -> Match:
        """The point at a user's distance, looked for from a point on."""
        following = max(first, int(np.searchsorted(self.user, d, side="right")))
        i = following - 1 if following > first else first
        if following == 0 or i + 1 >= len(self.v):
            return Match(i, float(self.geo[i]), float(metres(self.v[i], stop)), self.v[i])
        low, high = float(self.user[i]), float(self.user[i + 1])
        part = 0.0 if alike(low, high) else (d - low) / (high - low)
        at, a, b = self.v[i], self.v[i], self.v[i + 1]
        angle = float(np.arccos(np.clip(a @ b, -1.0, 1.0)))
        if angle >= 1e-12:
            at = (np.sin((1 - part) * angle) * a + np.sin(part * angle) * b) / np.sin(angle)
        return Match(i, float(self.geo[i] + part * (self.geo[i + 1] - self.geo[i])), float(metres(at, stop)), at)

    def at_users(self, d: np.ndarray, first: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """at_user() of many stops: segments, metres along, metres away, points."""
        following = np.maximum(first, np.searchsorted(self.user, d, side="right"))
        i = np.where(following > first, following - 1, first)
        end = (following == 0) | (i + 1 >= len(self.v))
        k = np.minimum(i + 1, len(self.v) - 1)
        low, high, a, b = self.user[i], self.user[k], self.v[i], self.v[k]
        margin = np.maximum(32e-9, 32e-9 * np.maximum(np.abs(low), np.abs(high)))
        same = end | np.isfinite(low) & np.isfinite(high) & (np.abs(low - high) <= margin)
        part = np.divide(d - low, high - low, out=np.zeros(len(d)), where=~same)
        angle = np.arccos(np.clip(np.sum(a * b, axis=1), -1.0, 1.0))
        at, wide = a.copy(), ~end & (angle >= 1e-12)
        t, w = part[wide, None], angle[wide, None]
        at[wide] = (np.sin((1 - t) * w) * a[wide] + np.sin(t * w) * b[wide]) / np.sin(w)
        return i, self.geo[i] + part * (self.geo[k] - self.geo[i]), metres(at, stops), at

    def path(self, index: int) -> list[list[float]]:
        """The points around a match that a notice shows."""
        low = max(0, index - SHOWN)
        near = low + np.flatnonzero(np.abs(self.geo[low : index + SHOWN + 1] - self.geo[index]) <= SHOWN_M)
        return [[float(self.lat[i]), float(self.lon[i])] for i in near]


def in_order(options: list[list[Match]]) -> tuple[list[Match], int, Match | None]:
    """The cheapest choice of one match for each stop, never going back along the shape; else the stop where that fails and the best match of the one before."""
    steps: list[list[tuple[float, Match, int]]] = []  # cost so far, match, place in the step before
    for i, found in enumerate(options):
        if not i:
            steps.append([(m.away, m, -1) for m in found])
            continue
        before = sorted(range(len(steps[-1])), key=lambda k: (steps[-1][k][1].along, k))
        step, k, best = [], 0, -1
        for m in sorted(found, key=lambda m: m.along):
            while k < len(before) and steps[-1][before[k]][1].along <= m.along:
                if best < 0 or steps[-1][before[k]][0] < steps[-1][best][0]:
                    best = before[k]
                k += 1
            if best >= 0:
                step.append((steps[-1][best][0] + m.away, m, best))
        if not step:
            return [], i, min(steps[-1], key=lambda x: x[0])[1]
        steps.append(step)
    out: list[Match] = []
    at = min(range(len(steps[-1])), key=lambda k: steps[-1][k][0]) if steps else -1
    for step in reversed(steps):
        out.append(step[at][1])
        at = step[at][2]
    return out[::-1], -1, None


Problem = tuple[str, int, int, float, Match, "Match | None"]


def match(line: Line, points: np.ndarray, users: np.ndarray, rail: bool, known: dict | None = None) -> list[Problem]:
    """Problems: code, index of the stop, index of the one before or -1, a distance or count, and the matches of both.

    points: lat and lon of each stop; known: what examined() said of (lat, lon, reach)."""
    n, out = len(points), []
    if not n:
        return out
    known = {} if known is None else known
    reaches = [REACH * (LARGE if rail and i in (0, n - 1) else 1.0) for i in range(n)]
    keys = [(float(p[0]), float(p[1]), r) for p, r in zip(points, reaches, strict=True)]
    if new := [k for k in dict.fromkeys(keys) if k not in known]:
        known |= zip(new, line.examined(np.array([k[:2] for k in new]), np.array([k[2] for k in new])), strict=True)

    def candidates(i: int, far: str) -> list[Match]:
        found, nearest = known[keys[i]]
        if not found and nearest and nearest.away > reaches[i]:
            out.append((far, i, -1, nearest.away, nearest, None))
        elif len(found) > MANY:
            out.append((TOO_MANY, i, -1, float(len(found)), min(found, key=lambda m: m.away), None))
        return found

    def chosen(options: list[list[Match]]) -> list[Match]:
        best, i, before = in_order(options)
        if i >= 0:
            out.append((NO_ORDER, i, i - 1, 0.0, min(options[i], key=lambda m: m.away), before))
        return best

    options = [candidates(i, FAR) for i in range(n)]
    if all(options):
        chosen(options)
    if users[-1] > 0 and line.user[-1] > 0:
        far, options, first = FAR_USER, [], 0
        for i, (p, d) in enumerate(zip(vectors(points[:, 0], points[:, 1]), users, strict=True)):
            if d > 0:
                options.append([line.at_user(d, first, p)])
                first = options[-1][0].index
            else:
                options.append(candidates(i, far))
            if not options[-1]:
                return out
        out += [(far, i, -1, m.away, m, None) for i, m in enumerate(chosen(options)) if m.away > REACH]
    return out


FOUND = "code string, shape_id string, trip_id string, trip_row long, at int, r long, s string, name string, r1 long, s1 string, name1 string, value double, place string, match string, match1 string, path string, index int"


def _texts(a: np.ndarray, b: np.ndarray) -> list[str]:
    """JSON of pairs of numbers."""
    write = "[%r, %r]".__mod__ if np.isfinite(a).all() and np.isfinite(b).all() else json.dumps
    return [write(x) for x in zip(a.tolist(), b.tolist(), strict=True)]


class Together:
    """Some patterns of a shape: their calls at known places, one after the other, and what was found at these places."""

    def __init__(self, line: Line, spots: pa.Table, calls: pa.Table):
        self.line, self.trips = line, calls.sort_by("trip_row")
        lists = self.trips.column("calls").combine_chunks()
        of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        flat = lists.flatten()
        placed = pc.is_valid(pc.struct_field(flat, "lat"))
        self.calls, self.of = flat.filter(placed), of[placed.to_numpy(zero_copy_only=False)]
        number = lambda c: pc.struct_field(self.calls, c).to_numpy(zero_copy_only=False).astype(float)
        self.lat, self.lon, self.d = number("lat"), number("lon"), np.nan_to_num(number("d"))
        self.n = np.bincount(self.of, minlength=len(lists))
        self.start = np.cumsum(self.n) - self.n
        self.i = np.arange(len(self.of)) - self.start[self.of]
        self.rail = np.array([x == 2 for x in self.trips.column("route_type").to_pylist()], bool)
        self.reach = np.where(self.rail[self.of] & ((self.i == 0) | (self.i == self.n[self.of] - 1)), REACH * LARGE, REACH)
        self.problems: list[tuple] = []  # arrays: call, the one before or -1, code, place in the pattern's list, value, segment, point, point of the one before
        self._examine(spots)

    def _examine(self, spots: pa.Table) -> None:
        number = lambda c: spots.column(c).to_numpy().astype(float)
        lat, lon, self.reaches = number("lat"), number("lon"), number("reach")
        self.where = np.stack([lat, lon], axis=1)
        place = np.unique(np.r_[lat, self.lat] + 1j * np.r_[lon, self.lon], return_inverse=True)[1] * 2 + (np.r_[self.reaches, self.reach] > REACH)
        at = np.full(place.max(initial=-1) + 1, -1)
        at[place[: len(lat)]] = np.arange(len(lat))
        self.spot = at[place[len(lat) :]]
        n, p = len(lat), vectors(lat, lon)
        self.index, self.away, self.point, self.count = np.zeros(n, np.int64), np.full(n, np.nan), np.full((n, 3), np.nan), np.zeros(n, np.int64)
        self.found: dict[int, tuple[list[Match], Match | None]] = {}
        near = spots.column("near").combine_chunks()
        some = pc.list_value_length(near).to_numpy(zero_copy_only=False) > 0
        if not len(self.line.a):
            self.away, self.point = metres(p, self.line.v[:1]), np.repeat(self.line.v[:1], n, axis=0)
            return
        j = number("nearest")
        alone = np.flatnonzero(~some & np.isfinite(j))
        self.index[alone] = j[alone].astype(np.int64)
        for b in range(0, len(alone), BLOCK):
            k = alone[b : b + BLOCK]
            _, self.away[k], self.point[k], _ = self.line.measured(p[k], self.index[k])
        several = np.flatnonzero(some)
        if len(several):
            nearest = [None if np.isnan(x) else int(x) for x in j[several]]
            for k, (found, one) in zip(several.tolist(), self.line.examined(self.where[several], self.reaches[several], near.take(pa.array(several)).to_pylist(), nearest), strict=True):
                self.found[k], self.count[k] = (found, one), len(found)
                shown = min(found, key=lambda m: m.away) if found else one
                if shown:
                    self.index[k], self.away[k], self.point[k] = shown.index, shown.away, shown.at

    def _add(self, calls: np.ndarray, code: str, rank: np.ndarray, value: np.ndarray, index: np.ndarray, point: np.ndarray, before: np.ndarray | None = None, point1: np.ndarray | None = None) -> None:
        before = np.full(len(calls), -1) if before is None else before
        self.problems.append((calls, before, np.full(len(calls), code), rank, value, index, point, np.full((len(calls), 3), np.nan) if point1 is None else point1))

    def _candidates(self, calls: np.ndarray, far: str, rank: np.ndarray) -> None:
        """What is to be said of the candidates of some calls."""
        k = self.spot[calls]
        with np.errstate(invalid="ignore"):
            lost, many = (self.count[k] == 0) & (self.away[k] > self.reaches[k]), self.count[k] > MANY
        for these, code, value in ((lost, far, self.away[k]), (many, TOO_MANY, self.count[k].astype(float))):
            self._add(calls[these], code, rank[these], value[these], self.index[k[these]], self.point[k[these]])

    def examined(self) -> None:
        known, lost = self.spot >= 0, self.count[self.spot] == 0
        patterns = lambda calls: np.bincount(self.of[calls], minlength=len(self.n)) > 0
        users = (self.n > 0) & (self.line.user[-1] > 0)
        users[users] = self.d[(self.start + self.n - 1)[users]] > 0
        blank = ~(self.d > 0)
        broken = users & patterns(blank & lost)  # a call that has neither a distance nor a candidate ends the second pass
        by_one = (self.n > 0) & (~patterns(lost) | users & patterns(blank) & ~broken | patterns(~known))
        calls = np.flatnonzero(~by_one[self.of])
        self._candidates(calls, FAR, self.i[calls])
        rank = self.n[self.of] + 1 + self.i
        last = np.full(len(self.n), np.iinfo(np.int64).max)
        np.minimum.at(last, self.of[blank & lost], self.i[blank & lost])
        calls = np.flatnonzero((broken & ~by_one)[self.of] & blank & (self.i <= last[self.of]))
        self._candidates(calls, FAR_USER, rank[calls])
        self._at_users(np.flatnonzero(users & ~broken & ~by_one), rank)
        for k in np.flatnonzero(by_one).tolist():
            self._match(k)

    def _at_users(self, patterns: np.ndarray, rank: np.ndarray) -> None:
        n = len(self.of)
        index, along, away, point = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros((n, 3))
        stops, first, back = vectors(self.lat, self.lon), np.zeros(len(patterns), np.int64), np.zeros(n, bool)
        for i in range(self.n[patterns].max(initial=0)):
            going = self.n[patterns] > i
            patterns, first = patterns[going], first[going]
            c = self.start[patterns] + i
            index[c], along[c], away[c], point[c] = self.line.at_users(self.d[c], first, stops[c])
            first = index[c]
            if i:
                back[c] = along[c] < along[c - 1]
        wrong = np.flatnonzero(back)
        wrong = wrong[np.unique(self.of[wrong], return_index=True)[1]]
        self._add(wrong, NO_ORDER, rank[wrong], np.zeros(len(wrong)), index[wrong], point[wrong], wrong - 1, point[wrong - 1])
        far = away > REACH  # calls of other patterns have 0 here
        far &= ~np.isin(self.of, self.of[wrong])
        far = np.flatnonzero(far)
        self._add(far, FAR_USER, rank[far], away[far], index[far], point[far])

    def _match(self, k: int) -> None:
        """A pattern by itself."""
        some = slice(self.start[k], self.start[k] + self.n[k])
        known = {}
        for c in self.spot[some].tolist():
            if c >= 0:
                one = None if np.isnan(self.away[c]) else Match(int(self.index[c]), 0.0, float(self.away[c]), self.point[c])
                known[*self.where[c].tolist(), float(self.reaches[c])] = self.found.get(c, ([], one))
        problems = match(self.line, np.stack([self.lat[some], self.lon[some]], axis=1), self.d[some], bool(self.rail[k]), known)
        for rank, (code, i, j, value, m, before) in enumerate(problems):
            one = [np.array([x]) for x in (self.start[k] + i, rank, value, m.index, self.start[k] + j if j >= 0 else -1)]
            self._add(one[0], code, one[1], one[2], one[3], m.at[None], one[4], before.at[None] if before else None)

    def table(self, shape_id: str) -> pa.Table:
        calls, before, code, rank, value, index, point, point1 = (np.concatenate(x) for x in zip(*self.problems, strict=True))
        # a stop is told to be too far once for a shape: the first trip's here, of all tasks later on
        order = np.lexsort((rank, self.of[calls]))
        far = order[np.isin(code[order], (FAR, FAR_USER))]
        stop = pc.struct_field(self.calls, "s").dictionary_encode().indices.to_numpy()
        keep = np.sort(np.r_[np.flatnonzero(~np.isin(code, (FAR, FAR_USER))), far[np.unique(stop[calls[far]], return_index=True)[1]]])
        calls, before, code, rank, value, index, point, point1 = (x[keep] for x in (calls, before, code, rank, value, index, point, point1))
        trip = pa.array(self.of[calls])
        own = lambda c: pc.struct_field(self.calls, c).take(pa.array(calls))
        prior = lambda c: pc.struct_field(self.calls, c).take(pa.array(before, mask=before < 0))
        degree = lambda v: _texts(np.degrees(np.arctan2(v[:, 2], np.hypot(v[:, 0], v[:, 1]))), np.degrees(np.arctan2(v[:, 1], v[:, 0])))
        shown, which = np.unique(index, return_inverse=True)
        paths = pa.array([json.dumps(self.line.path(int(x))) for x in shown], pa.string()).take(pa.array(which))
        second = np.flatnonzero(before >= 0)
        match1 = np.full(len(calls), None, object)
        match1[second] = degree(point1[second])
        columns = {
            "code": pa.array(code, pa.string()), "shape_id": pa.array([shape_id] * len(calls), pa.string()), "trip_id": self.trips.column("trip_id").take(trip), "trip_row": self.trips.column("trip_row").take(trip), "at": pa.array(rank, pa.int32()),
            "r": own("r"), "s": own("s"), "name": own("name"), "r1": prior("r"), "s1": prior("s"), "name1": prior("name"), "value": pa.array(value),
            "place": pa.array(_texts(self.lat[calls], self.lon[calls]), pa.string()), "match": pa.array(degree(point), pa.string()), "match1": pa.array(match1, pa.string()), "path": paths, "index": pa.array(index, pa.int32()),
        }
        return pa.table([columns[x.split()[0]] for x in FOUND.split(", ")], names=[x.split()[0] for x in FOUND.split(", ")])


def _of_shape(rows: pa.Table, calls: pa.Table) -> pa.Table:
    """Problems of some patterns of a shape. rows: the shape's points (spot null), and spots with the segments looked up for them."""
    points, spots = rows.filter(pc.is_null(rows.column("reach"))), rows.filter(pc.is_valid(rows.column("reach")))
    if not (points.num_rows and spots.num_rows and calls.num_rows):
        of = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        return pa.schema([(n, of[k]) for n, k in (x.split() for x in FOUND.split(", "))]).empty_table()
    points = points.sort_by([("shape_pt_sequence", "ascending"), ("_row", "ascending")])
    number = lambda t, c: t.column(c).to_numpy().astype(float)
    patterns = Together(Line(number(points, "lat"), number(points, "lon"), number(points, "shape_dist_traveled")), spots, calls)
    patterns.examined()
    return patterns.table(calls.column("shape_id")[0].as_py())


def spots_of(patterns: DataFrame) -> DataFrame:
    """spot, shape_id, lat, lon, reach: the places where patterns(shape_id, salt, route_type, calls) call, with all salts that have them."""
    stops = F.filter("calls", lambda x: x["lat"].isNotNull())
    each = patterns.select("shape_id", "salt", "route_type", F.size(stops).alias("n"), F.posexplode(stops).alias("i", "c"))
    large = (C("route_type") == 2) & ((C("i") == 0) | (C("i") == C("n") - 1))
    each = each.select("shape_id", "salt", C("c.lat").alias("lat"), C("c.lon").alias("lon"), F.when(large, REACH * LARGE).otherwise(REACH).alias("reach"))
    return each.groupBy("shape_id", "lat", "lon", "reach").agg(F.collect_set("salt").alias("salts")).withColumn("spot", F.monotonically_increasing_id())


def shape_problems(feed: Feed):
    """Problems by code, shape and trip: r, s (row and id of the stop), r1, s1 (of the one before), value and what to show."""
    routes = last_by(feed.df("routes"), "route_id", "route_type")
    places = located(feed).where("at is not null").join(last_by(feed.df("stops"), "stop_id", "stop_name"), "stop_id")
    trips = feed.df("trips").where(full(C("shape_id")) & full(C("trip_id"))).select("trip_id", "shape_id", "route_id", C("_row").alias("trip_row"))
    st = feed.df("stop_times").where(full(C("trip_id"))).select("trip_id", "stop_sequence", "_row", "stop_id", "shape_dist_traveled").join(trips.select("trip_id").distinct(), "trip_id", "left_semi").join(places, "stop_id", "left")
    call = F.struct("stop_sequence", C("_row").alias("r"), C("stop_id").alias("s"), C("at.lat").alias("lat"), C("at.lon").alias("lon"), C("shape_dist_traveled").alias("d"), C("stop_name").alias("name"))
    calls = st.groupBy("trip_id").agg(F.sort_array(F.collect_list(call)).alias("calls"))
    trips = trips.join(routes.withColumn("known", F.lit(True)), "route_id", "left").join(calls, "trip_id")
    trips = trips.withColumn("sig", F.sha2(F.to_json(F.transform("calls", lambda x: F.struct(x["s"], F.coalesce(x["d"], F.lit(0.0)).alias("d")))), 256))
    # the first trip of a pattern stands for it; if its route is unknown, the pattern is not examined
    one = trips.groupBy("shape_id", "sig").agg(F.min_by(F.struct("trip_id", "trip_row", "known", "route_type", "calls"), "trip_row").alias("t")).select("shape_id", "sig", "t.*").where("known").drop("known")
    one = cut(one)
    salts = one.groupBy("shape_id").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts"))
    calls = one.join(salts, "shape_id").withColumn("salt", F.pmod(F.xxhash64("sig"), C("salts")).cast("int")).select("shape_id", "salt", "trip_id", "trip_row", "route_type", "calls")
    points = feed.df("shapes").where(full(C("shape_id"))).select("shape_id", "_row", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon", "shape_dist_traveled")
    spots = looked_up(spots_of(calls), segments(points)).withColumn("salt", F.explode("salts")).drop("salts", "spot")
    points = points.join(salts, "shape_id").withColumn("salt", F.explode(F.sequence(F.lit(0), C("salts") - 1))).drop("salts")
    points = points.withColumnsRenamed({"shape_pt_lat": "lat", "shape_pt_lon": "lon"})
    rows = points.unionByName(spots, allowMissingColumns=True)
    importable(feed.spark)
    found = rows.groupBy("shape_id", "salt").cogroup(calls.groupBy("shape_id", "salt")).applyInArrow(_of_shape, FOUND)
    # a stop is told to be too far once for a shape
    far = C("code").startswith("stop_too_far")
    first = F.row_number().over(Window.partitionBy("shape_id", "s", F.when(~far, C("trip_id"))).orderBy("trip_row", "at"))
    return found.withColumn("first", F.when(far, first).otherwise(1)).where("first = 1").drop("first")


@rule("ShapeToStopMatchingValidator", needs="shapes stop_times trips routes stops")
def shape_matching(feed: Feed, options: RunOptions):
    rows = shape_problems(feed)
    view = {"shapePath": C("path"), "matchIndex": C("index")}
    who = {"tripCsvRowNumber": C("trip_row"), "shapeId": C("shape_id"), "tripId": C("trip_id")}
    one = who | {"stopTimeCsvRowNumber": C("r"), "stopId": C("s"), "stopName": C("name"), "stopLocation": C("place"), "match": C("match")}
    two = who | {"stopTimeCsvRowNumber1": C("r1"), "stopId1": C("s1"), "stopName1": C("name1"), "stopTimeCsvRowNumber2": C("r"), "stopId2": C("s"), "stopName2": C("name")}
    two |= {"match1": C("match1"), "match2": C("match")}
    far = one | {"geoDistanceToShape": C("value")} | view
    context = {
        "stop_too_far_from_shape": far,
        "stop_too_far_from_shape_using_user_distance": far,
        "stop_has_too_many_matches_for_shape": one | {"matchCount": C("value").cast("int")} | view,
        "stops_match_shape_out_of_order": two | view,
    }
    # one map for all codes keeps the matching to one pass
    picked = F.lit(None).cast("map<string,string>")
    for code, c in context.items():
        picked = F.when(C("code") == code, F.create_map(*[x for k, v in c.items() for x in (F.lit(k), v.cast("string"))])).otherwise(picked)
    return rows.select("code", F.lit("WARNING").alias("severity"), F.lit("trips.txt").alias("filename"), C("trip_row").alias("csv_row"), F.lit(None).cast("string").alias("field"), picked.alias("context"))

"""Shape matching against plain loops: distances to arcs by bisection, every choice of matches tried."""

import datetime as dt
import itertools
import json
import math
import time

import numpy as np
import pyarrow as pa
import pytest

from tramline.feed import Feed, complete
from tramline.operators import shapes
from tramline.sources.report import service_window


def unit(lat, lon):
    a, b = math.radians(lat), math.radians(lon)
    return np.array([math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)])


def gap(a, b):
    return shapes.RADIUS * 2 * math.asin(min(1.0, float(np.linalg.norm(a - b)) / 2))


def nearest(p, a, b):
    """Distance from p to the arc from a to b, and how far along it."""
    angle = 2 * math.asin(min(1.0, float(np.linalg.norm(a - b)) / 2))
    if angle < 1e-15:
        return gap(p, a), 0.0
    at = lambda t: (math.sin((1 - t) * angle) * a + math.sin(t * angle) * b) / math.sin(angle)
    low, high = 0.0, 1.0
    for _ in range(120):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, y) if gap(p, at(x)) <= gap(p, at(y)) else (x, high)
    # at an end of the arc, its distance is that of the end itself
    t = 0.0 if low < 1e-6 else 1.0 if low > 1 - 1e-6 else low
    return gap(p, a if t == 0 else b if t == 1 else at(t)), t * angle * shapes.RADIUS


def candidates(points, stop, reach):
    v, p = [unit(*x) for x in points], unit(*stop)
    out, best, along, was_leaving, end = [], None, 0.0, False, math.inf
    for a, b in itertools.pairwise(v):
        away, on = nearest(p, a, b)
        if away <= reach:
            if best and was_leaving and away < end:
                out.append(best)
                best = None
            if best is None or away < best[1]:
                best = (along + on, away)
        elif best:
            out.append(best)
            best = None
        end = gap(p, b)
        was_leaving = end > away
        along += gap(a, b)
    return out + [best] * (best is not None)


def choose(options):
    """The first stop at which no choice is in order, or -1 and the least cost."""
    for n in range(1, len(options) + 1):
        costs = [sum(m[1] for m in c) for c in itertools.product(*options[:n]) if all(x[0] <= y[0] for x, y in itertools.pairwise(c))]
        if not costs:
            return n - 1, None
    return -1, min(costs)


def lines(seed, n=9):
    r = np.random.default_rng(seed)
    steps = r.choice([-1, 1], (n, 2), p=[0.3, 0.7]) * r.uniform(0.0001, 0.0012, (n, 2))
    points = np.cumsum(steps, axis=0) + [40.7, -74.0]
    where = r.uniform(0, n - 1, 4)
    if seed % 3:
        where.sort()
    stops = np.stack([np.interp(where, np.arange(n), points[:, k]) for k in (0, 1)], axis=1) + r.normal(0, 0.0003, (4, 2))
    return points, stops


@pytest.mark.parametrize("seed", range(60))
def test_candidates_and_order(seed):
    points, stops = lines(seed)
    line = shapes.Line(points[:, 0], points[:, 1], np.full(len(points), np.nan))
    found = [m for m, _ in line.examined(stops, np.full(len(stops), shapes.REACH))]
    want = [candidates(points, s, shapes.REACH) for s in stops]
    for got, w in zip(found, want):
        assert len(got) == len(w)
        for m, (along, away) in zip(got, w):
            assert m.along == pytest.approx(along, abs=0.02) and m.away == pytest.approx(away, abs=0.01)
    if all(want):
        best, at, _ = shapes.in_order(found)
        fails, cost = choose(want)
        assert at == fails and (fails >= 0 or sum(m.away for m in best) == pytest.approx(cost, abs=0.05))


def test_order_is_checked_after_too_many_matches():
    """Two stops in reverse order, the first one with more than 20 candidates."""
    lat = 40.7 + np.arange(48) % 2 * 0.003
    lon = -74.0 + np.arange(48) * 0.00002
    points = [(40.7, -74.0 + 47 * 0.00002 + 0.01)]
    line = shapes.Line(np.r_[40.69, lat, points[0][0]], np.r_[-74.0, lon, points[0][1]], np.zeros(50))
    stops = np.array([[40.7, -74.0 + 0.0005], [40.69, -74.0]])
    codes = [p[0] for p in shapes.match(line, stops, np.zeros(2), False)]
    assert codes == ["stop_has_too_many_matches_for_shape", "stops_match_shape_out_of_order"]


def test_users_distances():
    line = shapes.Line(np.array([40.0, 40.01, 40.02]), np.array([-74.0, -74.0, -74.0]), np.array([0.0, 10.0, 20.0]))
    at = line.at_user(15.0, 0, line.v[0])
    assert at.index == 1 and shapes.degrees(at.at) == pytest.approx([40.015, -74.0]) and at.away == pytest.approx(shapes.RADIUS * math.radians(0.015), rel=1e-6)
    assert line.at_user(25.0, 0, line.v[0]).index == 2 and line.at_user(5.0, 1, line.v[0]).along < line.geo[1]  # before the point it starts from
    stops = np.array([[40.0, -74.0], [40.02, -74.0], [40.01, -74.0]])
    assert [p[:2] for p in shapes.match(line, stops, np.array([1.0, 20.0, 10.0]), False)][-1][0] == "stop_too_far_from_shape_using_user_distance"
    # a stop without a distance takes its place by geometry, and comes before the one ahead of it
    codes = [p[0] for p in shapes.match(line, stops[[1, 0]], np.array([0.0, 0.5]), False)]
    assert codes == ["stops_match_shape_out_of_order"] * 2
    assert shapes.alike(1.0, 1.0 + 1e-9) and not shapes.alike(1.0, 1.0001) and not shapes.alike(math.inf, math.inf)
    assert line.path(1) == [[40.01, -74.0]]


def test_single_point():
    line = shapes.Line(np.array([40.0]), np.array([-74.0]), np.array([0.0]))
    assert shapes.match(line, np.array([[40.0, -74.0]]), np.zeros(1), False) == []
    assert [p[0] for p in shapes.match(line, np.array([[40.1, -74.0]]), np.zeros(1), False)] == ["stop_too_far_from_shape"]


def test_service_window(spark):
    day = lambda d: dt.date(2025, 1, d)
    trips = complete(spark.createDataFrame([(2, "T1", "A"), (3, "T2", "B")], "_row long, trip_id string, service_id string"), "trips")
    calendar = spark.createDataFrame([(2, "A", day(9), day(20)), (3, "A", day(5), day(3)), (4, "X", day(1), day(31))], "_row long, service_id string, start_date date, end_date date")
    dates = [(2, "B", day(4), 1), (3, "B", day(12), 1), (4, "A", day(4), 2), (5, "B", day(5), 2), (6, "A", day(7), 2), (7, "A", day(12), 2), (8, "X", day(6), 2)]
    dates = spark.createDataFrame(dates, "_row long, service_id string, date date, exception_type int")
    tables = {"trips": trips, "calendar": complete(calendar, "calendar"), "calendar_dates": complete(dates, "calendar_dates")}
    got = lambda *names: tuple(service_window(Feed(spark, {n: tables[n] for n in names}, {})).collect()[0])
    assert got("trips", "calendar", "calendar_dates") == (day(6), day(11))
    assert got("trips", "calendar") == (day(3), day(20)) and got("trips", "calendar_dates") == (day(4), day(12))


ROWS = pa.schema([("shape_id", pa.string()), ("salt", pa.int32()), ("_row", pa.int64()), ("shape_pt_sequence", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("shape_dist_traveled", pa.float64()), ("reach", pa.float64()), ("near", pa.list_(pa.int32())), ("nearest", pa.int32())])
CALLS = pa.schema([("shape_id", pa.string()), ("salt", pa.int32()), ("trip_id", pa.string()), ("trip_row", pa.int64()), ("route_type", pa.int32()), ("calls", pa.list_(pa.struct([(n, pa.int64()) for n in ("stop_sequence", "r")] + [("s", pa.string()), *[(n, pa.float64()) for n in ("lat", "lon", "d")], ("name", pa.string())])))])


def group(points, users, patterns):
    """What a task gets: points, places with all segments as candidates or the nearest one alone, and patterns of (route type, [(stop, lat, lon, distance)])."""
    line = shapes.Line(points[:, 0], points[:, 1], users)
    rows = [("x", 0, k, k, float(a), float(b), None if math.isnan(u) else float(u), None, None, None) for k, ((a, b), u) in enumerate(zip(points, users))]
    calls, places = [], {}
    for k, (kind, stops) in enumerate(patterns):
        calls.append(("x", 0, f"t{k}", 1000 + k, kind, [{"stop_sequence": i, "r": 100 * k + i, "s": s, "lat": lat, "lon": lon, "d": d, "name": s} for i, (s, lat, lon, d) in enumerate(stops)]))
        known = [x for x in stops if x[1] is not None]
        for i, (_, lat, lon, _) in enumerate(known):
            places[lat, lon, 400.0 if kind == 2 and i in (0, len(known) - 1) else 100.0] = None
    for lat, lon, reach in places:
        (found, one), = line.examined(np.array([[lat, lon]]), np.array([reach]))
        rows.append(("x", 0, None, None, lat, lon, None, reach, list(range(len(line.a))) if found else [], None if found else one.index))
    table = lambda rows, schema: pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema)], schema=schema)
    return line, table(rows, ROWS), table(calls, CALLS)


def by_pattern(line, patterns):
    """The same, pattern by pattern; a stop is too far once."""
    told = set()
    for k, (kind, stops) in enumerate(patterns):
        known = [(100 * k + i, *x) for i, x in enumerate(stops) if x[1] is not None]
        for code, i, j, value, m, before in shapes.match(line, np.array([x[2:4] for x in known]).reshape(-1, 2), np.array([x[4] or 0.0 for x in known]), kind == 2):
            if code.startswith("stop_too_far"):
                if known[i][1] in told:
                    continue
                told.add(known[i][1])
            at = lambda m: None if m is None else json.dumps(shapes.degrees(m.at))
            yield code, f"t{k}", known[i][0], known[i][1], known[j][0] if j >= 0 else None, known[j][1] if j >= 0 else None, value, json.dumps(list(known[i][2:4])), at(m), at(before), m.index


@pytest.mark.parametrize("seed", range(40))
def test_patterns_together_as_one_by_one(seed):
    r = np.random.default_rng(1000 + seed)
    n = int(r.integers(1, 12))
    points = np.cumsum(r.normal(0, 0.002, (n, 2)), axis=0) + [40.7, -74.0]
    users = np.where(r.random(n) < 0.2, np.nan, np.cumsum(r.uniform(-1, 3, n))) if seed % 4 else np.full(n, np.nan)
    at = points[r.integers(0, n, 30)] + r.normal(0, 1, (30, 2)) * r.choice([0.0002, 0.003], (30, 1))
    blank = [*r.choice([0.0, 0.1, 0.5], 3)]
    patterns = []
    for _ in range(60):
        some = r.integers(0, 30, r.integers(0, 7))
        few = r.choice(blank)
        far = sorted(r.uniform(0, 2 * n, len(some))) if r.random() < 0.7 else r.uniform(0, 2 * n, len(some))
        patterns.append((int(r.choice([2, 3])), [(f"s{k % 25}", *((None, None) if k == 29 else map(float, at[k])), None if r.random() < few else float(d)) for k, d in zip(some, far)]))
    line, rows, calls = group(points, users, patterns)
    got = shapes._of_shape(rows, calls).to_pylist()
    want = list(by_pattern(line, patterns))
    short = lambda rows: sorted((*x[:6], round(x[6], 4), x[7], x[10]) for x in [(*y[:4], y[4] or -1, y[5] or "", *y[6:]) for y in rows])
    assert short([tuple(x[c] for c in ("code", "trip_id", "r", "s", "r1", "s1", "value", "place", "match", "match1", "index")) for x in got]) == short(want)
    near = lambda text: text and [round(x, 6) for x in json.loads(text)]
    assert sorted((x["trip_id"], x["r"], x["code"], str(near(x["match"])), str(near(x["match1"]))) for x in got) == sorted((x[1], x[2], x[0], str(near(x[8])), str(near(x[9]))) for x in want)
    assert all(x["name"] == x["s"] and x["name1"] == x["s1"] and json.loads(x["path"]) == line.path(x["index"]) for x in got)


def test_many_patterns_of_a_shape():
    """20,000 patterns, whose stops are far from the shape, in one pass."""
    r = np.random.default_rng(3)
    points = np.stack([40 + r.normal(0, 0.01, 300), -74 + r.uniform(0, 1, 300)], axis=1)
    places = [(float(a), float(b)) for a, b in np.stack([r.uniform(42, 50, 400), r.uniform(-74, -73, 400)], axis=1)]
    patterns = [(3, [(f"s{k}", *places[k], float(50 + 100 * i)) for i, k in enumerate(r.integers(0, 400, 5).tolist())]) for _ in range(20_000)]
    line, rows, calls = group(points, np.arange(300.0), patterns)
    began = time.perf_counter()
    got = shapes._of_shape(rows, calls)
    assert time.perf_counter() - began < 4 and got.num_rows == 400 and set(got.column("code").to_pylist()) == {"stop_too_far_from_shape"}

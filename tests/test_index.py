"""The spatial index, interval joins and searches along paths, against plain loops."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.operators import index, paths, shapes
from tramline.operators.intervals import started_within


def lines(seed):
    """Lines of short and long segments: at a pole, over the date line, with repeated points, and one of a single segment."""
    r = np.random.default_rng(seed)
    walk = lambda lat, lon, n, step: np.cumsum(np.vstack([[lat, lon], r.normal(0, step, (n, 2))]), axis=0)
    found = {"city": walk(40.7, -74.0, 90, 0.002), "zigzag": np.stack([40 + r.normal(0, 0.01, 30), -74 + r.uniform(0, 1, 30)], axis=1), "pole": np.stack([np.full(40, 89.9995), np.linspace(-179, 179, 40)], axis=1)}
    found["date"] = np.stack([np.linspace(10.0, 10.01, 20), np.where(np.arange(20) % 2, 179.9995, -179.9995)], axis=1)
    found["still"] = np.array([[5.0, 5.0], [5.0, 5.0], [5.0, 5.001], [5.0, 5.001]])
    found["one"] = np.array([[0.0, 0.0], [0.0, 0.5]])
    return found


@pytest.mark.parametrize("seed", range(3))
def test_index_finds_what_all_pairs_find(spark, seed):
    r = np.random.default_rng(100 + seed)
    points, spots, want = [], [], {}
    for name, line in lines(seed).items():
        points += [(name, k, k, float(a), float(b)) for k, (a, b) in enumerate(line)]
        at = line[r.integers(0, len(line), 40)] + r.normal(0, 0.0007, (40, 2))
        at = np.vstack([at, [[-30.0, 100.0], [40.7, -73.99]], line[:1]])
        reaches = np.where(np.arange(len(at)) % 3, 100.0, 400.0)
        dense = shapes.Line(line[:, 0], line[:, 1], np.full(len(line), np.nan))
        for (lat, lon), reach in zip(at, reaches):
            spots.append((len(spots), name, float(lat), float(lon), float(reach)))
            want[spots[-1][0]] = (dense, np.array([[lat, lon]]), reach)
    segs = index.segments(spark.createDataFrame(points, "shape_id string, shape_pt_sequence long, _row long, shape_pt_lat double, shape_pt_lon double"))
    table = spark.createDataFrame(spots, "spot long, shape_id string, lat double, lon double, reach double")
    exact = {}
    for row in index.gaps(table, segs).collect():
        exact.setdefault(row.spot, {})[row.j] = row.metres
    some = 0
    for row in index.looked_up(table, segs).collect():
        line, at, reach = want[row.spot]
        (found, nearest), = line.examined(at, np.array([reach]))
        (got, far), = line.examined(at, np.array([reach]), [row.near], [row.nearest])
        assert [(m.index, m.along, m.away) for m in got] == [(m.index, m.along, m.away) for m in found]
        assert (far is None and found) or far.index == nearest.index
        each = [line.examined(at, np.array([1e9]), [[j]], [None])[0][0][0].away for j in range(len(line.a))]
        assert exact.get(row.spot, {}) == pytest.approx({j: d for j, d in enumerate(each) if d <= reach}, abs=1e-3)
        some += bool(found)
    assert some > 100
    assert index.nearest(table.where("shape_id = 'none'"), segs).count() == 0


def test_nearest_prunes_runs(spark, monkeypatch):
    """Runs of two: many boxes, of which few are looked into; the first of equally near segments counts."""
    monkeypatch.setattr(index, "FAN", 2)
    r = np.random.default_rng(7)
    line = np.cumsum(r.normal(0, 0.01, (60, 2)), axis=0)
    line = np.vstack([line, line[::-1]])  # the same way back, so all are tied
    points = [("x", k, k, float(a), float(b)) for k, (a, b) in enumerate(line)]
    segs = index.segments(spark.createDataFrame(points, "shape_id string, shape_pt_sequence long, _row long, shape_pt_lat double, shape_pt_lon double"))
    at = r.normal(0, 0.1, (50, 2))
    table = spark.createDataFrame([(k, "x", float(a), float(b)) for k, (a, b) in enumerate(at)], "spot long, shape_id string, lat double, lon double")
    dense = shapes.Line(line[:, 0], line[:, 1], np.full(len(line), np.nan))
    assert {x.spot: x.nearest for x in index.nearest(table, segs).collect()} == {k: dense._nearest_in_degrees(p) for k, p in enumerate(at)}


def test_intervals_of_a_group(spark):
    r = random.Random(3)
    spans = [(k, r.choice("ab"), (start := r.randrange(-3000, 90000)), start + r.choice([-5, 0, 1, 60, 900, 8000, 90000, 10**7])) for k in range(250)]
    table = spark.createDataFrame(spans, "id long, g string, s long, e long")
    got = started_within(table, ["g"], "s", "e", "id").select("id_a", "id_b").collect()
    # the order of ids stands for that of starts here, so only pairs whose starts agree with it are asked for
    got = sorted((a, b) for a, b in map(tuple, got) if spans[a][2] <= spans[b][2])
    assert got == sorted((a, b) for a, g, s, e in spans for b, h, t, _ in spans if g == h and a < b and s <= t < e) and got


def search(seeds, edges):
    seen, todo = set(seeds), list(seeds)
    while todo:
        x = todo.pop()
        for y in edges.get(x, ()):
            if y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def test_long_chain_in_few_rounds(spark):
    n = 10_000
    edges = spark.range(n).selectExpr("'c' || id as src", "'c' || (id + 1) as dst")
    found, rounds = paths.closure(spark.createDataFrame([("c0",), ("lone",)], "id string"), edges)
    assert found.count() == n + 2 and found.distinct().count() == n + 2 and rounds <= 20


@pytest.mark.parametrize("seed", range(4))
def test_paths_with_caps_and_cycles(spark, monkeypatch, seed):
    """Ways that are capped must not lose anything: stars, cycles, ladders, loops and two searches in one."""
    monkeypatch.setattr(paths, "FAN", 1)
    r = random.Random(seed)
    edges = {(a, r.randrange(60)) for a in range(60) for _ in range(r.choice([0, 1, 3]))} | {(200 + k, 201 + k) for k in range(25)} | {(200 + k, 202 + k) for k in range(24)} | {(7, 7)}
    rows = [("f", a, b) for a, b in edges] + [("b", b, a) for a, b in edges]
    seeds = {("f", 1), ("f", 200), ("b", 30), ("b", 220)}
    found, _ = paths.closure(spark.createDataFrame(list(seeds), "way string, id long"), spark.createDataFrame(rows, "way string, src long, dst long"), "way")
    want = set()
    for way in "fb":
        near = {}
        for w, a, b in rows:
            if w == way:
                near.setdefault(a, []).append(b)
        want |= {(way, x) for x in search([i for w, i in seeds if w == way], near)}
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nothing_to_reach(spark):
    empty = spark.createDataFrame([], "src string, dst string")
    found, rounds = paths.closure(spark.createDataFrame([("a",)], "id string"), empty)
    assert [x.id for x in found.collect()] == ["a"] and rounds <= 2
    assert paths.reach(spark.createDataFrame([], "id string"), spark.createDataFrame([("a", "b")], "src string, dst string")).count() == 0


def test_what_leads_to_known_nodes_is_dropped(spark, monkeypatch):
    """Stations of 12 places, each with ways to all others of its station: one step from the doors, no path is left, and none is doubled."""
    written = []
    monkeypatch.setattr(paths, "cut", lambda df, cut=paths.cut: written.append((df.columns, (out := cut(df)).count())) or out)
    places = spark.range(50 * 12).selectExpr("id", "id div 12 as station")
    edges = places.selectExpr("id as src", "station").join(places.selectExpr("id as dst", "station"), "station").where("src <> dst").select("src", "dst")
    found, rounds = paths.closure(places.where("id % 12 = 0").select("id"), edges)
    assert sorted(x.id for x in found.collect()) == list(range(50 * 12)) and rounds == 2
    assert [n for columns, n in written if "src" in columns] == [50 * 12 * 11, 50 * 11 * 11, 0]


def test_nulls_and_repeats_in_paths(spark):
    seeds = [("f", "a"), ("f", "a"), ("f", None), (None, "a"), ("b", "lone")]
    edges = [("f", "a", "b"), ("f", "a", "b"), ("f", "b", None), ("f", None, "x"), ("f", "b", "c"), ("f", "c", "a"), (None, "a", "y"), ("b", "a", "b"), ("f", "d", "e")]
    found = paths.reach(spark.createDataFrame(seeds, "way string, id string"), spark.createDataFrame(edges, "way string, src string, dst string"), "way")
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("f", "a"), ("f", "b"), ("f", "c"), ("f", None), (None, "a"), ("b", "lone")]))


def zigzag(r, n):
    """The given tables' lines: from place to place of two straight lines, so that segments come again and far spots are all but equally near to many."""
    size = r.integers(1, 51, n)
    return np.stack([40.1 + np.where(r.random(n) < 0.1, 0.0, size * 0.0001), -74 + size * 0.02], axis=1)


def tables(spark, line, spots):
    points = spark.createDataFrame([("z", k, k, float(a), float(b)) for k, (a, b) in enumerate(line)], "shape_id string, shape_pt_sequence long, _row long, shape_pt_lat double, shape_pt_lon double")
    return spark.createDataFrame([(k, "z", *map(float, x)) for k, x in enumerate(spots)], "spot long, shape_id string, lat double, lon double, reach double"), index.segments(points)


def test_far_from_a_zigzag(spark):
    """100 million pairs, none of which boxes can spare; ties are told by the last bit, then by order."""
    r = np.random.default_rng(5)
    line, n = zigzag(r, 6_000), 17_000
    table, segs = tables(spark, line, np.stack([40 + r.integers(0, 1000, n) * 0.01, -74 + r.integers(1, 51, n) * 0.02, np.full(n, 100.0)], axis=1))
    began = time.perf_counter()
    got = {x.spot: (x.nearest, x.square) for x in index.nearest(table, segs).collect()}
    assert time.perf_counter() - began < 25 and len(got) == n
    ends = [(*a, *b) for a, b in zip(line.tolist(), line[1:].tolist())]
    for s in table.where("spot % 500 = 7").collect():
        best = None
        for j, (y1, x1, y2, x2) in enumerate(ends):
            ax, ay = x2 - x1, y2 - y1
            size = ax * ax + ay * ay
            part = min(1.0, max(0.0, ((s.lon - x1) * ax + (s.lat - y1) * ay) / size)) if size else 0.0
            px, py = x1 + part * ax - s.lon, y1 + part * ay - s.lat
            best = min(best or (np.inf,), (px * px + py * py, j))
        assert got[s.spot] == (best[1], best[0])


def test_close_to_a_zigzag(spark, monkeypatch):
    """Six million pairs, most of them within reach, in many groups and pieces; hot places."""
    monkeypatch.setattr(index, "SPOTS", 300)
    monkeypatch.setattr(index, "PIECE", 1_000)
    monkeypatch.setattr(index, "PAIRS", 1 << 17)
    r = np.random.default_rng(6)
    line, n = zigzag(r, 3_000), 2_000
    spots = np.stack([40.1 + r.integers(-5, 6, n) * 0.01, -74 + r.integers(1, 51, n) * 0.02, np.full(n, 25_000.0)], axis=1)
    spots[:500] = spots[0]
    table, segs = tables(spark, line, spots)
    began = time.perf_counter()
    rows = index.gaps(table, segs)
    got = {x.spot: (x.n, x.sum) for x in rows.groupBy("spot").agg(F.count("*").alias("n"), F.sum("metres").alias("sum")).collect()}
    assert time.perf_counter() - began < 25
    dense = shapes.Line(line[:, 0], line[:, 1], np.full(len(line), np.nan))
    every = [np.arange(len(line) - 1)]
    for k in [0, 499, *range(500, n, 60)]:
        away = np.array([dense.examined(spots[k : k + 1, :2], np.array([1e9]), [[j]], [None])[0][0][0].away for j in every[0][::37]])
        some = {x.j: x.metres for x in rows.where(f"spot = {k} and j % 37 = 0").collect()} if k < 800 else None
        assert some is None or some == pytest.approx({37 * i: a for i, a in enumerate(away) if a <= 25_000}, abs=1e-6)
        assert got[k][0] == got[0][0] or k > 499
    assert sum(n for n, _ in got.values()) > 3_000_000 and rows.select("spot", "j").distinct().count() == sum(n for n, _ in got.values())

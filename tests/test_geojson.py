"""Rings that cross themselves, and places examined in tasks as by plain Python."""

import json
import time

import numpy as np
import pytest

from tramline.feed import RunOptions
from tramline.sources.feed import read_feed
from tramline.sources.geojson import places_of, read_locations
from tramline.sources.rings import crosses_itself


def every_pair(ring):
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    edges = list(zip(ring[:-1], ring[1:]))
    for i, (a, b) in enumerate(edges):
        for j in range(i + 2, len(edges)):
            c, d = edges[j]
            if (i, j) != (0, len(edges) - 1) and turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                return True
    return False


@pytest.mark.parametrize("kind", ["grid", "random", "star", "comb"])
def test_rings_as_every_pair(kind):
    r = np.random.default_rng(len(kind))
    seen = set()
    for _ in range(300):
        m = int(r.integers(3, 14))
        if kind == "grid":  # points that touch, repeat and lie in line
            p = r.integers(0, 4, (m, 2)).astype(float)
        elif kind == "random":
            p = r.normal(0, 1, (m, 2))
        elif kind == "star":
            a = np.sort(r.uniform(0, 2 * np.pi, m))
            p = np.stack([np.cos(a), np.sin(a)], axis=1) * r.uniform(0.3, 1, (m, 1))
        else:
            p = np.stack([np.arange(m), np.where(np.arange(m) % 2, 5, r.uniform(0, 6, m))], axis=1)
        ring = np.vstack([p, p[:1]])
        seen.add(crosses_itself(ring))
        assert crosses_itself(ring) == every_pair(ring.tolist())
    assert len(seen) == 2 or kind == "star"


def test_long_rings():
    a = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    ring = (1 + 0.3 * np.sin(500 * a))[:, None] * np.stack([np.cos(a), np.sin(a)], axis=1)
    began = time.perf_counter()
    assert not crosses_itself(np.vstack([ring, ring[:1]]))
    ring[[70_000, 70_003]] = ring[[70_003, 70_000]]
    assert crosses_itself(np.vstack([ring, ring[:1]])) and time.perf_counter() - began < 10


def documents():
    box = lambda x, y: [[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]
    polygon = lambda *rings, **more: {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": list(rings)}} | more
    features = [
        polygon(box(5, 50), id="a"), polygon(box(6, 50), id="a"), polygon(box(5, 50), id="b"), polygon(box(5, 50)[:-1], id="c"), polygon([[0, 50], [2, 52], [2, 50], [0, 52], [0, 50]], id=7), polygon(box(0, 0), id="o"),
        polygon(box(10, 88.5), id="n", odd=1), {"type": "Thing"}, None, {"type": "Feature", "id": "g", "properties": None, "geometry": None}, {"type": "Feature", "id": "p", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "id": "m", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[box(1.5, 2.5)], [box(8, 9)]]}}, polygon(id="e"), polygon(box(1, True), id="t"),
    ]
    features.append(features[11] | {"id": "m2"})
    whole = {"type": "FeatureCollection", "features": features, "extra": 1}
    return [json.dumps(whole), "﻿" + json.dumps(whole, ensure_ascii=False), "{", "[]", '{"type": "x"}', '{"type": "FeatureCollection"}', '{"type": "FeatureCollection", "features": []}', "", json.dumps({"features": []})]


@pytest.mark.parametrize("thorough", [False, True])
def test_places_in_tasks(spark, thorough):
    options = RunOptions(thorough=thorough)
    for text in documents():
        rows, notices, _ = read_locations(text.encode(), options)
        for value, kind in ((text, "string"), (text.encode(), "binary")):
            places, found = places_of(spark.createDataFrame([(value,)], f"value {kind}"), options)
            assert sorted(map(tuple, places.collect())) == sorted(rows)
            key = lambda n: json.dumps(list(n), sort_keys=True)
            assert sorted(key(n) for n in found.collect()) == sorted(key(n) for n in notices)


def test_places_of_a_folder(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id\nS1\n")
    (tmp_path / "locations.geojson").write_text(documents()[0])
    feed = read_feed(spark, str(tmp_path))
    assert feed.geojson_fatal and {x.location_id for x in feed.tables["locations"].collect()} == {"a", "b", "7", "o", "n", "m", "m2"}

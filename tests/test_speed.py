"""Far stops against plain loops, long patterns, and hot blocks."""

import os
import random
import time

import pytest

from tramline import synth
from tramline.operators import all_rules
from tramline.operators.intervals import started_within
from tramline.operators.space import far_stops
from tramline.plans.runner import run_rule

LEGS = "pattern string, i int, d int, a int, leg double, km double, top double"


def pattern(r, n, top):
    """Calls in order: some without times, some in whole minutes, some that go back in time."""
    out, km, now = [], 0.0, 6 * 3600
    for i in range(n):
        leg = 0.0 if i == 0 else r.choice([0.0, 0.4, 1.7, 3.3, 12.0]) * r.uniform(0.5, 1.5)
        km += leg
        now += r.choice([0, 60, 60, 120, 45, 600, -30])
        a = None if r.random() < 0.2 else now
        d = None if r.random() < 0.2 else now + r.choice([0, 0, 30, 60])
        out.append((i, d, a, leg, km, top))
    return out


def by_loops(calls):
    for i2, _, arrival, *_ in calls:
        if arrival is None:
            continue
        dist = 0.0
        for i1 in range(i2 - 1, -1, -1):
            dist += calls[i1 + 1][3]
            if (departure := calls[i1][1]) is None:
                continue
            took = arrival - departure
            took = 60 if took <= 0 else took + 60 if departure % 60 == 0 and arrival % 60 == 0 else took
            if (kph := dist / took * 3600.0) > calls[i1][5] and dist > 10:
                return i1, i2, kph, dist
    return None


def test_far_stops_as_loops(spark):
    r = random.Random(9)
    patterns = {f"p{k}": pattern(r, r.choice([1, 2, 5, 30]), r.choice([30.0, 100.0, 150.0, 500.0])) for k in range(150)}
    rows = [(k, *c) for k, calls in patterns.items() for c in calls]
    got = {x.pattern: (x.i1, x.i2, x.kph, x.dist) for x in far_stops(spark.createDataFrame(rows, LEGS)).collect()}
    want = {k: found for k, calls in patterns.items() if (found := by_loops(calls))}
    assert got == want and len(want) > 40  # to the last bit, as sums have the same order


def test_long_pattern(spark):
    """10,000 calls of which none is too fast: no pair of them is made."""
    slow = [("slow", i, 21600 + 90 * i, 21570 + 90 * i, 0.5, 0.5 * i, 150.0) for i in range(10_000)]
    fast = [("fast", i, 21600 + 90 * i - 80 * max(0, i - 9000), 21570 + 90 * i - 80 * max(0, i - 9000), 0.5, 0.5 * i, 150.0) for i in range(10_000)]
    legs = spark.createDataFrame(slow + fast, LEGS)
    far_stops(legs.limit(10)).collect()
    began = time.perf_counter()
    got = far_stops(legs).collect()
    assert time.perf_counter() - began < 30 and [x.pattern for x in got] == ["fast"] and 9000 < got[0].i2 < 9100


def test_hot_block(spark):
    """A block of 100,000 trips one after the other: buckets spread them, and no pair is made that doesn't overlap."""
    spans = spark.range(100_000).selectExpr("'b' AS g", "id", "id * 60 AS s", "id * 60 + CASE WHEN id % 1000 = 0 THEN 130 ELSE 60 END AS e")
    got = started_within(spans, ["g"], "s", "e", "id")
    assert got.count() == 200
    assert [x.simpleString() for x in got.schema.fields][:1] == ["g:string"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_calls_are_shuffled_by_stop_and_by_trip_alone(spark):
    """As where no table is small enough to broadcast: a wide row for each call is not dealt by pattern, by either call's stop or over and over again."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = run_rule(synth.feed(spark, "/root/testdata/sf0.001"), all_rules()["StopTimeTravelSpeedValidator"], synth.OPTIONS)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    keys = {line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line}
    assert "trip_id" in keys and keys <= {"trip_id", "stop_id", "route_id", "l_orderkey", "s0", "p0", "p1", "s1", "s2"}

"""Streams: feeds that arrive, and sessions of events, as a stream and at once."""

import datetime as dt
import zipfile

from tramline.streaming import sessions, watch_feeds


def test_feeds_are_handled_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()

    def arrive(name):
        with zipfile.ZipFile(folder / name, "w") as z:
            z.writestr("agency.txt", "agency_id\n")

    for names in (["a.zip", "b.zip"], ["c.zip"], []):
        for n in names:
            arrive(n)
        (folder / "note.txt").write_text("x")
        stream = watch_feeds(spark, str(folder), str(tmp_path / "checkpoint"), seen.append)
        stream.processAllAvailable()
        stream.stop()
    assert sorted(s.rpartition("/")[2] for s in seen) == ["a.zip", "b.zip", "c.zip"]


def test_sessions(spark, tmp_path):
    at = lambda h, m: dt.datetime(2025, 1, 1, h, m)
    rows = [(at(8, 0), 1), (at(8, 20), 1), (at(9, 0), 1), (at(8, 0), 2), (at(8, 29), 2), (at(8, 58), 2)]
    df = spark.createDataFrame(rows, "ts timestamp, user_id long")
    want = [(1, at(8, 0), at(8, 50), 2), (1, at(9, 0), at(9, 30), 1), (2, at(8, 0), at(9, 28), 3)]
    assert sorted(tuple(r) for r in sessions(df).collect()) == want
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    late = spark.createDataFrame([(at(23, 0), 9)], df.schema)  # moves the watermark past the sessions
    stream = sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))).writeStream.format("memory").queryName("found").outputMode("append").start()
    stream.processAllAvailable()
    late.write.mode("append").parquet(str(tmp_path / "events"))
    stream.processAllAvailable()
    stream.stop()
    assert sorted(tuple(r) for r in spark.table("found").collect()) == want


def test_changes_of_versions(spark, tmp_path):
    """Two versions of a feed, a restart between them, a late version, one without notices, and another feed."""
    import warnings

    from tramline.streaming.changes import append_totals, follow

    folder, seen = str(tmp_path / "totals"), []
    day = lambda d: dt.datetime(2025, 3, d)

    def arrive(feed, version, **codes):
        rows = [(code,) for code, n in codes.items() for _ in range(n)]
        append_totals(spark.createDataFrame(rows, "code string"), feed, version, folder)

    def go():
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            stream = follow(spark, folder, str(tmp_path / "checkpoint"), lambda df: seen.extend(tuple(r) for r in df.collect()))
            stream.processAllAvailable()
            stream.stop()
        out = sorted(seen)
        seen.clear()
        return out

    arrive("harbour", day(1), stop_too_far=2, unused_trip=1)
    arrive("hills", day(1), unused_trip=4)
    assert go() == [("harbour", day(1), "stop_too_far", 0, 2), ("harbour", day(1), "unused_trip", 0, 1), ("hills", day(1), "unused_trip", 0, 4)]
    arrive("harbour", day(3), stop_too_far=2, missing_level=5)
    assert go() == [("harbour", day(3), "missing_level", 0, 5), ("harbour", day(3), "unused_trip", 1, 0)]
    arrive("harbour", day(2), stop_too_far=9)  # late
    arrive("hills", day(1), unused_trip=7)  # again
    assert go() == []
    arrive("harbour", day(4))
    arrive("hills", day(2), unused_trip=4)
    arrive("hills", day(3), unused_trip=5)
    assert go() == [("harbour", day(4), "missing_level", 5, 0), ("harbour", day(4), "stop_too_far", 2, 0), ("hills", day(3), "unused_trip", 4, 5)]

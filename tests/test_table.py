"""One table of a feed as a Spark source, the record store, and paths of any characters."""

import io
import random
import zipfile

import pytest

from tramline import api
from tramline.sources import table
from tramline.sources.feed import fetch, read_feed, records
from tramline.sources.lines import records_of


def folder(tmp_path, text, name="stops.txt"):
    (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "agency.txt").write_text("agency_id\nA1\n")
    return str(tmp_path)


def test_lines_of_ranges():
    """Whatever the ranges, each line comes once and whole."""
    r = random.Random(4)
    for _ in range(200):
        raw = b"".join(r.choice([b"a", b"bb", b"\n", b"\r\n", b"\xc3\xa9"]) for _ in range(r.randint(0, 60)))
        size, got = r.randint(1, 20), []
        for a in range(0, max(len(raw), 1), size):
            got += table._lines(io.BytesIO(raw), a, min(len(raw), a + size), piece=r.randint(1, 9))
        want, at = [], 0
        for line in raw.split(b"\n"):
            want.append((at, line.removesuffix(b"\r")))
            at += len(line) + 1
        assert got == (want if not raw.endswith(b"\n") and raw else want[:-1])


@pytest.mark.parametrize("split", [7, 64, 10**6])
def test_table_in_ranges(spark, tmp_path, split):
    text = "﻿stop_id, stop_name ,stop_lat,odd\n" + "".join(f'S{k},"Quay, ""{k}""",{k / 4},x\n' for k in range(60)) + "S60,ragged\nS61,é,bad,x\nS62,last,1.5,x"
    path = folder(tmp_path, text, "Stops.TXT")
    spark.dataSource.register(table.TransitTable)
    raw = spark.read.format("transit_table").options(table="stops", splitbytes=str(split)).load(path)
    rows = raw.select("_offset", "stop_id", "stop_name", "stop_lat", "zone_id").collect()
    want = [(cells[0], cells[1], cells[2], None) for _, cells in list(records(text.encode()))[1:] if len(cells) == 4]
    assert sorted(tuple(x)[1:] for x in rows) == sorted(want)
    assert all(text.encode()[x["_offset"] :].startswith(x["stop_id"].encode()) for x in rows)
    got = table.read_table(spark, path, "stops", ["stop_lat", "stop_id"], splitbytes=str(split))
    assert got.columns == ["_row", "stop_lat", "stop_id"] and got.count() == 61  # without the one that doesn't parse
    assert got.agg({"stop_lat": "sum"}).first()[0] == sum(k / 4 for k in range(60)) + 1.5


def test_only_its_file_is_opened(spark, tmp_path):
    """Other files may be unreadable, or absent; a missing one is an error of its own."""
    path = folder(tmp_path, "stop_id\nS1\n")
    (tmp_path / "trips.txt").write_bytes(b'"\xff\xfe broken')
    (tmp_path / "trips.txt").chmod(0)
    assert [x.stop_id for x in table.read_table(spark, path, "stops", ["stop_id"]).collect()] == ["S1"]
    with pytest.raises(Exception, match=r"routes\.txt"):
        table.read_table(spark, path, "routes", ["route_id"]).collect()
    with pytest.raises(Exception, match="must be one of"):
        spark.read.format("transit_table").option("table", "nothing").load(path)


def test_zip_and_records_over_lines(spark, tmp_path):
    text = 'stop_id,stop_name\nS1,"two\nlines"\nS2,x\n'
    path = folder(tmp_path, text)
    with pytest.raises(Exception, match="multiline"):
        table.read_table(spark, path, "stops", ["stop_name"]).collect()
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("stops.txt", text)
    for source, options in ((path, {"multiline": "true"}), (f"{path}/feed.zip", {})):
        got = table.read_table(spark, source, "stops", ["stop_name"], **options).collect()
        assert [(x["_row"], x["stop_name"]) for x in got] == [(2, "two\nlines"), (4, "x")]


def test_store_opens_one_files_folder(spark, tmp_path):
    folder(tmp_path, "stop_id\nS1\nS2\n")
    cells = records_of(spark, {n: f"file://{tmp_path}/{n}.txt" for n in ("stops", "agency")})
    one = cells.where("file = 'agency'")
    assert [list(x.cells) for x in one.collect()] == [["A1"]]
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(file" in plan


@pytest.mark.parametrize("name", ["feed[1]", "a{b,c}", "what?", "star*", "two words"])
def test_paths_of_any_characters(spark, tmp_path, name):
    (tmp_path / name).mkdir()
    path = folder(tmp_path / name, "stop_id,stop_name\nS1,x\n")
    assert [x.stop_id for x in read_feed(spark, path).df("stops").collect()] == ["S1"]


def test_download_into_the_shared_folder(spark, tmp_path):
    path = folder(tmp_path, "stop_id,stop_name,stop_lat,stop_lon\nS1,Quay,1,2\n")
    with zipfile.ZipFile(tmp_path / "my feed.zip", "w") as z:
        z.write(f"{path}/stops.txt", "stops.txt")
    got = fetch(spark, (tmp_path / "my feed.zip").as_uri())
    assert str(spark.sparkContext.getCheckpointDir()).removeprefix("file:").lstrip("/") in got
    assert read_feed(spark, got).df("stops").count() == 1
    assert fetch(spark, (tmp_path / "my feed.zip").as_uri(), str(tmp_path / "kept")).startswith(str(tmp_path / "kept"))
    lost = api.validate(str(tmp_path / "nothing"), spark=spark)
    assert [n.code for n in lost.system_errors] == ["i_o_error"]

"""Records of files in splits against the csv module on the whole file."""

import csv
import io
import random

import pytest

from tramline.sources import lines
from tramline.sources.feed import records


@pytest.mark.parametrize("seed", range(300))
def test_quotes(seed):
    r = random.Random(seed)
    text = "".join(r.choice('ab,,"""\n') for _ in range(r.randint(1, 60)))
    inside, starts = False, []
    parts = text.split("\n")
    for k, line in enumerate(parts):
        if not inside:
            starts.append(k + 1)
        inside = lines.within_quotes(line.encode(), inside)
    reader, want, line = csv.reader(io.StringIO(text, newline="")), [], 1
    for _ in reader:
        want.append(line)
        line = reader.line_num + 1
    assert starts == want or starts[:-1] == want and parts[-1] == ""


@pytest.mark.parametrize("size", [64, 2000, 100_000])
def test_splits(spark, tmp_path, size):
    r = random.Random(size)
    cell = lambda: r.choice(["x", "", "é", '"a,b"', '"two\nlines"', '"say ""hi"""', '5" pipe', '"' + "long\n" * 30 + '"'])
    text = "a,b,c\n" + "".join(",".join(cell() for _ in range(3)) + "\n" * r.choice([1, 1, 1, 2]) for _ in range(12))
    raw = {"one": text.encode() + b'\xff,"open\nto the end', "two": b"\xef\xbb\xbfa\n", "three": text.encode()}
    for name, content in raw.items():
        (tmp_path / f"{name}.txt").write_bytes(content)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted((x["file"], x["line"], list(x["cells"])) for x in lines.records_of(spark, {n: f"file://{tmp_path}/{n}.txt" for n in raw}).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted((n, line, cells) for n, content in raw.items() for line, cells in list(records(content))[1:])

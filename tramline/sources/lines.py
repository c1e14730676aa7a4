"""CSV records of files that Spark reads in splits: no task holds a file, and a record may span lines, and splits.

A split is a block of a file. A first pass tells for each block its number of lines and whether it ends within quotes, if it begins outside and if
it begins inside. Of these (a row per block) the driver makes the number of each block's first line and whether it begins within quotes.
With that, sent to each executor once, a second pass parses the records that lie in a block, and gives the pieces of those that don't, which are then put
together by the block in which they begin. Records are kept in a store in the shared folder, as Parquet in a folder for each file, so what reads one
file's records opens no other's.
"""

from __future__ import annotations

import csv
import io
import re
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoint import shared_dir
from ..functions.workers import importable

csv.field_size_limit(sys.maxsize)
Block = tuple[str, int]


def within_quotes(line: bytes, inside: bool) -> bool:
    """Whether the end of a line is within quotes. A quote opens at the begin of a cell alone; two within quotes are one that stays."""
    if b'"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == b'"':
                at += 2
                continue
            inside = False
        elif line[at : at + 1] == b'"':
            inside, at = True, at + 1
            continue
        at = line.find(b",", at)
        if at < 0:
            return False
        at += 1


def parsed(lines: list[bytes]) -> list[str]:
    """The cells of a record. Bytes that are no UTF-8 become U+FFFD; a blank line has none."""
    return next(csv.reader(io.StringIO(b"\n".join(lines).decode("utf-8", "replace"), newline="")), [])


def blocks_of(lines: DataFrame) -> list[tuple[str, int, int, bool, bool, bool]]:
    """file, block, number of lines, whether it ends within quotes if it begins outside, and if inside, and whether in that case a line ends outside; in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[Block, list] = {}
        for batch in batches:
            for file, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = found.setdefault((file, block), [0, False, True, False])
                state[0] += 1
                if b'"' in raw:
                    state[1:3] = within_quotes(raw, state[1]), within_quotes(raw, state[2])
                    state[3] = state[3] or not state[2]
        rows = [(*k, *v) for k, v in found.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["file", "block", "n", "out", "in", "closes"])

    return sorted(tuple(r) for r in lines.mapInArrow(run, "file string, block long, n long, out boolean, in boolean, closes boolean").collect())


def literal(path: str) -> str:
    """A path whose characters stand for themselves where Spark takes a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def stored(records: DataFrame) -> DataFrame:
    """records(file, ...) written to the shared folder, a folder for each file, and read again: a filter by file opens its folder alone."""
    folder = f"{shared_dir(records.sparkSession)}/records-{uuid.uuid4().hex}"
    records.write.partitionBy("file").parquet(folder)
    return records.sparkSession.read.schema(records.schema).parquet(folder)


def records_of(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """file, line, cells of all records of the files at paths but their first, by the names given to the files."""
    importable(spark)
    names = {p.rpartition("/")[2]: n for n, p in paths.items()}
    named = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    lines = spark.read.text([literal(p) for p in paths.values()]).select(named[F.col("_metadata.file_name")].alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))
    begins: dict[Block, tuple[int, bool, int]] = {}  # first line, whether it is within quotes, and the block in which its first record begins
    last, line, inside, head, torn = None, 1, False, 0, False
    for file, block, n, out, within, closes in blocks_of(lines):
        torn |= inside  # a record goes on in this block, or a file ends within one
        if file != last:
            last, line, inside, head = file, 1, False, block
        begins[file, block] = (line, inside, head if inside else block)
        ends = within if inside else out
        if not inside or closes:
            head = block
        line, inside = line + n, ends

    sent = spark.sparkContext.broadcast(begins)  # a row for each 128 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = sent.value
        out: list[tuple] = []
        now: Block | None = None
        line, inside, head, first, torn = 1, False, 0, 1, False
        held: list[bytes] = []

        def piece() -> None:
            if held:
                out.append((now[0], first, None, b"\n".join(held), head, now[1]))
                held.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["file", "line", "cells", "piece", "head", "block"])
            out.clear()
            return batch

        for batch in batches:
            for file, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != now:
                    piece()
                    now = (file, block)
                    line, inside, head = begins[now]
                    torn = inside  # the record at hand began in an earlier block
                if not held:
                    first = line
                held.append(raw)
                inside = within_quotes(raw, inside)
                line += 1
                if not inside:
                    if torn:
                        piece()
                        torn, head = False, block
                    else:
                        out.append((file, first, parsed(held), None, None, None))
                        held.clear()
            yield made()
        piece()
        yield made()

    every = stored(lines.mapInArrow(run, "file string, line long, cells array<string>, piece binary, head long, block long"))
    whole = every.where("piece is null").select("file", "line", "cells")
    if torn or inside:
        whole = whole.unionByName(every.where("piece is not null").groupBy("file", "head").applyInArrow(_joined, "file string, line long, cells array<string>"))
    return whole.where("line > 1")


def _joined(pieces: pa.Table) -> pa.Table:
    rows = sorted(zip(*(pieces.column(c).to_pylist() for c in ("block", "line", "piece", "file")), strict=True))
    cells = parsed(b"\n".join(r[2] for r in rows).split(b"\n"))
    return pa.table({"file": [rows[0][3]], "line": pa.array([rows[0][1]], pa.int64()), "cells": pa.array([cells], pa.list_(pa.string()))})

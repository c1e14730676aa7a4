"""One table of a feed as a Spark source: spark.read.format("transit_table").option("table", "stops").load(folder).

A file of a folder is read in byte ranges, a member of a zip as a stream by one task; no other file is opened. Columns are text; a schema with some of a
table's columns reads these alone, and `_offset` is the byte at which a record's line begins (in a zip, and with multiline, its line). Lines are records unless
the option multiline is true, which reads a file as a stream by one task; a line that ends within quotes is an error otherwise, never two records.
read_table() gives the typed columns.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.workers import importable
from ..model import TABLES, file_of
from .feed import Files, local, opened, records, typed
from .lines import parsed, within_quotes

OFFSET, SPLIT, ROWS = "_offset", 128 << 20, 20_000


class Range(InputPartition):
    def __init__(self, start: int, end: int | None):
        self.start, self.end = start, end


class TableReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table = local(options["path"]).rstrip("/"), options["table"]
        self.split, self.multiline = int(options.get("splitbytes", SPLIT)), options.get("multiline", "false").lower() == "true"
        self.names = [f.name for f in schema.fields]
        self.zipped = self.path.lower().endswith(".zip")

    def _file(self) -> str:
        store, top = pa_fs.FileSystem.from_uri(self.path) if "://" in self.path else (pa_fs.LocalFileSystem(), self.path)
        names = {i.base_name: i.path for i in store.get_file_info(pa_fs.FileSelector(top)) if i.is_file}
        want = file_of(self.table)
        name = want if want in names else min((n for n in names if n.lower() == want), key=str.lower, default=None)
        if name is None:
            raise FileNotFoundError(f"{self.path}/{want}")
        return f"{self.path}/{name}"

    def partitions(self) -> list[Range]:
        if self.zipped or self.multiline:
            return [Range(0, None)]
        with opened(self._file()) as f:
            size = f.seek(0, 2)
            size = f.tell() if size is None else size
        return [Range(a, min(size, a + self.split)) for a in range(0, max(size, 1), self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        header, found = self._whole() if part.end is None else self._range(part)
        at = [header.index(n) if n in header else None for n in self.names]
        while some := list(itertools.islice(found, ROWS)):
            some = [(where, cells) for where, cells in some if len(cells) == len(header)]
            columns = [[where for where, _ in some] if n == OFFSET else [cells[k] for _, cells in some] if k is not None else [None] * len(some) for n, k in zip(self.names, at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == OFFSET else pa.string()) for n, c in zip(self.names, columns, strict=True)], names=self.names)

    def _whole(self) -> tuple[list[str], Iterator[tuple[int, list[str]]]]:
        if self.zipped:
            files = Files(self.path)
            name = files.find(file_of(self.table))
            if name is None:
                raise FileNotFoundError(f"{self.path}: {file_of(self.table)}")
            body = records(files.stream(name))
        else:
            body = records(opened(self._file()))
        return [c.strip() for c in next(body, (1, []))[1]], body

    def _range(self, part: Range) -> tuple[list[str], Iterator[tuple[int, list[str]]]]:
        file = self._file()
        with opened(file) as f:
            header = _lines(f, 0, 1)
            first = next(header, (0, b""))[1].removeprefix(b"\xef\xbb\xbf")
        return [c.strip() for c in parsed([first])], self._records(file, part)

    def _records(self, file: str, part: Range) -> Iterator[tuple[int, list[str]]]:
        with opened(file) as f:
            for at, line in _lines(f, part.start, part.end):
                if at:  # the header is no record
                    if within_quotes(line, False):
                        raise ValueError(f"{file}: a line ends within quotes at byte {at}; set the option multiline")
                    yield at, parsed([line])


def _lines(f, start: int, end: int, piece: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each line that begins in [start, end), without its line end; one that a range begins within belongs to the range before."""
    at = max(start - 1, 0)
    f.seek(at)
    held = b""
    skip = start > 0
    while at < end:
        cut = held.find(b"\n")
        while cut < 0:
            more = f.read(piece)
            if not more:
                break
            before = len(held)
            held += more
            cut = held.find(b"\n", before)
        line, held_ = (held, b"") if cut < 0 else (held[:cut], held[cut + 1 :])
        if cut < 0 and not line:
            return
        if not skip:
            yield at, line.removesuffix(b"\r")
        skip = False
        at += len(line) + 1
        held = held_


class TransitTable(DataSource):
    """Options: path (a folder or a zip), table (as stops), splitbytes, multiline."""

    @classmethod
    def name(cls) -> str:
        return "transit_table"

    def schema(self) -> StructType:
        if self.options.get("table") not in TABLES:
            raise ValueError(f"the option table must be one of {', '.join(TABLES)}")
        return StructType([StructField(OFFSET, LongType()), *[StructField(c.name, StringType()) for c in TABLES[self.options["table"]]]])

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(dict(self.options), schema)


def read_table(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """`_row` (the offset) and the typed columns of one table, by default all. Rows whose required values don't parse are left out."""
    importable(spark)
    spark.dataSource.register(TransitTable)
    names = columns or [c.name for c in TABLES[table]]
    schema = ", ".join([f"{OFFSET} long", *[f"{n} string" for n in names]])
    raw = spark.read.format("transit_table").schema(schema).options(table=table, **options).load(path)
    cells = raw.select(F.col(OFFSET).alias("line"), F.array(*[F.coalesce(n, F.lit("")) for n in names]).alias("cells"))
    return typed(cells, table, names).select("_row", *names)

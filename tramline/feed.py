"""A feed as DataFrames, run options, and the notices that rules give."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import REQUIRED_TABLES, SPARK_TYPE, TABLES, file_of

OK, MISSING, BROKEN = "ok", "missing", "broken"
NOTICE = "code string, severity string, filename string, csv_row long, field string, context map<string,string>"


@dataclass(frozen=True)
class RunOptions:
    """date: the day of validation, today in UTC by default."""

    date: dt.date = field(default_factory=lambda: dt.datetime.now(dt.UTC).date())
    country: str | None = None
    google: bool = False
    thorough: bool = False


def complete(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns, those it lacks as nulls, and `_row`."""
    have = set(df.columns)
    columns = [F.col(c.name).cast(SPARK_TYPE[c.kind]).alias(c.name) if c.name in have else F.lit(None).cast(SPARK_TYPE[c.kind]).alias(c.name) for c in TABLES[table]]
    return df.select(F.col("_row").cast("long").alias("_row"), *columns)


@dataclass
class Feed:
    """Tables present in a feed: DataFrames with all model columns and `_row`, the line each row begins on.

    `locations` holds the features of locations.geojson. A table may be present and empty, which differs from absent.
    """

    spark: SparkSession
    tables: dict[str, DataFrame]
    headers: dict[str, list[str]]
    broken: set[str] = field(default_factory=set)
    notices: DataFrame | None = None
    files: list[str] = field(default_factory=list)
    geojson_fatal: bool = False

    def has(self, *tables: str) -> bool:
        return all(t in self.tables for t in tables)

    def df(self, table: str) -> DataFrame:
        """The table; if absent, an empty one."""
        if table not in self.tables:
            schema = "_row long, " + ", ".join(f"{c.name} {SPARK_TYPE[c.kind]}" for c in TABLES[table])
            self.tables_absent = getattr(self, "tables_absent", {})
            if table not in self.tables_absent:
                self.tables_absent[table] = self.spark.createDataFrame([], schema)
            return self.tables_absent[table]
        return self.tables[table]

    def status(self, table: str) -> str:
        return BROKEN if table in self.broken else OK if table in self.tables else MISSING

    def errors(self, *tables: str) -> bool:
        """Whether one of the tables had errors while loading; absent required tables count."""
        return any(t in self.broken or t not in self.tables and t in REQUIRED_TABLES for t in tables)

    def header(self, table: str, *columns: str, exact: bool = False) -> bool:
        """Whether the file's header has all the columns."""
        names = self.headers.get(table, [])
        names = {n.strip() if exact else n.strip().lower() for n in names}
        return all(c in names for c in columns)

    def no_notices(self) -> DataFrame:
        if not hasattr(self, "_none"):
            self._none = self.spark.createDataFrame([], NOTICE)
        return self._none


_recorders: list[list[tuple[str, str, dict[str, str]]]] = []


@contextmanager
def recorded() -> Iterator[list[tuple[str, str, dict[str, str]]]]:
    """Code, severity and types of the context of each note() and said() within."""
    _recorders.append([])
    try:
        yield _recorders[-1]
    finally:
        _recorders.pop()


def text(value: Column | str | float | None) -> Column:
    """A context value as text: a column, or a plain value; booleans and numbers as Spark writes them."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def note(
    df: DataFrame,
    code: str,
    severity: str,
    table: str | None,
    context: dict[str, Column | str | float | None] | None = None,
    row: Column | str | None = "_row",
    at: str | Column | None = None,
) -> DataFrame:
    """Notices of one code, one for each row of df. at: the field."""
    if _recorders:
        _recorders[-1].append((code, severity, {k: df.select(v.alias("v")).dtypes[0][1] if isinstance(v, Column) else type(v).__name__ for k, v in (context or {}).items()}))
    pairs = [x for k, v in (context or {}).items() for x in (F.lit(k), text(v))]
    where = F.lit(None).cast("long") if row is None else (F.col(row) if isinstance(row, str) else row).cast("long")
    return df.select(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        F.lit(file_of(table) if table else None).cast("string").alias("filename"),
        where.alias("csv_row"),
        (at if isinstance(at, Column) else F.lit(at)).cast("string").alias("field"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("context"),
    )


def said(feed: Feed, code: str, severity: str, file: str | None, row: int | None = None, at: str | None = None, **context: str | None) -> DataFrame:
    """A single notice that the catalog of the feed alone decides."""
    if _recorders:
        _recorders[-1].append((code, severity, dict.fromkeys(context, "string")))
    return feed.spark.createDataFrame([(code, severity, file, row, at, {k: v for k, v in context.items()})], NOTICE)

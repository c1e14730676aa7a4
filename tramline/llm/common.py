"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.checkpoint import shared_dir
from ..functions.workers import importable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, matched by exact case, so that no other column can clash with an operator's own names."""
    plain, at = positional(df, *names)
    return plain.select(*[F.col(at[n]).alias(n) for n in names])


def positional(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns called _c0, _c1 ..., so that no name can clash with an operator's own, and what the named ones are called."""
    at = {c: f"_c{i}" for i, c in reversed(list(enumerate(df.columns)))}
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))]), {n: at[n] for n in names}


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there: a lost executor's work is read again, not redone."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def on_workers(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(), with this package importable on the workers."""
    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


def written(df: DataFrame, folder: str) -> DataFrame:
    """df written as Parquet to a folder and read again from there."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

"""Exact deduplication by skew-safe combining.

1. Locally, map-side aggregation folds the equal texts of a task into one row.
2. The rows of tasks are merged by (digest, salt, text); the salt comes from the task, so a hot text is merged in many places.
3. The winners of the salts are combined by (digest, text).
4. Rows get their group by (digest, variant), a second hash. That this pair names one text alone is checked in the table of winners; if it
   did not, rows would be joined by the text itself.

The text itself is compared at each of the first three stages, so a digest collision can join nothing. No group is gathered: a group is a
row of the table of winners, and its members are rows of their own throughout.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, partitions, pick, positional

#: A group is hot from 1/HOT_SHARE of all rows; so there are at most HOT_SHARE of them, the bound of the one broadcast.
HOT_SHARE = 1024


def _hashes(norm: Column) -> tuple[Column, Column]:
    return F.unhex(F.sha2(norm, 256)), F.xxhash64(norm)


def _named(rows: DataFrame) -> DataFrame:
    """rows with norm (the text in lower case), digest and variant, from their column `text`."""
    rows = rows.withColumn("norm", ascii_lower(F.coalesce("text", F.lit("")))).drop("text")
    digest, variant = _hashes(F.col("norm"))
    return rows.withColumns({"digest": digest, "variant": variant})


def groups(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """A row per distinct text of docs(doc_id, text) with keep_id and group_size, and the columns that name the text."""
    task = F.pmod(F.spark_partition_id(), F.lit(isqrt(partitions(docs.sparkSession)) + 1)).alias("salt")
    rows = _named(pick(docs, "doc_id", "text")).select("digest", "variant", task, "norm", "doc_id")
    merged = rows.groupBy("digest", "variant", "salt", "norm").agg(F.max("doc_id").alias("top"), F.count("*").alias("n"))
    winners = merged.groupBy("digest", "variant", "norm").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    key = ["digest", "variant"]
    short = cut(winners.drop("norm"))
    if short.groupBy(*key).count().where("count > 1").isEmpty():
        return short, key
    return winners, [*key, "norm"]


def exact_dedup(docs: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest doc_id of a group
    stays (null ids sort below all). Of repeated rows with that same doc_id one is kept. Other columns are ignored;
    an empty table gives an empty result.
    """
    best, key = groups(docs)
    rows = _named(pick(docs, "doc_id", "text")).select("doc_id", *key, F.monotonically_increasing_id().alias("row"))
    rows = cut(rows)  # fixes the numbers of the rows
    # of repeated rows the first one
    first = rows.groupBy(*key).agg(F.max(F.struct("doc_id", -F.col("row"))).alias("first")).select(*key, (-F.col("first")["col2"]).alias("keep_row"))
    best = cut(best.join(first, key))
    hot = F.broadcast(best.where(F.col("group_size") > max(1, rows.count() // hot_share)))
    each = rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(best, key))
    sha = F.sha2("norm", 256) if "norm" in key else F.lower(F.hex("digest"))
    return each.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), sha.alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup() drops: one row of each distinct text stays, of those with the kept doc_id, which
    may be null or stand at other texts too. Columns of any name pass through."""
    best, key = groups(docs)
    own, names = positional(docs, "doc_id", "text")
    marked = _named(own.withColumn("text", F.col(names["text"])))
    same = [*key, "no_id", "id"]
    marked = marked.withColumns({"no_id": F.col(names["doc_id"]).isNull(), "id": F.coalesce(names["doc_id"], F.lit(0))})
    best = best.select(*key, F.col("keep_id").isNull().alias("no_id"), F.coalesce("keep_id", F.lit(0)).alias("id"))
    stays = marked.join(best, same, "left_semi").dropDuplicates(same)  # dealt by the same columns, so in place
    return stays.select(*own.columns).toDF(*docs.columns)

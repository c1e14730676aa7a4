"""Interval joins by buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: Seconds of the smallest bucket, and buckets that one interval is put into, two more at most.
BUCKET, SPREAD = 900, 8


def started_within(spans: DataFrame, by: list[str], start: str, end: str, key: str) -> DataFrame:
    """Pairs of spans with equal `by`, columns _a and _b: b starts at or after a, by the order of `key`, and before a's end.

    An interval is put into the buckets that it touches, of a width that grows with its length, and a start into one bucket of each width that its
    group has. A pair meets in the bucket of b's start alone, so no pair comes twice, and a group with many spans is dealt over as many keys as it
    has buckets."""
    a = spans.where(C(end) > C(start))
    level = F.greatest(F.lit(0), F.ceil(F.log2((C(end) - C(start)) / (BUCKET * SPREAD)))).cast("int")
    a = a.withColumn("level", level)
    width = lambda x: F.lit(BUCKET) * F.pow(F.lit(2.0), x)
    bucket = lambda at: F.floor(at / width(C("level"))).cast("long")
    a = a.withColumn("bucket", F.explode(F.sequence(bucket(C(start)), bucket(C(end) - 1))))
    levels = a.groupBy(*by).agg(F.collect_set("level").alias("levels"))  # a dozen at most
    b = spans.join(levels, by).withColumn("level", F.explode("levels")).withColumn("bucket", bucket(C(start))).drop("levels")
    side = lambda df, s: df.select(*by, "level", "bucket", *[C(c).alias(f"{c}_{s}") for c in spans.columns if c not in by])
    return side(a, "a").join(side(b, "b"), [*by, "level", "bucket"]).where((C(f"{key}_a") < C(f"{key}_b")) & (C(f"{start}_b") < C(f"{end}_a"))).drop("level", "bucket")

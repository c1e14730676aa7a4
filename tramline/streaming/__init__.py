"""An extension: feeds that arrive in a folder, and sessions of an event stream."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch_feeds(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[str], None]) -> StreamingQuery:
    """Call handle(path) once for each zip that appears in folder; the stream's checkpoint remembers which were seen."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.zip").load(folder).select("path")

    def batch(df: DataFrame, _: int) -> None:
        for row in df.toLocalIterator():
            handle(re.sub("^file:/+", "/", row["path"]))

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n of runs of events(ts, user_id) without a gap; works on streams, where later events than `late` are dropped."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

"""Feeds that come again and again: totals of each version, and what changed since the one before, as a stream with state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.workers import importable

TOTALS = "feed string, version timestamp, code string, total long"
CHANGES = "feed string, version timestamp, code string, before long, after long"
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Changes(StatefulProcessor):
    """Holds of each feed the last version and its totals by code; a newer version gives a row for each code whose total is another, and an older one none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version timestamp")
        self.totals = handle.getMapState("totals", "code string", "total long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        held = {k[0]: int(v[0]) for k, v in self.totals.iterator()}
        versions: dict[pd.Timestamp, dict[str, int]] = {}
        for part in rows:
            for version, code, total in zip(part["version"], part["code"], part["total"], strict=True):
                own = versions.setdefault(pd.Timestamp(version), {})
                if code is not None:  # a version without notices has one row without a code
                    own[code] = int(total)
        found, first = [], dict(held)
        for version in sorted(v for v in versions if known is None or v > known):
            now = versions[version]
            found += [(key[0], version, code, held.get(code, 0), now.get(code, 0)) for code in sorted({*held, *now}) if held.get(code, 0) != now.get(code, 0)]
            held, known = now, version
        for code in first.keys() - held.keys():
            self.totals.removeKey((code,))
        for code, total in held.items():
            if first.get(code) != total:
                self.totals.updateValue((code,), (total,))
        if known is not None:
            self.last.update((known.to_pydatetime(),))
        yield pd.DataFrame(found, columns=["feed", "version", "code", "before", "after"])

    def close(self) -> None:
        pass


def changes(totals: DataFrame) -> DataFrame:
    """feed, version, code, before, after of a stream of totals(feed, version, code, total), in which all rows of a version come together. What comes late, with a version
    that is not newer than the last one, changes nothing. The session must keep its state in RocksDB (with_state())."""
    importable(totals.sparkSession)
    return totals.groupBy("feed").transformWithStateInPandas(Changes(), CHANGES, "Update", "None")


def with_state(spark: SparkSession) -> None:
    """Streams started from now on keep their state where values of state can be told apart."""
    spark.conf.set(*STORE)


def append_totals(notices: DataFrame, feed: str, version: dt.datetime, folder: str) -> None:
    """The totals by code of one version of a feed, as one file more of the folder that changes() reads."""
    rows = notices.groupBy("code").agg(F.count("*").alias("total"))
    one = notices.sparkSession.createDataFrame([(feed, version)], "feed string, version timestamp")
    one.join(rows, how="left").coalesce(1).select("feed", "version", "code", "total").write.mode("append").parquet(folder)


def follow(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame], None], once: bool = False) -> StreamingQuery:
    """Call handle(changes) for each batch of totals that appear in folder; state and position live in the checkpoint, so a restart goes on where it was. once: up
    to what is there now, and no further."""
    with_state(spark)
    found = changes(spark.readStream.schema(TOTALS).parquet(folder))
    out = found.writeStream.foreachBatch(lambda df, _: handle(df)).outputMode("update").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()

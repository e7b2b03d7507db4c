"""What changes in a folder, as a stream of its listings: state by path, so a listing costs its rows and nothing is compared twice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Needed for state by key with timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EVENTS = "path string, listing long, change string"


class Listed(StatefulProcessor):
    """A path's last sight: (listing, mtime, size). A timer at the next listing tells that the path was not in it."""

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "listing long, mtime long, size long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sights = sorted({(int(n), int(m), int(s)) for df in rows for n, m, s in zip(df["listing"], df["mtime"], df["size"])})
        last = tuple(self.seen.get()) if self.seen.exists() else None
        found = []
        for listing, mtime, size in sights:
            if last and listing > last[0] + 1:
                found.append((key[0], last[0] + 1, "removed"))
                last = None
            if last is None:
                found.append((key[0], listing, "added"))
            elif last[1:] != (mtime, size):
                found.append((key[0], listing, "changed"))
            last = (listing, mtime, size)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((last[0] + 2) * 1000)
        self.seen.update(last)
        yield pd.DataFrame(found, columns=["path", "listing", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = tuple(self.seen.get())
        self.seen.clear()
        yield pd.DataFrame([(key[0], last[0] + 1, "removed")], columns=["path", "listing", "change"])

    def close(self) -> None:
        pass


def changes(listings: DataFrame) -> DataFrame:
    """path, listing, change (added, changed or removed) of a stream of listings (listing: 0, 1, 2 and so on; path, mtime, size as longs).

    A listing comes whole in one batch, a later one in a later batch or the same. Removal is told once the listing that lacks the path
    is over, by a timer on the listings' own clock. A file that stays as it is makes no row. State goes when a path is removed.
    """
    timed = listings.withColumn("at", F.timestamp_millis((F.col("listing") + 1) * 1000)).withWatermark("at", "0 seconds")
    return timed.groupBy("path").transformWithStateInPandas(statefulProcessor=Listed(), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")


def run_changes(listings: DataFrame, out: str, checkpoint: str) -> None:
    """Takes what is new of a stream of listings into a table of changes; another call with the same checkpoint goes on from there."""
    spark = listings.sparkSession
    before = spark.conf.get(*PROVIDER) if spark.conf.get(PROVIDER[0], None) else None
    spark.conf.set(*PROVIDER)
    try:
        query = changes(listings).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)

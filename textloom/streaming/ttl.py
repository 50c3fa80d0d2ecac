"""Cache entries that expire: one state and one timer a key, over a stream of writes.

A write of a key replaces the entry that the state holds if it is newer, and moves the timer; when the watermark reaches
the end of an entry's time to live the timer fires, the entry comes out, and the key's state goes. State and timers are
in the checkpoint, so a query that is started again goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Expiring(StatefulProcessor):
    """Holds (event_id, cached_at in microseconds) of the newest write of a key; ttl is in milliseconds."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "event_id long, cached_at long")

    def _ends(self, cached_at: int) -> int:
        return cached_at // 1000 + self.ttl

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.newest.get() if self.newest.exists() else None
        best = None if held is None else (held[1], held[0])
        for part in rows:  # in parts of bounded size; only the newest write of each is looked at
            newest = part.sort_values(["cached_us", "event_id"]).iloc[-1]
            best = max(filter(None, (best, (int(newest.cached_us), int(newest.event_id)))))
        if held is None or best != (held[1], held[0]):
            if held is not None:
                self.handle.deleteTimer(self._ends(held[1]))
            self.newest.update((best[1], best[0]))
            self.handle.registerTimer(self._ends(best[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            event_id, cached_at = self.newest.get()
            self.newest.clear()
            yield pd.DataFrame({"url_hash": [key[0]], "event_id": [event_id], "cached_us": [cached_at]})

    def close(self) -> None:
        pass


def expirations(writes: DataFrame, ttl_ms: int, late: str = "1 hour") -> DataFrame:
    """(url_hash, event_id, cached_at) of each entry as it expires; writes are (url_hash, event_id, cached_at) as they arrive.

    Of writes of one time the one of the larger event_id is newer; null keys are a key of their own, and writes without a
    time are left out. Writes later than the watermark are dropped. The session's state store must be able to hold timers, so it is set to STORE.
    """
    writes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    at = F.col("cached_at").cast("timestamp")
    timed = writes.where("cached_at is not null").select("url_hash", F.col("event_id").cast("long").alias("event_id"), at.alias("at"), F.unix_micros(at).alias("cached_us"))
    out = timed.withWatermark("at", late).groupBy("url_hash").transformWithStateInPandas(Expiring(ttl_ms), "url_hash string, event_id long, cached_us long", "append", "eventTime")
    return out.select("url_hash", "event_id", F.timestamp_micros("cached_us").cast("timestamp_ntz").alias("cached_at"))

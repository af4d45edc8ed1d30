"""Sessions of a record log as arbitrary state: merged in any order of arrival, closed by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: The store that keeps this kind of state, on each executor's disk and in the checkpoint.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Sessions(StatefulProcessor):
    """Open sessions of a key: begin, last time, number, sum, and the last record by (time, order).

    A record within ``gap`` of a session joins it, also from before its begin, and may
    join two sessions into one. A session ends, and its row is given out, when
    the watermark has passed its last time by ``gap``, so nothing that is not too late
    can change it any more.
    """

    def __init__(self, key: str, gap: int):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "begins array<long>, lasts array<long>, counts array<long>, totals array<double>, orders array<long>, values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = [list(s) for s in zip(*self.open.get(), strict=True)] if self.open.exists() else []
        fresh = []
        for pdf in rows:
            fresh += [[int(t), int(t), 1, float(v), int(o), float(v)] for t, o, v in zip(pdf["ms"], pdf["order"], pdf["value"], strict=True)]
        merged: list[list] = []
        for s in sorted(known + fresh, key=lambda s: s[0]):
            if merged and s[0] - merged[-1][1] <= self.gap:
                m = merged[-1]
                if (s[1], s[4]) > (m[1], m[4]):
                    m[4], m[5] = s[4], s[5]
                m[1], m[2], m[3] = max(m[1], s[1]), m[2] + s[2], m[3] + s[3]
            else:
                merged.append(list(s))
        self._store(merged)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.open.exists():
            return
        until = timerValues.getCurrentWatermarkInMs()
        known = [list(s) for s in zip(*self.open.get(), strict=True)]
        over = [s for s in known if s[1] + self.gap <= until]
        self._store([s for s in known if s[1] + self.gap > until])
        if over:
            yield pd.DataFrame({self.key: [key[0]] * len(over), **{n: [s[i] for s in over] for i, n in enumerate(("begin_ms", "end_ms", "records", "total", "last_order", "last_value"))}})

    def _store(self, sessions: list[list]) -> None:
        """Keeps sessions, in the order of their times, and a timer for the first to end; a timer that comes too early only sets the next."""
        if sessions:
            self.open.update(tuple([s[i] for s in sessions] for i in range(6)))
            self.handle.registerTimer(sessions[0][1] + self.gap)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def closed_sessions(stream: DataFrame, key: str, time: str, order: str, value: str, gap: str, late: str) -> DataFrame:
    """A stream of closed sessions: key, begin_ms, end_ms, records, total, last_order and last_value.

    ``gap`` and ``late`` are numbers of seconds; records later than ``late`` behind the
    newest are left out. Rows with a null key, time, order or value go. Write it in
    append mode. Sessions that are open at the end stay in the checkpoint's state and are
    closed by a later run.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.where(" and ".join(f"`{n}` is not null" for n in (key, time, order, value))).withWatermark(time, f"{late} seconds")
    plain = rows.selectExpr(f"`{key}`", f"`{time}`", f"unix_millis(`{time}`) as ms", f"cast(`{order}` as bigint) as order", f"cast(`{value}` as double) as value")
    out = f"`{key}` {kind}, begin_ms long, end_ms long, records long, total double, last_order long, last_value double"
    return plain.groupBy(key).transformWithStateInPandas(Sessions(key, int(float(gap) * 1000)), out, "Append", "EventTime")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream in append mode over all that is there now; executors write each batch to a folder of its own, which a repeated batch overwrites."""
    spark = stream.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/_batch={batch}")

    try:
        query = stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    return query

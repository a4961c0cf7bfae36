"""Streaming forms (S) of intake, status and rates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from provlake.plans.session import shared_folder


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(sdf: DataFrame, mode: str = "append", at: str | None = None) -> DataFrame:
    """What a stream gives from the input there is now: written as Parquet, then read.

    at: the stream's folder; a stream that is given the folder of an earlier one goes on where
    that ended. In update mode all rows that were ever given are read.
    """
    spark, at = sdf.sparkSession, at or shared_folder(sdf.sparkSession, "stream")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        if mode == "append":
            query = sdf.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        else:
            query = sdf.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if provider is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    return spark.read.schema(sdf.schema).parquet(f"{at}/out").select(sdf.columns)


def stream_dedup(sdf: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """The first arrival of each key within the lateness bound."""
    return sdf.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_rates(sdf: DataFrame, ts: str, width: str, lateness: str, kind: str, failed: list[str], slide: str | None = None) -> DataFrame:
    """window_start, n, n_failed, rate of each closed window, tumbling or sliding (S3)."""
    out = sdf.withWatermark(ts, lateness).groupBy(F.window(ts, width, slide)).agg(F.count("*").alias("n"), F.count_if(F.col(kind).isin(failed)).alias("n_failed"))
    return out.select(F.col("window.start").alias("window_start"), "n", "n_failed", F.round(F.col("n_failed") / F.col("n"), 6).alias("rate"))


class _Tracker(StatefulProcessor):
    """The latest status of one run, how often each status was seen, and one timer for its silence."""

    def __init__(self, ts: str, status: str, timeout_ms: int, forget_ms: int | None):
        self.ts, self.status, self.timeout_ms, self.forget_ms = ts, status, timeout_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value: each access to state is a round trip between the worker and Spark
        self.last = handle.getValueState("last", "seen_us long, status string, n long, due long, stalled boolean, often map<string,long>")

    def _rows(self, key, rows: list[tuple], kinds: int) -> pd.DataFrame:
        """rows: (last seen in microseconds, status, n, stalled)."""
        n = len(rows)
        seen = pd.to_datetime(pd.Series([r[0] for r in rows], dtype="int64"), unit="us")
        return pd.DataFrame({"key": [key[0]] * n, "status": [r[1] for r in rows], "last_seen": seen, "n": [r[2] for r in rows], "kinds": [kinds] * n, "stalled": [r[3] for r in rows]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        seen, status, n, due, stalled, often = self.last.get() or (None, None, 0, -1, False, {})
        now = []
        for some in rows:
            names = some[self.status]
            now += zip(some[self.ts].to_numpy().astype("datetime64[us]").astype("int64").tolist(), names.where(names.notna(), "").tolist(), strict=True)
        now.sort()
        out = []
        for us, name in now:
            if seen is not None and us - seen > 1000 * self.timeout_ms and not stalled:
                out.append((seen, status, n, True))  # a silence that ended before its timer
            n += 1
            if seen is None or us >= seen:
                seen, status, stalled = us, name, False
        often = dict(often)
        for name, more in Counter(name for _, name in now).items():
            often[name] = often.get(name, 0) + more
        if due >= 0:
            self.handle.deleteTimer(due)
        due = max(seen // 1000 + self.timeout_ms, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(due)
        self.last.update((seen, status, n, due, False, often))
        yield self._rows(key, [*out, (seen, status, n, False)], len(often))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, status, n, _, stalled, often = self.last.get()
        if stalled:  # the second timer: the run is forgotten
            self.last.clear()
            return
        due = -1
        if self.forget_ms is not None:
            due = max(seen // 1000 + self.forget_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
        self.last.update((seen, status, n, due, True, often))
        yield self._rows(key, [(seen, status, n, True)], len(often))

    def close(self) -> None:
        pass


def run_tracker(sdf: DataFrame, key: str, ts: str, status: str, timeout_ms: int, lateness: str = "1 minute", forget_ms: int | None = None) -> DataFrame:
    """key, status, last_seen, n, kinds, stalled: the latest status of each run when rows come, and one more row for each silence beyond the timeout.

    kinds counts the different statuses seen; a null status is ''. A silence gives its row
    when the watermark passes its end or, if rows came before that, with these; one row
    whatever the batches, restarts included. State lies in RocksDB (see drained); runs
    silent for forget_ms are forgotten. A run's rows of one batch are sorted in memory: the
    source's limits a batch bound them.
    """
    kind = sdf.schema[key].dataType.simpleString()
    rows = sdf.select(key, ts, status).withWatermark(ts, lateness)
    return rows.groupBy(key).transformWithStateInPandas(_Tracker(ts, status, timeout_ms, forget_ms), f"key {kind}, status string, last_seen timestamp, n long, kinds long, stalled boolean", "Update", "EventTime")


def fetched(hits: DataFrame, answers: DataFrame, key: str, within: str, hit_late: str, answer_late: str) -> DataFrame:
    """Each hit with its answer, or without one once none can come any more (E5 as a stream).

    hits(key, hit_ts, ...), answers(key, answer_ts, ...): an answer counts if it comes not
    before its hit and within the interval after it. The watermarks bound what is held; a hit
    whose interval has passed by both of them leaves with nulls. Of several answers each
    makes a row.
    """
    asked = hits.withWatermark("hit_ts", hit_late)
    given = answers.withColumnRenamed(key, "__key").withWatermark("answer_ts", answer_late)
    timely = F.expr(f"{key} = __key AND answer_ts >= hit_ts AND answer_ts <= hit_ts + INTERVAL {within}")
    return asked.join(given, timely, "leftOuter").drop("__key")

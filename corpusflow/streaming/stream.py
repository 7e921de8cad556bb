"""Structured Streaming: incremental upserts, anchored request limits, tumbling counts, duplicate deliveries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..sources.store import Collection


def upsert_stream(pages: DataFrame, transform: Callable[[DataFrame], DataFrame], collection: Collection, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Each micro-batch is transformed and upserted. A batch that is delivered again after a failure changes nothing: every
    publication carries the last batch of each stream, named by its checkpoint, that it holds, and a batch that the current
    one holds is skipped. After a restore it holds fewer, so what was rolled back can be delivered again."""

    def put(batch: DataFrame, number: int) -> None:
        last = collection.current()
        if last is None or (last["streams"] or {}).get(checkpoint, -1) < number:
            collection.upsert(transform(batch), f"stream {checkpoint} batch {number}", "", order, (checkpoint, number))

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decisions(times: list[float], count: int, start: float, seconds: float, most: int) -> tuple[list[bool], int, float]:
    """Fixed windows anchored at a client's first request: verdicts, and the state after them."""
    out = []
    for t in times:
        if count == 0 or t - start >= seconds:
            count, start = 0, t
        count += 1
        out.append(count <= most)
    return out, count, start


LIMITED = "client long, at timestamp, allowed boolean"
MICROS = 1_000_000


def decided(times: np.ndarray, count: int, start: int, length: int, most: int) -> tuple[np.ndarray, int, int]:
    """``decisions`` for sorted times in microseconds, window by window instead of request by request."""
    allowed, at = np.zeros(len(times), bool), 0
    while at < len(times):
        if count == 0 or times[at] - start >= length:
            count, start = 0, int(times[at])
        stop = int(np.searchsorted(times, start + length, "left"))
        allowed[at : at + max(0, most - count)] = True
        allowed[stop:] = False
        count += stop - at
        at = stop
    return allowed, count, start


class Limiter(StatefulProcessor):
    """A client's window: how many requests it has seen, and its start in microseconds; dropped by a timer after its end."""

    def __init__(self, seconds: int, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "count long, start long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # Of a client's rows only their times are held, eight bytes each, and put in order.
        times = np.concatenate([frame["at"].to_numpy().astype("datetime64[us]").astype(np.int64) for frame in rows])
        times.sort()
        count, start = self.window.get() if self.window.exists() else (0, 0)
        allowed, count, new_start = decided(times, int(count), int(start), self.seconds * MICROS, self.most)
        self.window.update((count, new_start))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer((new_start + self.seconds * MICROS) // 1000 + 1)
        for i in range(0, len(times), CHUNK):
            at = pd.Series(times[i : i + CHUNK].astype("datetime64[us]")).dt.tz_localize("UTC")
            yield pd.DataFrame({"client": key[0], "at": at, "allowed": allowed[i : i + CHUNK]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


CHUNK = 10_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def limit_stream(requests: DataFrame, seconds: int = 60, most: int = 100) -> DataFrame:
    """(client, at) -> with ``allowed``, as ``limit_batch`` gives it where batches follow one another in time; a request later
    than the watermark, one window behind, is dropped. State is kept in RocksDB, which the session is set to: one count and
    one window start a client, until the watermark passes the window's end, when a new request starts a new window anyway."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    slim = requests.select("client", "at").withWatermark("at", f"{seconds} seconds")
    return slim.groupBy("client").transformWithStateInPandas(Limiter(seconds, most), LIMITED, "Append", "EventTime")


def limit_batch(requests: DataFrame, seconds: int = 60, most: int = 100) -> DataFrame:
    """The same verdicts for a table of (client, at). A client's requests are sorted by Spark and read as a stream of
    Arrow batches; only its counter is held, so a busy client does not have to fit in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, count, start = None, 0, 0.0
        for batch in batches:
            out = []
            for c, t in zip(batch["client"], batch["seconds"], strict=True):
                if c != client:
                    client, count, start = c, 0, 0.0
                (ok,), count, start = decisions([t], count, start, seconds, most)
                out.append(ok)
            yield batch[["client", "at"]].assign(allowed=out)

    rows = requests.select("client", "at", (F.unix_micros("at") / 1_000_000).alias("seconds"))
    return rows.repartition("client").sortWithinPartitions("client", "at").mapInPandas(run, LIMITED)


def counts_per_window(requests: DataFrame, client: str, at: str, window: str = "60 seconds", late: str | None = "10 minutes") -> DataFrame:
    """Requests a client and tumbling window; for streams rows later than ``late`` are dropped. Works for tables too."""
    rows = requests.withWatermark(at, late) if requests.isStreaming and late else requests
    return rows.groupBy(client, F.window(at, window).alias("w")).agg(F.count("*").alias("requests")).select(client, F.col("w.start").alias("window_start"), "requests")


def deduplicated(pages: DataFrame, keys: list[str], at: str, within: str = "1 hour") -> DataFrame:
    """One delivery of each key; for streams within the watermark."""
    if pages.isStreaming:
        return pages.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)
    return pages.dropDuplicates(keys)

"""Keyed state of a stream in Spark's state store: the open bar and the bounded history of each instrument.

The result is a stream itself, so another stream can go on from it; a restart finds the state where the last batch left
it, and a key that has been silent for long enough leaves the store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: State of this size needs a store beside the heap.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BARS = (
    "inst_id string, bar_time timestamp, open double, high double, low double, close double, volume double, tick_count long, completed_by long, "
    "bars_held long, mean_close double, top_close double, bottom_close double"
)


#: Ticks whose values are Python objects at once.
SLICE = 1 << 16


def _columns(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """seq, and ms, last and volume_24h, of all rows: numbers alone, so that the batches they came in can go."""
    parts = {c: [] for c in ("seq", "ms", "last", "volume_24h")}
    for batch in rows:
        for c, held in parts.items():
            held.append(batch[c].to_numpy(copy=True))
    joined = {c: np.concatenate(parts.pop(c)) for c in list(parts)}
    return joined.pop("seq"), joined


class ArrivalBars(StatefulProcessor):
    """Bars that the first tick of another minute ends, each with what the instrument's last bars tell.

    State of a key: the open bar (one value), the closes of its last `history` bars (a list), and a timer that clears both
    when the watermark has passed the key's latest tick by `idle` seconds. The ticks of a key in one batch are sorted in one task, as four
    columns of numbers (some 50 bytes a tick); a source without end has to bound a batch (maxFilesPerTrigger, maxOffsetsPerTrigger).
    Bars go out after every SLICE ticks.
    """

    def __init__(self, every_seconds: int, history: int, length: int, idle_seconds: int) -> None:
        self.every, self.history, self.length, self.idle = every_seconds, history, length, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", "at long, open double, high double, low double, close double, volume double, n long")
        self.closes = handle.getListState("closes", "close double")
        self.latest = handle.getValueState("latest", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seqs, held = _columns(rows)
        order = np.argsort(seqs, kind="stable")
        bar = self.bar.get() if self.bar.exists() else None
        closes = [c for (c,) in self.closes.get()] if self.closes.exists() else []
        known, added = len(closes), 0
        names = [f.split()[0] for f in BARS.split(", ")]
        for start in range(0, len(order), SLICE):
            here, out = order[start : start + SLICE], []
            for ms, seq, last, volume in zip(*[c[here].tolist() for c in (held["ms"], seqs, held["last"], held["volume_24h"])], strict=True):
                at = ms // (self.every * 1000)
                if bar is not None and bar[0] == at:
                    bar = (at, bar[1], max(bar[2], last), min(bar[3], last), last, volume, bar[6] + 1)
                    continue
                if bar is not None:
                    closes = [*closes, bar[4]][-self.history :]
                    added += 1
                    recent = closes[-self.length :]
                    out.append((key[0], pd.Timestamp(bar[0] * self.every, unit="s"), *bar[1:], seq, len(closes), sum(recent) / len(recent), max(closes), min(closes)))
                bar = (at, last, last, last, last, volume, 1)
            if out:
                yield pd.DataFrame(out, columns=names)
        self.bar.update(bar)
        if added:
            if added < known and known + added <= self.history:
                self.closes.appendList([(c,) for c in closes[-added:]])
            else:
                self.closes.put([(c,) for c in closes])
        self._watch(max([int(held["ms"].max()), *self._latest()]))

    def _latest(self) -> list[int]:
        return [self.latest.get()[0]] if self.latest.exists() else []

    def _watch(self, ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.latest.update((ms,))
        self.handle.registerTimer(ms + self.idle * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bar.clear()
        self.closes.clear()
        self.latest.clear()
        yield pd.DataFrame(columns=[f.split()[0] for f in BARS.split(", ")])

    def close(self) -> None:
        pass


def with_store(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB, which keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def stream_arrival_bars(ticks: DataFrame, every_seconds: int = 60, history: int = 500, length: int = 20, lateness: str = "1 day", idle_seconds: int = 7 * 86_400) -> DataFrame:
    """The stream form of bars.arrival_bars and bars.held_history: a stream of BARS, appended when a bar ends.

    ticks: a stream of inst_id, ts, seq, last, volume_24h. A tick later than `lateness` is dropped. A key is forgotten `idle_seconds` after
    its latest tick, as the watermark counts; its next tick then opens a first bar.
    """
    with_store(ticks.sparkSession)
    ms = F.floor(F.unix_micros("ts") / 1000).cast("long")
    rows = ticks.where("ts is not null").select("inst_id", F.col("ts").cast("timestamp").alias("ts"), "seq", F.col("last").cast("double").alias("last"), F.col("volume_24h").cast("double").alias("volume_24h"))
    rows = rows.withWatermark("ts", lateness).withColumn("ms", ms)
    processor = ArrivalBars(every_seconds, history, length, idle_seconds)
    return rows.groupBy("inst_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=StructType.fromDDL(BARS), outputMode="Append", timeMode="EventTime")

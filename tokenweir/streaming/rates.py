"""Rolling rates on a running stream of counter samples (run, seq, t, total), one state for each run.

The state is a queue of the samples that the window still reaches, oldest first, so it is bounded by the samples of a window. The
rate of a sample is that since the oldest sample in its window, at least since the one before; a counter that falls starts anew.
A sample that comes after a later one of its run, in ``seq`` or in time, is late: it is given out with ``late`` set and without a
rate, and changes nothing. With ``keep_ms`` a run of which event time has seen nothing for so long is forgotten by a timer.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "run long, seq long, t long, total double, elapsed double, rate double, late boolean"
STATE = "seqs array<long>, ts array<long>, totals array<double>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rated(samples: deque, rows: Iterator[tuple[int, int, float]], window_ms: int) -> Iterator[tuple]:
    """A row for each sample in turn; ``samples`` is what is in the window, and is changed."""
    for seq, t, total in rows:
        last = samples[-1] if samples else None
        if last and (seq <= last[0] or t < last[1]):
            yield seq, t, total, None, None, True
            continue
        if last and total < last[2]:
            samples.clear()
            last = None
        while samples and samples[0][1] < t - window_ms:
            samples.popleft()
        first = samples[0] if samples else last or (seq, t, total)
        samples.append((seq, t, total))
        elapsed = (t - first[1]) / 1000.0
        yield seq, t, total, elapsed, max(0.0, (total - first[2]) / elapsed) if elapsed > 0 else 0.0, False


class RateProcessor(StatefulProcessor):
    def __init__(self, window_ms: int, keep_ms: int | None = None) -> None:
        self.window_ms, self.keep_ms = window_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getValueState("samples", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.samples.get() if self.samples.exists() else None
        samples = deque(zip(*held, strict=True)) if held else deque()
        own = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = list(rated(samples, zip(own["seq"].tolist(), own["t"].tolist(), own["total"].tolist(), strict=True), self.window_ms))
        seqs, ts, totals = map(list, zip(*samples, strict=True))
        self.samples.update((seqs, ts, totals))
        if self.keep_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ts[-1] + self.keep_ms)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["run", "seq", "t", "total", "elapsed", "rate", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.samples.clear()
        yield from ()

    def close(self) -> None:
        pass


def rolling_rate(samples: DataFrame, window_ms: int = 30_000, keep_ms: int | None = None, late: str = "1 minute") -> DataFrame:
    """``samples``: a stream of run, seq, t (milliseconds) and total. The session's state store must be of RocksDB."""
    if window_ms <= 0:
        raise ValueError("window must be greater than zero")
    if keep_ms is not None and keep_ms < window_ms:
        raise ValueError("a run must be kept for its window at least")
    own = samples.select("run", "seq", "t", F.col("total").cast("double").alias("total"))
    if keep_ms is not None:
        own = own.withColumn("at", F.timestamp_millis("t")).withWatermark("at", late)
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own.groupBy("run").transformWithStateInPandas(RateProcessor(window_ms, keep_ms), SCHEMA, "Append", "None" if keep_ms is None else "EventTime")

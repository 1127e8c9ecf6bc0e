"""Reports, metric logs and progress of runs, in any store that Spark writes to."""

from __future__ import annotations

import json
import uuid
from collections import deque
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def write_report(spark: SparkSession, path: str, value: object) -> None:
    """A report as JSON, whole or not at all: written beside, then renamed over what was there. What JSON cannot hold is text."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(to.getParent(), f".{to.getName()}.{uuid.uuid4().hex}.tmp")
    out = to.getFileSystem(conf).create(beside, True)
    try:
        out.write(json.dumps(value, indent=2, default=str).encode())
    finally:
        out.close()
    options = jvm.org.apache.hadoop.fs.Options
    over = spark.sparkContext._gateway.new_array(options.Rename, 1)
    over[0] = options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(beside, to, over)


def evaluation_results(results: dict) -> dict:
    """What of an evaluation is kept: the tasks' metrics alone."""
    return results.get("results", {})


def log_metrics(stream: DataFrame, folder: str, checkpoint: str, by: list[str]) -> StreamingQuery:
    """Append a stream of metric rows to a JSON log, once each, in a folder for each run and metric; ends with what there is."""
    return stream.writeStream.format("json").partitionBy(*by).option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


class Progress(StreamingQueryListener):
    """The rows and rates of the last ``kept`` micro-batches of all queries of a session; ``spark.streams.addListener`` takes it."""

    def __init__(self, kept: int = 100) -> None:
        self.seen: deque[tuple[str, int, int, float]] = deque(maxlen=kept)
        self.ended: deque[str] = deque(maxlen=kept)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.seen.append((str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.id))


def run_identity(state: dict | None, kind: str, mode: str, now: datetime) -> dict:
    """How a run is named in a registry of runs: one that continues must be the run that the state names; else it gets a new name,
    and a fresh one never resumes."""
    state = state or {}
    if mode == "continue" and state.get("run_id"):
        return {"id": state["run_id"], "resume": "must"} | ({"name": state["run_name"]} if state.get("run_name") else {})
    return {"name": f"{now:%Y%m%d-%H%M%S}-{kind}", "resume": "never" if mode == "fresh" else "allow"}

"""Incremental packing: a file stream of documents becomes full shards, with exact resume.

Each micro-batch is tokenized, put behind the tokens that were pending, and cut into full shards; the rest is pending
again. Order of a commit: shard files, their descriptions, pending tokens, state, then the pending table before is
dropped. The state names the last batch, so a batch that is run again after a crash writes the same files or nothing.
"""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chat, packing, validation
from ..session import materialise, scope
from ..sources import token_shards


class PackingSink:
    """``foreachBatch`` target. ``ids``: a column of token ids from a text column; ``config``: what a resume must find unchanged."""

    #: Token arrays that are cut in lock-step, and how the set's files begin.
    columns: tuple[str, ...] = ("tokens",)
    prefix = "shard"

    def __init__(self, folder: str, size: int, ids: Callable[[Column], Column], eos: int | None, max_shards: int | None = None, config: dict | None = None) -> None:
        self.root = token_shards.local(folder)
        self.root.mkdir(parents=True, exist_ok=True)
        self.size, self.ids, self.eos, self.max_shards = size, ids, eos, max_shards
        self.config = {"shard_size_tokens": size, "max_shards": max_shards, **(config or {})}
        state = self.state()
        validation.check_state(state, self.config, any(self.root.glob(f"{self.prefix}_*.bin")), state and self._pending_size(state))

    def state(self) -> dict | None:
        path = self.root / "state.json"
        return json.loads(path.read_text()) if path.exists() else None

    def _pending_size(self, state: dict) -> int | None:
        return state["pending_tokens"] if (self.root / state["pending"]).exists() or not state["pending_tokens"] else None

    def rows(self, batch: DataFrame) -> DataFrame:
        """(key, and the token arrays) of a batch."""
        return batch.select(F.col("doc_id").alias("key"), F.concat(self.ids(F.col("text")), F.array(F.lit(self.eos))).alias("tokens"))

    def _pending(self, spark: SparkSession, state: dict) -> DataFrame:
        """The rows that are pending, which must be as many tokens as the state says, in every column."""
        found = spark.read.parquet(str(self.root / state["pending"]))
        sizes = found.agg(*[F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(c) for c in self.columns]).first()
        if set(sizes) != {state["pending_tokens"]}:
            raise ValueError(f"pending tokens are {list(sizes)} and not {state['pending_tokens']}")
        return found.select(F.lit(0).alias("source"), F.col("at").alias("key"), *self.columns)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        token_shards.register(spark)
        state = self.state() or {**self.config, "schema_version": validation.STATE_VERSION, "batch": -1, "next_shard": 0, "committed_tokens": 0, "pending_tokens": 0, "pending": "", "source_documents_consumed": 0}
        if batch_id <= state["batch"] or validation.is_complete(state):
            return
        rows = self.rows(batch).select(F.lit(1).alias("source"), "key", *self.columns)
        if state["pending_tokens"]:
            # pending rows stand by their place before all documents
            rows = self._pending(spark, state).unionByName(rows)
        with scope(spark):
            rows = materialise(rows, "batch")
            placed = packing.prefix_sum(rows.withColumns({"n": F.size(self.columns[0]).cast("long"), "__tie": F.xxhash64(*self.columns)}), ["source", "key", "__tie"], "n")
            cut = packing.pieces(placed, {c: F.col(c) for c in self.columns}, self.size)
            totals = placed.agg(F.coalesce(F.max("end"), F.lit(0)).alias("t"), F.coalesce(F.sum("source"), F.lit(0)).alias("d")).first()
            full = totals["t"] // self.size
            if self.max_shards is not None:
                full = min(full, self.max_shards - state["next_shard"])
            first = state["next_shard"]
            named = dict(zip(self.columns, ("tokens", "targets"), strict=False))
            if full:
                shards = cut.where(F.col("shard") < full).select((F.col("shard") + first).cast("int").alias("shard"), "first", *[F.col(c).alias(x) for c, x in named.items()])
                packing.by_shard(shards).write.format("token_shards").option("path", str(self.root)).option("prefix", self.prefix).mode("append").save()
            left = totals["t"] - full * self.size
            pending = f"pending-{batch_id:08d}.parquet"
            if left:
                at = (F.col("shard") - full) * self.size + F.col("first")
                cut.where(F.col("shard") >= full).select(at.cast("long").alias("at"), *self.columns).write.mode("overwrite").parquet(str(self.root / pending))
        before = state["pending"]
        state |= {"batch": batch_id, "next_shard": first + full, "committed_tokens": state["committed_tokens"] + full * self.size, "pending_tokens": left, "pending": pending if left else "", "source_documents_consumed": state["source_documents_consumed"] + totals["d"]}
        token_shards.write_json(self.root / "state.json", state)
        if before and before != state["pending"]:
            shutil.rmtree(self.root / before, ignore_errors=True)


class PairedSink(PackingSink):
    """The same of conversations (conv_id, messages): inputs and targets in lock-step, as paired shards. ``encode``: both columns of
    the messages', where there is a faster way to them than by ``ids``."""

    columns = ("inputs", "targets")
    prefix = "chat"

    def __init__(self, folder: str, size: int, ids: Callable[[Column], Column], max_shards: int | None = None, config: dict | None = None, encode: Callable[[Column], tuple[Column, Column]] | None = None) -> None:
        super().__init__(folder, size, ids, None, max_shards, config)
        self.encode = encode or (lambda messages: chat.encode(messages, ids))

    def rows(self, batch: DataFrame) -> DataFrame:
        inputs, targets = self.encode(F.col("messages"))
        return batch.select(F.col("conv_id").alias("key"), inputs.alias("inputs"), targets.alias("targets"))


def ingest(spark: SparkSession, source: str, schema: str, sink: PackingSink, checkpoint: str, files_per_batch: int = 4) -> dict | None:
    """Read what is new in ``source`` (Parquet) and return the state after it."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return sink.state()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in event-time windows, with a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

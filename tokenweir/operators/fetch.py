"""Windows of tokens out of shard files, in the order of a shuffle or any other.

What is shuffled are indices: each is located in its shard, and the indices of a stretch of a file meet in one task, which maps
the stretch once and cuts its windows in the order of the file. A row keeps its rank and batch, so that the order is put back by
them wherever it is needed; token arrays are made last and do not move.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import token_shards
from . import packing

#: Tokens of a batch of windows that leaves a task at most.
CUT = 1 << 20
#: Files whose names and sizes are broadcast at most; more are joined as Spark sees fit.
FEW = 1 << 16


def windows_of(spark: SparkSession, folder: str, length: int, step: int | None = None, paired: bool = False) -> DataFrame:
    """(shard, path, windows, first_window, end_window): a row for each file."""
    files = token_shards.discover(folder, paired)
    width = np.dtype(token_shards.IDS).itemsize
    rows = [(token_shards.shard_index(p, k), str(p), os.path.getsize(p) // width) for k, p in enumerate(files)]
    sized = spark.createDataFrame(rows, "shard long, path string, tokens long")
    return packing.window_offsets(sized.select("shard", "path", packing.window_count(F.col("tokens"), length, step).alias("windows")))


def _cut(length: int, step: int, paired: bool) -> Callable:
    def windows(path: str, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = int(local[0]) * step, int(local[-1]) * step + length + 1
        places = (local * step - low)[:, None] + np.arange(length)
        ids = token_shards._mapped(path, token_shards.IDS, low, high)
        aims = token_shards._mapped(token_shards.targets_of(path), token_shards.TARGETS, low, high) if paired else ids
        return ids[places].astype(np.int32), aims[places + 1].astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, local = batch.column("path").dictionary_encode(), batch.column("local").to_numpy()
            codes = paths.indices.to_numpy()
            ends = [*(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)] if len(codes) else []
            first = 0
            for end in ends:
                path = paths.dictionary[int(codes[first])].as_py()
                for at in range(first, end, max(1, CUT // length)):
                    to = min(end, at + max(1, CUT // length))
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (to - at + 1) * length, length, dtype=np.int32)), pa.array(v.reshape(-1))) for v in windows(path, local[at:to])]
                    kept = [c for c in batch.schema.names if c not in ("path", "local")]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, to - at) for c in kept), *lists], [*kept, "x", "y"])
                first = end

    return run


def fetch(wanted: DataFrame, folder: str, length: int, step: int | None = None, paired: bool = False) -> DataFrame:
    """``wanted`` (idx, and what else: batch, rank) with x and y, the window of each index and the same a token on; y is of the
    targets if there are any. An index out of range is an error; a repeated one gives a row each time."""
    spark, step = wanted.sparkSession, step or length
    files = windows_of(spark, folder, length, step, paired)
    names = files.select("shard", "path")
    names = F.broadcast(names) if files.count() <= FEW else names
    located = packing.locate(wanted, files.select("shard", "windows", "first_window", "end_window")).join(names, "shard")
    # a large file is several tasks' work, each with a stretch of its own
    stretch = F.floor(F.col("local") * step * np.dtype(token_shards.IDS).itemsize / token_shards.PARTITION_BYTES)
    dealt = located.repartition("path", stretch).sortWithinPartitions("path", "local")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return dealt.select(*wanted.columns, "path", "local").mapInArrow(_cut(length, step, paired), f"{kinds}, x array<int>, y array<int>")

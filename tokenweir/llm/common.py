"""Shared parts of the training-data operators: intermediate tables, Arrow text buffers, hashed words."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import adopt, bound_batches, collecting, drop, materialise, scratch  # noqa: F401

#: Bytes of text that a Python task works on at once; a single longer text is taken whole.
CHUNK_BYTES = 2 << 20
Batches = Iterator[pa.RecordBatch]
_MASK = (1 << 64) - 1


def released(f: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A step in Python whose worker gives memory back when its task ends: workers wait for more tasks, for a minute at least, and what
    they have freed but hold counts beside the JVM in an executor's memory."""

    @functools.wraps(f)
    def run(batches: Batches) -> Batches:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def release() -> None:
    """What this process has freed goes back to the system, and so do the powers of the hash base."""
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # of the C library, which numpy's arrays are from


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone, whatever the other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Rows of a few numbers that are broadcast at most.
SMALL_ROWS = 1 << 19


def small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, broadcast if its rows have been counted and are few; else Spark joins as it sees fit."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def once(column: Column) -> Column:
    """A value that is not written out again where it is used, as the optimizer takes it for no pure function of the row."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


#: Bits of a sieve, whatever the number of its ids: the bitmap that is broadcast has 512 KB.
BITS = 1 << 22


def _bit(d: Column) -> Column:
    return F.pmod(F.xxhash64(d), F.lit(BITS))


def quoted(name: str) -> Column:
    """The column of this very name, whatever stands in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def sieved(docs: DataFrame, ids: DataFrame, key: Column | None = None) -> DataFrame:
    """``docs`` with ``__may``: false only if doc_id (or ``key``) is not among ``ids`` (d). The sieve is a bitmap of BITS bits, whatever the
    number of ids; a full one lets all documents through to the join that follows."""
    part, at = F.floor(_bit(F.col("d")) / 32768), _bit(F.col("d")) % 32768
    maps = ids.select(part.alias("__part"), at.alias("at")).groupBy("__part").agg(F.bitmap_construct_agg("at").alias("__map"))
    own = _bit(F.col("doc_id") if key is None else key)
    byte = F.conv(F.hex(F.call_function("substring", F.col("__map"), (F.floor((own % 32768) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.col("__map").isNotNull() & (F.floor(byte / F.pow(F.lit(2.0), own % 8)) % 2 == 1)
    return docs.withColumn("__part", F.floor(own / 32768)).join(F.broadcast(maps), "__part", "left").withColumn("__may", F.coalesce(may, F.lit(False))).drop("__part", "__map")


def text_views(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes: (first row, end row, UTF-8 bytes, row offsets from 0). Null reads as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


#: Bytes of a text that are taken at once where it can be cut.
PIECE = 4 << 20


def pieces(data: bytes, edge: re.Pattern) -> Iterator[bytes]:
    """A long text in pieces that end before a byte which is no part of a word (``edge``), so that no word is cut."""
    at = 0
    while len(data) - at > PIECE:
        m = edge.search(data, at + PIECE)
        if m is None:
            break
        yield data[at : m.start()]
        at = m.start()
    yield data[at:] if at else data


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20_240_607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_VALUE = _byte_values()
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, grown by doubling."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.empty(size, np.uint64)
            out[0] = 1
            have = 1
            while have < size:
                step = np.uint64(pow(base, have, 1 << 64))
                np.multiply(out[: min(have, size - have)], step, out=out[have : min(2 * have, size)])
                have *= 2
            _POWERS[at] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes inside a word, after lower-casing: all but space, tab and the four line characters; letters, digits and all beyond ASCII.
PLAIN_WORD = np.ones(256, bool)
PLAIN_WORD[[32, 9, 10, 11, 12, 13]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and 64-bit hashes of the words of all texts of a run, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    low = _LOWER[data] if lower else data
    mask = np.zeros(len(low) + 1, bool)
    mask[:-1] = inside[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(low) + 1, bool)
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | cut))
    ends = np.flatnonzero(before & (~mask | cut))
    up, down = _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_VALUE[low] * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, hashes


def int64(x: np.ndarray) -> np.ndarray:
    """The same bits as signed values, as Spark's LongType holds them."""
    return x.view(np.int64)

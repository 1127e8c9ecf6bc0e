"""Splits, shuffles, batches and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import prefix_sum


def shard_split(shards: DataFrame, ratio: float = 0.95) -> DataFrame:
    """The first min(n - 1, max(1, round half even)) shards train, the rest are for development."""
    n = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy("shard"))
    train = F.least(n - 1, F.greatest(F.lit(1), F.bround(F.lit(ratio) * n).cast("long")))
    return shards.withColumn("split", F.when(rank <= train, "train").otherwise("dev"))


def window_split(count: int, length: int, step: int, ratio: float = 0.95) -> tuple[int, int]:
    """(windows that train, first window for development) of a single shard: windows that overlap both sides are dropped."""
    train = int(ratio * count)
    return train, min(count, train + -(-length // step))


def tail_split(shards: DataFrame, ratio: float) -> DataFrame:
    """The last max(1, int(n * ratio)) shards are for development."""
    n = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("shard")))
    return shards.withColumn("split", F.when(rank <= F.greatest(F.lit(1), F.floor(n * F.lit(ratio))), "dev").otherwise("train"))


def hashed(seed: Column | int, index: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed) if isinstance(seed, int) else seed, index))


def ranked(rows: DataFrame, column: str, seed: int) -> DataFrame:
    """Adds the ``rank`` from 0 in the order of a seeded hash of the column: ranges of hashes are counted, then ranked within."""
    one = rows.withColumns({"__hash": hashed(seed, F.col(column)), "__one": F.lit(1).cast("long")})
    return prefix_sum(one, ["__hash", column], "__one", "rank", "__to").drop("__hash", "__one", "__to")


def random_split(windows: DataFrame, dev: int, seed: int = 42) -> DataFrame:
    """``dev`` windows chosen by a seeded hash."""
    return ranked(windows, "window", seed).withColumn("split", F.when(F.col("rank") < dev, "dev").otherwise("train")).drop("rank")


def check_split(train: int, dev: int) -> None:
    """Both sides of a split must hold a window."""
    if not train or not dev:
        raise ValueError("too little data for a split that shares no token: two shards or a longer file are needed")


def check_accumulation(batches_per_epoch: int, accumulation: int) -> None:
    """Exact resume needs epochs of whole steps."""
    if accumulation < 1 or batches_per_epoch % accumulation:
        raise ValueError("batches of an epoch must be divisible by the accumulation steps")


def epoch_order(indices: DataFrame, seed: int, epoch: int) -> DataFrame:
    """(idx, rank): a permutation for each epoch, from hashes; ids move, token arrays do not."""
    if epoch < 0:
        raise ValueError("epoch must not be negative")
    return ranked(indices.select("idx"), "idx", seed + epoch)


def exact_order(spark, count: int, seed: int, epoch: int) -> DataFrame:
    """The same from NumPy's generator, bit for bit. Its shuffle is one sequence of draws, so one task makes it, with 8 bytes for
    each index; ``epoch_order`` is for more."""
    import numpy as np
    import pyarrow as pa

    if epoch < 0:
        raise ValueError("epoch must not be negative")

    def run(batches):
        for _ in batches:
            pass
        order = np.arange(count, dtype=np.int64)
        np.random.default_rng(seed + epoch).shuffle(order)
        for at in range(0, count, 1 << 16):
            own = order[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.arange(at, at + len(own), dtype=np.int64))], ["idx", "rank"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "idx long, rank long")


def batches(ranked: DataFrame, size: int, drop_last: bool) -> DataFrame:
    """batch of each rank; training drops a last batch that is not full."""
    out = ranked.withColumn("batch", F.floor(F.col("rank") / size))
    if drop_last:
        full = ranked.agg(F.floor(F.count("*") / size).alias("__full"))
        out = out.crossJoin(F.broadcast(full)).where(F.col("batch") < F.col("__full")).drop("__full")
    return out


def data_position(step: Column, accumulation: int, per_epoch: int) -> tuple[Column, Column]:
    """(epoch, first batch) at which a run goes on."""
    used = step * accumulation
    return F.floor(used / per_epoch).cast("long"), (used % per_epoch).cast("long")


def dev_cursor(evals: DataFrame, take: int, total: int) -> DataFrame:
    """(eval, slot, batch): each evaluation takes the next ``take`` batches, round and round."""
    m = min(take, total)
    return evals.select("eval", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("slot")).withColumn("batch", F.pmod(F.col("eval") * m + F.col("slot"), F.lit(total)))

"""Metric streams: rates, intervals, carried values, summaries. Each stream is partitioned by its run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_finite


#: Samples of a task, about: it sorts them, and holds what it sorts.
TASK_ROWS = 250_000


def dealt(samples: DataFrame, run: str, rows: int) -> DataFrame:
    """Runs dealt out to tasks whose number grows with the ``rows`` of all, so that what one sorts does not; at least as many as a
    shuffle of the session has."""
    return samples.repartition(max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), run)


def rolling_rate(samples: DataFrame, run: str, seq: str, t_ms: str, total: str, window_ms: int = 30_000) -> DataFrame:
    """Adds rate and elapsed: units a second since the oldest sample of the window, at least the one before; a counter that falls starts anew.
    All stays with the partitions of the runs, if ``samples`` has such (``dealt``)."""
    if window_ms <= 0:
        raise ValueError("window must be greater than zero")
    order = Window.partitionBy(run).orderBy(seq)
    fell = F.when(F.col(total) < F.lag(total).over(order), 1).otherwise(0)
    cut = samples.withColumn("__segment", F.sum(fell).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sample = F.struct(F.col(seq).alias("seq"), F.col(t_ms).alias("t"), F.col(total).alias("u"))
    cut = cut.withColumn("__sample", sample).withColumn("__before", F.lag(sample).over(Window.partitionBy(run, "__segment").orderBy(seq)))
    # a window of w reaches over the end of one bucket of w and the front of the next: the least sample of each comes from one pass
    # over the bucket, so that the work does not grow with the samples of a window
    bucket, names = F.floor(F.col(t_ms) / window_ms), samples.columns
    front = Window.partitionBy(run, "__segment", "__bucket").orderBy(t_ms).rangeBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("__bucket", bucket).withColumn("__front", F.min("__sample").over(front))
    back = Window.partitionBy(run, "__segment", "__bucket").orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, 0)
    # each sample twice: as what its own bucket holds, and as what asks the bucket before; a union would make all of them twice
    row, own = F.struct(*names, "__front", "__before"), F.col("__sample")
    of = lambda bucket, at, held, asks: F.struct(bucket.alias("__bucket"), at.alias("__at"), held.alias("__sample"), asks.alias("__row"))
    both = F.array(of(F.col("__bucket"), F.col(t_ms), own, F.when(F.lit(False), row)), of(F.col("__bucket") - 1, F.col(t_ms) - window_ms, F.when(F.lit(False), own), row))
    twice = cut.select(run, "__segment", F.explode(both).alias("__x")).select(run, "__segment", "__x.*")
    met = twice.withColumn("__back", F.min("__sample").over(back)).where("__row is not null")
    cut = met.select("__row.*", "__back").withColumn("__first", F.least("__front", "__back"))
    anchor = F.when(F.col("__first.seq") == F.col(seq), F.coalesce("__before", "__first")).otherwise(F.col("__first"))
    cut = cut.withColumn("__anchor", anchor).withColumn("elapsed", (F.col(t_ms) - F.col("__anchor.t")) / 1000.0)
    rate = F.when(F.col("elapsed") > 0, F.greatest(F.lit(0.0), (F.col(total) - F.col("__anchor.u")) / F.col("elapsed"))).otherwise(0.0)
    return cut.withColumn("rate", rate).drop("__first", "__front", "__back", "__before", "__anchor")


def eta(remaining, rate):
    """Whole seconds to go; 0 without a rate."""
    return F.when(rate > 0, F.floor(remaining / rate)).otherwise(0).cast("long")


def check_bounds(target: int, start: int = 0) -> None:
    """A counter needs a positive target and a start up to it."""
    if target <= 0:
        raise ValueError("the target must be greater than zero")
    if not 0 <= start <= target:
        raise ValueError("the start must lie between zero and the target")


def counter_violations(samples: DataFrame, run: str, seq: str, total: str, added: str) -> DataFrame:
    """Rows whose counter fell or does not grow by what was added."""
    before = F.coalesce(F.lag(total).over(Window.partitionBy(run).orderBy(seq)), F.lit(0))
    return samples.withColumn("previous", before).where((F.col(total) < F.col("previous")) | (F.col(added) < 0) | (F.col(total) - F.col("previous") != F.col(added)))


def interval_average(losses: DataFrame, run: str, step: str, loss: str, is_eval: str) -> DataFrame:
    """(run, step, average): the mean of finite losses since the evaluation before, the evaluation's own included; without one, its own loss."""
    before = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    parts = losses.withColumn("__interval", F.coalesce(F.sum(F.col(is_eval).cast("int")).over(before), F.lit(0)))
    mean = F.avg(F.when(is_finite(F.col(loss)), F.col(loss)))
    met = parts.groupBy(run, "__interval").agg(mean.alias("mean"), F.max(F.when(F.col(is_eval), F.col(step))).alias("step"), F.max_by(F.col(loss), F.when(F.col(is_eval), F.col(step))).alias("own"))
    return met.where("step is not null").select(run, "step", F.coalesce("mean", "own").alias("average"))


def carry_forward(rows: DataFrame, run: str, step: str, value: str, to: str) -> DataFrame:
    order = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.last(value, ignorenulls=True).over(order))


def running_best(rows: DataFrame, run: str, step: str, value: str, to: str) -> DataFrame:
    return rows.withColumn(to, F.min(value).over(Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))


def run_summary(events: DataFrame, run: str, step: str, name: str, value: str) -> DataFrame:
    """Last, least and greatest value and count of each metric of a run."""
    return events.groupBy(run, name).agg(F.max_by(value, step).alias("last"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))


def throughput(rows: DataFrame, by: str, units: str, t_ms: str) -> DataFrame:
    """Units over the whole time of each run; 0 where no time passed."""
    met = rows.groupBy(by).agg(F.sum(units).alias("units"), ((F.max(t_ms) - F.min(t_ms)) / 1000.0).alias("elapsed"))
    return met.withColumn("per_second", F.when(F.col("elapsed") > 0, F.col("units") / F.col("elapsed")).otherwise(0.0))

"""Losses and accuracies over logits in long form (row, tok, logit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import select_accuracy

IGNORED = -1


def log_sum_exp(logits: Column) -> Column:
    """Of an array, with its greatest value taken out first."""
    top = F.array_max(logits).cast("double")
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log p(target) of one position; null where the target is ignored."""
    return F.when(target != IGNORED, log_sum_exp(logits) - F.get(logits, target.cast("int")).cast("double"))


def softmax(rows: DataFrame, logit: str = "logit") -> DataFrame:
    own = Window.partitionBy("row")
    shifted = F.exp(F.col(logit) - F.max(logit).over(own))
    return rows.withColumn("__e", shifted).withColumn("p", F.col("__e") / F.sum("__e").over(own)).drop("__e")


def sequence_loss(positions: DataFrame) -> DataFrame:
    """Mean loss of each sequence, from (seq, nll)."""
    return positions.groupBy("seq").agg(F.avg("nll").alias("loss"), F.count("nll").alias("tokens"))


def masked_loss(positions: DataFrame) -> DataFrame:
    """Sum and count over targets that count, in one row; the mean's denominator is 1 at least."""
    met = positions.agg(F.coalesce(F.sum("nll"), F.lit(0.0)).alias("loss_sum"), F.count("nll").alias("active"))
    return met.withColumn("loss", F.col("loss_sum") / F.greatest(F.lit(1), F.col("active")))


def validation_report(positions: DataFrame, weighted: bool) -> DataFrame:
    """Loss and perplexity of a whole set: the mean of sequence means, or weighted by tokens that count."""
    if weighted:
        out = masked_loss(positions).select("loss", F.col("active").alias("tokens"))
    else:
        own = sequence_loss(positions)
        out = own.agg((F.coalesce(F.sum("loss"), F.lit(0.0)) / F.greatest(F.lit(1), F.count("*"))).alias("loss"), F.sum("tokens").alias("tokens"))
    return out.withColumn("perplexity", F.exp("loss"))


def sampled_loss(batches: DataFrame) -> DataFrame:
    """Batch means weighted by all tokens of each batch, from (batch, loss, tokens)."""
    return batches.agg((F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")).alias("dev_loss"), F.sum("tokens").alias("tokens"))


def accuracy_report(results: DataFrame) -> DataFrame:
    """Accuracy of each task from (task, metrics), and their mean as task macro_average."""
    own = results.select("task", select_accuracy(F.col("metrics")).alias("accuracy"))
    return own.unionByName(own.agg(F.lit("macro_average").alias("task"), F.avg("accuracy").alias("accuracy")))

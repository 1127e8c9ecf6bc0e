"""Tasks of several choices, scored by a language model: the choice with the highest score is the answer.

A task row (task, item, prompt, choices, gold) becomes a row for each choice: the ids of prompt and choice behind one another, and
where the choice begins. A scorer gives the log-likelihood of the ids from there on, a batch at a time; the answer is its greatest
sum, or the greatest sum for a byte of the choice. Ties go to the earlier choice. An item with no choices, or a gold that is none
of them, is an error of its task and counts as wrong.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normalize_limit
from . import losses


def limited(tasks: DataFrame, limit: int | None) -> DataFrame:
    """The first items of each task, by item; 0 or None takes all."""
    n = normalize_limit(limit or 0)
    if n is None:
        return tasks
    return tasks.withColumn("__r", F.row_number().over(Window.partitionBy("task").orderBy("item"))).where(F.col("__r") <= n).drop("__r")


def requests(tasks: DataFrame, ids: Callable[[Column], Column]) -> DataFrame:
    """(task, item, gold, choice, n_bytes, tokens, start): a row for each choice."""
    each = tasks.select("task", "item", "gold", "prompt", F.posexplode_outer("choices").alias("choice", "text"))
    prompt, text = F.coalesce("prompt", F.lit("")), F.coalesce("text", F.lit(""))
    coded = each.select("task", "item", "gold", "choice", F.octet_length(text).alias("n_bytes"), ids(prompt).alias("__prompt"), ids(text).alias("__text"))
    return coded.select("task", "item", "gold", "choice", "n_bytes", F.concat("__prompt", "__text").alias("tokens"), F.size("__prompt").alias("start"))


#: (ids of a batch of rows one behind the other, where each row ends, where its choice begins) to a score for each row.
Scorer = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def scored(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """``rows`` of ``requests`` with ``score`` in place of the tokens."""
    kept = ["task", "item", "gold", "choice", "n_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column("tokens")
            ends = np.cumsum(pa.compute.list_value_length(tokens).to_numpy(zero_copy_only=False))
            scores = scorer(tokens.flatten().to_numpy(zero_copy_only=False), ends, b.column("start").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, "score"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*kept).dtypes)
    return rows.select(*kept, "tokens", "start").mapInArrow(run, f"{kinds}, score double")


def answers(scores: DataFrame) -> DataFrame:
    """(task, item, gold, answer, answer_norm): by sum, and by sum for a byte."""
    best = lambda s: F.max_by("choice", F.when(F.col("choice").isNotNull(), F.struct(s, -F.col("choice"))))
    per_byte = F.col("score") / F.greatest(F.lit(1), F.col("n_bytes"))
    return scores.groupBy("task", "item").agg(F.first("gold").alias("gold"), best(F.col("score")).alias("answer"), best(per_byte).alias("answer_norm"))


def evaluate(tasks: DataFrame, ids: Callable[[Column], Column], scorer: Scorer, limit: int | None = None) -> DataFrame:
    """(task, items, metrics): the accuracy by either rule, under the names that reports use."""
    own = answers(scored(requests(limited(tasks, limit), ids), scorer))
    right = lambda c: F.avg(F.coalesce((F.col(c) == F.col("gold")).cast("double"), F.lit(0.0)))
    return own.groupBy("task").agg(F.count("*").alias("items"), F.create_map(F.lit("acc,none"), right("answer"), F.lit("acc_norm,none"), right("answer_norm")).alias("metrics"))


def report(results: DataFrame) -> DataFrame:
    """(task, accuracy) and their mean, from what ``evaluate`` gives."""
    return losses.accuracy_report(results.select("task", "metrics"))

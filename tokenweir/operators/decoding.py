"""The decoding policy over (row, tok, logit) and (row, pos, tok). A row's group is bounded by the vocabulary."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .losses import softmax


def repetition_penalty(logits: DataFrame, history: DataFrame, penalty: float) -> DataFrame:
    """Once for each id that occurs in the history, whatever its count."""
    if penalty == 1.0:
        return logits
    seen = history.select("row", "tok", F.lit(True).alias("seen")).distinct()
    x = F.col("logit")
    return logits.join(seen, ["row", "tok"], "left").select("row", "tok", F.when(F.col("seen"), F.when(x < 0, x * penalty).otherwise(x / penalty)).otherwise(x).alias("logit"))


def banned_tokens(history: DataFrame, n: int) -> DataFrame:
    """(row, tok) that would complete an n-gram of the history again."""
    a = F.col("a")
    whole = history.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]).alias("a"))
    whole = whole.where(F.size(a) >= max(1, n)).select("row", "a", F.explode(F.sequence(F.lit(1), F.size(a) - n + 1)).alias("i"))
    if n > 1:
        whole = whole.where(F.slice(a, F.col("i"), n - 1) == F.slice(a, F.size(a) - n + 2, F.lit(n - 1)))
    return whole.select("row", F.get(a, F.col("i") + n - 2).alias("tok")).distinct()


def ban_ngrams(logits: DataFrame, history: DataFrame, n: int) -> DataFrame:
    return logits if n == 0 else logits.join(banned_tokens(history, n), ["row", "tok"], "left_anti")


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """The k highest, and all that tie with the last."""
    if k == 0:
        return logits
    return logits.withColumn("__r", F.rank().over(Window.partitionBy("row").orderBy(F.desc("logit")))).where(F.col("__r") <= k).drop("__r")


def nucleus(logits: DataFrame, p: float) -> DataFrame:
    """Tokens whose probability before them, from the highest down, is ``p`` at most; ties go by id. The first always stays."""
    if p >= 1.0:
        return logits
    order = Window.partitionBy("row").orderBy(F.desc("logit"), "tok").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("p").over(order), F.lit(0.0))
    return softmax(logits).withColumn("__before", before).where(F.col("__before") <= p).select(*logits.columns)


def min_p(logits: DataFrame, p: float) -> DataFrame:
    if p <= 0:
        return logits
    return logits.withColumn("__top", F.max("logit").over(Window.partitionBy("row"))).where(F.col("logit") >= F.col("__top") + math.log(p)).drop("__top")


def greedy(logits: DataFrame) -> DataFrame:
    """The highest token of each row; the first of equal ones."""
    return logits.groupBy("row").agg(F.max_by("tok", F.struct("logit", -F.col("tok"))).alias("tok"))


def draw(logits: DataFrame, seed: int) -> DataFrame:
    """A token of each row by inverse distribution, with a uniform number from a hash of seed and row."""
    u = F.conv(F.substr(F.md5(F.concat_ws("-", F.lit(seed), "row")), F.lit(1), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    order = Window.partitionBy("row").orderBy(F.desc("logit"), "tok").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = softmax(logits).withColumn("__c", F.sum("p").over(order)).withColumn("__u", u)
    last = Window.partitionBy("row")
    return cumulative.withColumn("__max", F.max("__c").over(last)).where((F.col("__c") > F.col("__u")) | (F.col("__c") == F.col("__max"))).groupBy("row").agg(F.min_by("tok", "__c").alias("tok"))


def next_token(logits: DataFrame, history: DataFrame, *, is_greedy: bool = False, temperature: float = 1.0, k: int = 0, p: float = 1.0, min_prob: float = 0.0, penalty: float = 1.0, ngram: int = 0, seed: int = 0) -> DataFrame:
    """The whole policy: penalty, ban, then the highest token, or temperature, filters and a draw."""
    check_policy(temperature, k, p, min_prob, penalty, ngram)
    out = ban_ngrams(repetition_penalty(logits, history, penalty), history, ngram)
    if is_greedy:
        return greedy(out)
    out = out.withColumn("logit", F.col("logit") / temperature)
    return draw(min_p(nucleus(top_k(out, k), p), min_prob), seed)


def check_policy(temperature: float, k: int, p: float, min_prob: float, penalty: float, ngram: int) -> None:
    for name, good in (("temperature", temperature > 0), ("top_k", k >= 0), ("top_p", 0 < p <= 1), ("min_p", 0 <= min_prob <= 1), ("repetition_penalty", penalty > 0), ("no_repeat_ngram_size", ngram >= 0)):
        if not good:
            raise ValueError(f"{name} is out of range")


def replicate(prompts: DataFrame, samples: int) -> DataFrame:
    return prompts.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))

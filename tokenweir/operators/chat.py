"""Conversations: rendering, loss masks, paired streams."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from ..functions import tokenizers

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "Answer clearly and to the point, and say so where you do not know."
MASKED = -1


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) of exploded turns, in order."""
    met = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return met.select("conv_id", F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def inject_system(messages: Column, prompt: str | None = None, default: str = SYSTEM) -> Column:
    """A given prompt always goes first; the default only where the first turn is not a system turn."""
    turn = lambda text: F.array(F.struct(F.lit("system").alias("role"), F.lit(text).alias("content")))
    if prompt:
        return F.concat(turn(prompt), messages)
    return F.when((F.size(messages) > 0) & (F.get(messages, F.lit(0))["role"] != "system"), F.concat(turn(default), messages)).otherwise(messages)


def render(messages: Column, generation_prompt: bool = False) -> Column:
    text = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["content"], F.lit(END + "\n"))), "")
    return F.concat(text, F.lit(f"{START}assistant\n")) if generation_prompt else text


def encode(messages: Column, ids: Callable[[Column], Column]) -> tuple[Column, Column]:
    """(inputs, targets): header and body are tokenized apart; only bodies of the assistant are targets."""
    header = lambda m: ids(F.concat(F.lit(START), m["role"], F.lit("\n")))
    body = lambda m: ids(F.concat(m["content"], F.lit(END + "\n")))
    masked = lambda n: F.array_repeat(F.lit(MASKED), n)
    inputs = F.flatten(F.transform(messages, lambda m: F.concat(header(m), body(m))))
    targets = F.flatten(F.transform(messages, lambda m: F.concat(masked(F.size(header(m))), F.when(m["role"] == "assistant", body(m)).otherwise(masked(F.size(body(m)))))))
    return inputs, targets


@F.arrow_udf(StructType().add("inputs", ArrayType(IntegerType())).add("targets", ArrayType(IntegerType())))
def _byte_pairs(texts: pa.Array, aimed: pa.Array) -> pa.Array:
    at = texts.offsets.to_numpy()
    ids, starts = tokenizers.widened(texts.values.slice(at[0], at[-1] - at[0]))
    flags = aimed.flatten().to_numpy(zero_copy_only=False)
    offsets = pa.array(starts[at - at[0]].astype(np.int32))
    targets = np.where(np.repeat(flags, np.diff(starts)), ids, np.int32(MASKED))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, targets)], ["inputs", "targets"])


def encode_bytes(messages: Column) -> tuple[Column, Column]:
    """``encode`` by bytes in Arrow: the texts' own bytes, widened, without a step for each. ``messages`` must not be null."""
    own = lambda *x: F.coalesce(F.concat(*x), F.lit(""))
    texts = F.flatten(F.transform(messages, lambda m: F.array(own(F.lit(START), m["role"], F.lit("\n")), own(m["content"], F.lit(END + "\n")))))
    aimed = F.flatten(F.transform(messages, lambda m: F.array(F.lit(False), F.coalesce(m["role"] == "assistant", F.lit(False)))))
    met = _byte_pairs(texts, aimed)
    return met["inputs"], met["targets"]


def loss_stats(shards: DataFrame) -> DataFrame:
    """Tokens, targets that count and their share, for each paired shard."""
    active = F.size(F.filter("targets", lambda t: t != MASKED)).cast("long")
    return shards.select("shard", F.size("inputs").cast("long").alias("tokens"), active.alias("loss_tokens")).withColumn("loss_token_ratio", F.bround(F.col("loss_tokens") / F.col("tokens"), 4))

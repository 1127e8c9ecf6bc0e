"""Checks of committed shards, resume state and key sets. Each returns or raises what is wrong."""

from __future__ import annotations

import json
import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import token_shards

META = "shard_index long, tokens long, vocab_size long, dtype string, dataset_revision string, tokenizer_revision string, loss_tokens long, loss_token_ratio double, inputs_dtype string, targets_dtype string"
STATE_VERSION = 1


def _length(path: str) -> tuple[int]:
    return (os.path.getsize(path),)


def _text(path: str) -> tuple[str]:
    with open(path, encoding="utf-8") as f:
        return (f.read(),)


def shard_files(spark: SparkSession, folder: str, suffix: str = ".bin") -> DataFrame:
    """(shard, name, length) of a folder's shard files, without their content."""
    found = token_shards.each_file(spark, folder, f"*{suffix}", _length, "length long")
    return found.select(F.regexp_extract("name", r"_(\d{4,})", 1).cast("long").alias("shard"), "name", "length")


def shard_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, and what its description says); a description that is not JSON is an error. Spark's own reader would take a task for
    every few files."""
    found = token_shards.each_file(spark, folder, "*_meta.json", _text, "text string")
    about = F.from_json("text", META, {"mode": "FAILFAST"})
    read = found.select("name", F.when(F.trim("text") == "", F.raise_error(F.concat(F.lit("empty description: "), "name")).cast(StructType.fromDDL(META))).otherwise(about).alias("about"))
    return read.select(F.regexp_extract("name", r"_(\d{4,})_meta\.json$", 1).cast("long").alias("shard"), "about.*")


#: Of each kind of set: the files of a shard, by the end of their names, with the bytes of a token, and what describes their types.
KINDS = {False: ({"": 2}, {"dtype": "uint16"}), True: ({"_inputs": 2, "_targets": 4}, {"inputs_dtype": "uint16", "targets_dtype": "int32"})}


def violations(spark: SparkSession, files: DataFrame, meta: DataFrame, shards: int, size: int, paired: bool = False, revisions: dict[str, str] | None = None) -> DataFrame:
    """(shard, problem) of each expected shard that is missing, of a wrong size, or described wrongly. A paired set has the two
    files of inputs and targets for each shard; ``files`` then needs their names."""
    ends, types = KINDS[paired]
    met = spark.range(shards).withColumnRenamed("id", "shard")
    problems = []
    for end, width in ends.items():
        column = f"length{end}"
        own = files.where(F.col("name").endswith(f"{end}.bin")) if paired else files
        met = met.join(own.select("shard", F.col("length").alias(column)), "shard", "left")
        what = f"{end[1:]} shard" if end else "shard"
        problems += [F.when(F.col(column).isNull(), f"{what} is missing"), F.when(F.col(column) != size * width, f"{what} has an invalid size")]
    met = met.join(meta.withColumn("described", F.lit(True)), "shard", "left")
    wrong = ~F.col("shard_index").eqNullSafe(F.col("shard")) | ~F.col("tokens").eqNullSafe(F.lit(size).cast("long"))
    for column, value in {**types, **(revisions or {})}.items():
        wrong = wrong | ~F.col(column).eqNullSafe(F.lit(value))
    problems += [F.when(F.col("described").isNull(), "metadata is missing"), F.when(F.col("described") & wrong, "metadata is invalid")]
    return met.select("shard", F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull())).alias("problem"))


def check_set(spark: SparkSession, folder: str, state: dict, publish: bool = False, paired: bool = False) -> None:
    """Raise for the first violations of a folder's committed shards; for publication the set must be complete and, if not paired, of the state's revisions."""
    if publish and isinstance(state.get("max_shards"), int) and not is_complete(state):
        raise ValueError("the set is incomplete")
    revisions = {k: state[k] for k in ("dataset_revision", "tokenizer_revision") if k in state} if publish and not paired else None
    found = violations(spark, shard_files(spark, folder), shard_metadata(spark, folder), state["next_shard"], state["shard_size_tokens"], paired, revisions).orderBy("shard").limit(10).collect()
    if found:
        raise ValueError("; ".join(f"{r['shard']:04d}: {r['problem']}" for r in found))


def publishable(spark: SparkSession, folder: str, prefix: str = "shard") -> DataFrame:
    """(name, kind, length) of the files of a set that may be published: its shards and what describes them, and nothing else."""
    found = token_shards.each_file(spark, folder, f"{prefix}_*", _length, "length long").where(F.col("name").endswith(".bin") | F.col("name").endswith("_meta.json"))
    name = F.col("name")
    kind = F.when(name.endswith("_inputs.bin"), "inputs").when(name.endswith("_targets.bin"), "targets").when(name.endswith("_meta.json"), "meta").otherwise("ids")
    return found.select(name.alias("name"), kind.alias("kind"), "length")


def checkpoint_config(spark: SparkSession, folder: str, defaults: dict) -> tuple[dict, dict]:
    """(configuration, state) that a checkpoint's ``training_state.json`` holds, from any store that Spark reads. A checkpoint
    of before configurations were saved has the defaults, with a warning; fields that the defaults do not know are refused."""
    found = spark.read.option("pathGlobFilter", "training_state.json").text(folder, wholetext=True).collect()  # one small file
    state = json.loads(found[0]["value"]) if found else {}
    saved = state.get("model_config")
    if saved is None:
        warnings.warn("the checkpoint has no saved model_config; the defaults are used", RuntimeWarning, stacklevel=2)
        return dict(defaults), state
    unknown = sorted(set(saved) - set(defaults))
    if unknown:
        raise ValueError(f"model_config has unknown fields: {', '.join(unknown)}")
    return {**defaults, **saved}, state


def check_state(state: dict | None, expected: dict, outputs: bool, pending: int | tuple[int, ...] | None) -> None:
    """Resume only from a state of this version and configuration, whose pending tokens are there; of a paired set the inputs
    and the targets that are pending are counted, and must be as many."""
    if isinstance(pending, tuple):
        pending = pending[0] if len(set(pending)) == 1 else None
    if state is None:
        if outputs:
            raise ValueError("outputs exist without a resume state")
        return
    if state.get("schema_version") != STATE_VERSION:
        raise ValueError("unknown state version")
    drift = sorted(k for k, v in expected.items() if state.get(k) != v)
    if drift:
        raise ValueError(f"configuration mismatch: {', '.join(drift)}")
    if pending is None or pending != state.get("pending_tokens"):
        raise ValueError("pending tokens are missing or of the wrong number")


def is_complete(state: dict) -> bool:
    m = state.get("max_shards")
    return m is not None and state["next_shard"] == m and state["committed_tokens"] == m * state["shard_size_tokens"]


def check_keys(keys: DataFrame, expected: list[str], aliases: tuple[str, str]) -> DataFrame:
    """(missing, unexpected) of a key column (key): one of two tied aliases may be missing."""
    want = F.array(*[F.lit(k) for k in expected])
    have = keys.agg(F.collect_set("key").alias("have"))
    missing = F.array_except(want, F.col("have"))
    tied = F.array(*[F.lit(a) for a in aliases])
    one = F.size(F.array_intersect(missing, tied)) == 1
    return have.select(F.when(one, F.array_except(missing, tied)).otherwise(missing).alias("missing"), F.array_except(F.col("have"), want).alias("unexpected"))

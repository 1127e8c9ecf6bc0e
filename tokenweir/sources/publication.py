"""Publication of a shard set into another folder that every host mounts, which can be taken up again where it broke off.

What may go is the set's shards and descriptions, by name. Tasks hash them on both sides; what the target does not hold with the
same hash is copied, a file at a time under another name that is renamed when it is whole. The manifest, name, length and hash of
each file, goes last: a target without one is not complete.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scope
from . import token_shards

MANIFEST = "manifest.json"


def _about(path: str) -> tuple[int, str]:
    import hashlib

    with open(path, "rb") as f:
        return os.fstat(f.fileno()).st_size, hashlib.file_digest(f, "sha256").hexdigest()


def hashed(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """(name, length, sha256) of what of a folder may be published."""
    found = token_shards.each_file(spark, folder, f"{prefix}_*", _about, "length long, sha256 string")
    return found.where(F.col("name").endswith(".bin") | F.col("name").endswith("_meta.json"))


def _copied(source: str, target: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrived = []
            for name in b.column("name").to_pylist():
                beside = os.path.join(target, f".{name}.{uuid.uuid4().hex}.tmp")
                shutil.copyfile(os.path.join(source, name), beside)
                with open(beside, "rb+") as f:
                    os.fsync(f.fileno())
                os.replace(beside, os.path.join(target, name))
                arrived.append(_about(os.path.join(target, name))[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(arrived, pa.string())], [*b.schema.names, "arrived"])

    return run


def publish(spark: SparkSession, folder: str, target: str, prefix: str = "shard") -> tuple[int, int]:
    """Bring ``target`` up to ``folder``; the files that were copied, and their bytes. The set is to have been checked before.

    Each side is hashed once, and what has been copied once more, where it has arrived."""
    source, to = token_shards.local(folder), token_shards.local(target)
    to.mkdir(parents=True, exist_ok=True)
    for p in to.glob(".*.tmp"):  # what a run before has left
        p.unlink(missing_ok=True)
    with scope(spark):
        want = materialise(hashed(spark, folder, prefix), "hashed")
        left = materialise(want.join(hashed(spark, target, prefix).select("name", "sha256"), ["name", "sha256"], "left_anti").select("name", "length", "sha256"), "left")
        tasks = max(1, min(spark.sparkContext.defaultParallelism * 4, left.count() // token_shards.TASK_FILES))
        # names are few bytes and files many: the number of tasks is of files
        sent = left.repartition(tasks, "name").mapInArrow(_copied(str(source), str(to)), "name string, length long, sha256 string, arrived string")
        done = sent.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b"), F.count_if(F.col("sha256") != F.col("arrived")).alias("bad")).first()
        token_shards.sync_folder(to)
        if done["bad"]:
            raise ValueError(f"{done['bad']} files did not arrive as they are")
        _list(want, to / MANIFEST)
    return done["n"], done["b"]


def _list(want: DataFrame, path: Path) -> None:
    """The manifest, one JSON object with a line for each file of the set, which goes through the driver a line at a time."""
    beside = path.with_name(f".{path.name}.{uuid.uuid4().hex}.tmp")
    line = F.concat(F.to_json(F.array("name")), F.lit(": "), F.to_json(F.struct("length", "sha256")))
    with beside.open("w", encoding="utf-8") as f:
        f.write("{")
        for k, r in enumerate(want.orderBy("name").select(line.alias("line")).toLocalIterator(prefetchPartitions=True)):
            name, about = r["line"].split("]: ", 1)
            f.write(f"{',' * (k > 0)}\n{name[1:]}: {about}")
        f.write("\n}\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)
    token_shards.sync_folder(path.parent)


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """(name, length, sha256) of what a published folder holds. Lines of the manifest are read apart, so that it is never one row."""
    line = F.regexp_replace("value", ",$", "")
    entry = F.explode(F.from_json(F.concat(F.lit("{"), line, F.lit("}")), "map<string, struct<length: long, sha256: string>>", {"mode": "FAILFAST"}))
    lines = spark.read.text(f"{target}/{MANIFEST}").where(F.col("value").startswith('"'))
    return lines.select(entry.alias("name", "about")).select("name", "about.*")

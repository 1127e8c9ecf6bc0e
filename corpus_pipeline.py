"""A training corpus in five stages: quality rules, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns
of ``documents``. A stage's result is to be written before the next stage starts, which first deletes the intermediate
tables of the stages before it, and no others.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenweir.llm import decontam, linededup, minhash, packing, quality
from tokenweir.llm.common import adopt, collecting, drop, materialise, quoted, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of the intermediate tables of the stages run so far.
_WRITTEN: list[str] = []


def stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _WRITTEN)
        with collecting(_WRITTEN):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass every rule."""
    return quality.filter_documents(docs)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document whose every line stands in an earlier one goes. n_chars follows the text."""
    # other columns go as one, so that none can clash
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("__0"), *[quoted(c) for c in docs.columns if c not in ("doc_id", "text")]).alias("row"))
    out = linededup.dedup_lines(rows).where((F.col("n_removed") <= 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    now = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[now.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Tokenization and differencing are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, f in STAGES[:-1]:
        with collecting([]) as folder:
            docs = materialise(f(spark, docs, sf_dir), name)
        drop(spark, before)
        before = folder
    adopt(before)  # what the last stage reads
    return STAGES[-1][1](spark, docs, sf_dir)

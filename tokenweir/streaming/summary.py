"""Summaries of runs, merged batch by batch: for each metric of a run its last, least or greatest value, as it is declared.

A merge keeps the last value with its step, the least and the greatest, so that a batch which comes late or twice changes nothing
that it should not. The merged table is a new version beside the old one; a small file names the version that holds, and is
swapped when the version is whole. A crash before the swap leaves the old version, and the batch is merged again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_finite
from . import reports

FOLDS = ("last", "min", "max")


class SummaryStore:
    """``foreachBatch`` target of rows (run, step, name, value). ``folds``: of metrics that do not keep their last value."""

    def __init__(self, spark: SparkSession, folder: str, folds: dict[str, str] | None = None) -> None:
        self.spark, self.folder, self.folds = spark, folder.rstrip("/"), folds or {}
        unknown = sorted(set(self.folds.values()) - set(FOLDS))
        if unknown:
            raise ValueError(f"a summary keeps one of {', '.join(FOLDS)}, not {', '.join(unknown)}")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def state(self) -> dict:
        fs, path = self._fs()
        at = f"{self.folder}/current.json"
        if not fs.exists(path(at)):
            return {"batch": -1, "version": None}
        return json.loads(self.spark.read.text(at, wholetext=True).first()[0])  # one small file

    def _merged(self, state: dict) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/{state['version']}") if state["version"] else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        state = self.state()
        if batch_id <= state["batch"]:
            return
        rows = batch.where(is_finite(F.col("value")))
        own = rows.groupBy("run", "name").agg(F.max(F.struct("step", "value")).alias("last"), F.min("value").alias("min"), F.max("value").alias("max"))
        before = self._merged(state)
        if before is not None:
            own = before.unionByName(own).groupBy("run", "name").agg(F.max("last").alias("last"), F.min("min").alias("min"), F.max("max").alias("max"))
        version = f"v-{batch_id:09d}"
        own.write.mode("overwrite").parquet(f"{self.folder}/{version}")
        reports.write_report(self.spark, f"{self.folder}/current.json", {"batch": batch_id, "version": version})
        if state["version"]:
            fs, path = self._fs()
            fs.delete(path(f"{self.folder}/{state['version']}"), True)

    def read(self) -> DataFrame:
        """(run, summary): a map of metrics for each run."""
        merged = self._merged(self.state())
        if merged is None:
            return self.spark.createDataFrame([], "run long, summary map<string,double>")
        value = F.col("last.value")
        for kind in ("min", "max"):
            names = [n for n, f in self.folds.items() if f == kind]
            value = F.when(F.col("name").isin(names), F.col(kind)).otherwise(value)
        # the metrics of a run are a bounded list of names
        return merged.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("name", value.alias("value")))).alias("summary"))

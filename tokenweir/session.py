"""Session defaults, table access and shipping of the package to executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def session(master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own configuration."""
    return (
        SparkSession.builder.master(master).appName("tokenweir")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_tokenweir_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tokenweir-ship-")) / "tokenweir_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    sc.addPyFile(str(path))
    sc._tokenweir_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at a time; Spark's own bound is of rows, however long they are.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound what a Python worker holds of the rows that come to it, unless the session has a lower bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = str(spark.conf.get(name, None) or "")
    if not own.isdigit() or int(own) > size:
        spark.conf.set(name, str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where the session names none and runs on it alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tokenweir-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Where the folders of intermediate tables are listed: that of the innermost ``collecting``, else of the application.
_LISTS: ContextVar[list[str] | None] = ContextVar("tokenweir_folders", default=None)
_OWN: list[str] = []
_USED: list[SparkSession] = []


@contextmanager
def collecting(into: list[str]) -> Iterator[list[str]]:
    """What is written inside is listed in ``into`` alone, so that its owner, and nobody else, can drop it."""
    before = _LISTS.set(into)
    try:
        yield into
    finally:
        _LISTS.reset(before)


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Intermediate tables written inside go at its end; results that read them are to be written before."""
    with collecting([]) as own:
        try:
            yield own
        finally:
            drop(spark, own)


def drop(spark: SparkSession, folders: list[str]) -> None:
    """Delete the folders, and empty the list."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while folders:
        path = jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(conf).delete(path, True)


def _at_exit() -> None:
    """What no scope has dropped goes with the application, if its session is still there."""
    if _USED and _OWN and _USED[-1].sparkContext._jsc is not None:
        with suppress(Exception):
            drop(_USED[-1], _OWN)


atexit.register(_at_exit)


def adopt(folders: list[str]) -> None:
    """List folders in the list that holds here."""
    own = _LISTS.get()
    (_OWN if own is None else own).extend(folders)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of this name in the shared folder, listed to be dropped."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _USED[:] = [spark]
    adopt([path])
    return path


#: Whether shuffle files go at the end of a query, and not when the driver next collects its garbage.
SHEDS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shedding(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query that is run inside go when it ends. For queries that are run once: a second run makes them anew."""
    before = spark.conf.get(SHEDS, None)
    spark.conf.set(SHEDS, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHEDS)
        else:
            spark.conf.set(SHEDS, before)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: a later loss of executors replays nothing above it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

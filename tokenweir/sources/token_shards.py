"""Token shards as files: headerless little-endian uint16 ids (inputs) beside int32 targets, with a JSON description each.

``spark.read.format("token_shards")`` reads a folder of memory-mapped files, small shards together in an input partition and
large ones cut into several: rows of (shard, pos, tok[, target]), or with the option ``runs`` rows of (shard, first,
tokens[, targets]) of RUN tokens at most, which is what to read at scale. ``df.write.format("token_shards")`` takes rows of
(shard, tokens[, targets]); a shard may be many rows, which are to come to one task in their order (``packing.by_shard``) and
are appended as they come, so that a shard of any size is written with little memory. If there is a column ``first`` it is
checked against what has been written. A shard and what describes it are written by a task under names of its own attempt and
renamed when the job commits, which is all that the driver does for a shard, so a failed or repeated task leaves no half file under
a final name; readers skip names that start with a dot, and the next job sweeps them. The folder must be one that driver and executors share as a file system: a path of another kind is refused.

Filters on ``shard`` and on ``pos`` (or ``first`` of runs) become byte ranges: what they rule out is neither planned nor mapped.
``spark.readStream`` follows the numbered shards of a folder, each once it is described and all before it are; with the option
``cleanSource`` as ``delete``, as Spark's file source has it, those of a batch go once it is committed, for a folder that only hands
on. ``writeStream``
appends the shards of each micro-batch, in the order of their numbers, behind those that are there: the batch's place is logged
before its files are renamed, so that a batch which is run again, at whatever point it broke off, leaves the same set once.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase
from pathlib import Path
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import bound_batches

IDS, TARGETS = "<u2", "<i4"
RUN = 1 << 16


def local(path: str) -> Path:
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) and not path.startswith("file:"):
        raise ValueError(f"token shards need a folder that is mounted on every host, not {path}")
    return Path(re.sub(r"^file:/*", "/", path))


def sync_folder(path: Path) -> None:
    at = os.open(path, os.O_RDONLY)
    try:
        os.fsync(at)
    finally:
        os.close(at)


def write_synced(path: Path, data: bytes) -> None:
    with path.open("wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())


def replace_synced(path: Path, data: bytes) -> None:
    """Write beside, sync, rename; the folder is to be synced afterwards."""
    beside = path.with_name(f".{path.name}.{uuid.uuid4().hex}.tmp")
    write_synced(beside, data)
    os.replace(beside, path)


def write_atomic(path: Path, data: bytes) -> None:
    """Write beside, sync, rename, sync the folder."""
    replace_synced(path, data)
    sync_folder(path.parent)


def as_json(value: dict) -> bytes:
    return json.dumps(value, indent=2, sort_keys=True, default=str).encode()


def write_json(path: Path, value: dict, folder_too: bool = True) -> None:
    (write_atomic if folder_too else replace_synced)(path, as_json(value))


#: Files of a task at least, where files are listed.
TASK_FILES = 128


def each_file(spark, folder: str, pattern: str, of: Callable[[str], tuple], columns: str):
    """(name, and ``columns`` that ``of`` gives for a path) of the files of a folder that fit the pattern and do not start with a dot
    or an underscore. One task streams the names, as a folder is read in one go; the files are then opened by many."""
    root = str(local(folder))
    with os.scandir(root) as entries:
        n = sum(1 for _ in entries)
    tasks = max(1, min(spark.sparkContext.defaultParallelism * 4, n // TASK_FILES))
    kinds = StructType.fromDDL(columns)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            own: list[str] = []
            with os.scandir(root) as entries:
                for e in entries:
                    if e.name[0] not in "._" and fnmatchcase(e.name, pattern):
                        own.append(e.name)
                    if len(own) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], ["name"])
                        own = []
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], ["name"])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(kinds).types
        for b in batches:
            own = b.column("name").to_pylist()
            for at in range(0, len(own), 1024):
                rows = [of(os.path.join(root, x)) for x in own[at : at + 1024]]
                values = zip(*rows, strict=True) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(own[at : at + 1024], pa.string()), *(pa.array(list(v), t) for v, t in zip(values, types, strict=True))], ["name", *kinds.names])

    found = spark.range(0, 1, 1, 1).mapInArrow(names, "name string")
    return found.repartition(tasks, "name").mapInArrow(opened, f"name string, {columns}")


def discover(folder: str, paired: bool = False) -> list[Path]:
    """Input files in order of name: by their descriptions if paired; else numbered shards, or a single old-style file."""
    root = local(folder)
    if paired:
        found = [p.with_name(p.name.removesuffix("_meta.json") + "_inputs.bin") for p in sorted(root.glob("*_meta.json"))]
    else:
        numbered = sorted(x for x in (os.listdir(root) if root.is_dir() else []) if x.endswith(".bin") and x[0] != "." and re.search(r"_\d{4,}\.bin$", x))
        found = [root / x for x in numbered] or sorted(root.glob("train.bin"))
    if not found:
        raise FileNotFoundError(f"no token shards in {folder}")
    return found


#: Bytes of an input partition at most: small shards share one, a large shard has several.
PARTITION_BYTES = 8 << 20


@dataclass
class Stretch:
    """Tokens [low, high) of a shard's files."""

    index: int
    path: str
    low: int
    high: int


@dataclass
class Stretches(InputPartition):
    stretches: list[Stretch]


def _mapped(path: str, kind: str, low: int, high: int) -> np.ndarray:
    """Values [low, high) of a file; no other page of it is touched."""
    return np.memmap(path, kind, "r", low * np.dtype(kind).itemsize, (high - low,)) if high > low else np.zeros(0, kind)


class Bounds:
    """The whole numbers that filters let through: those of a range, and of a list if there is one."""

    def __init__(self) -> None:
        self.low, self.high = 0, 1 << 62
        self.listed: set[int] | None = None

    def take(self, f: Filter) -> bool:
        """Whether the filter is one of these, which then holds."""
        if isinstance(f, IsNotNull):
            return True
        values = f.value if isinstance(f, In) else [f.value] if hasattr(f, "value") else [None]
        if not all(isinstance(v, int) for v in values):
            return False
        if isinstance(f, EqualTo | EqualNullSafe | In):
            self.listed = set(values) if self.listed is None else self.listed & set(values)
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, values[0] + isinstance(f, GreaterThan))
        elif isinstance(f, LessThan | LessThanOrEqual):
            self.high = min(self.high, values[0] + isinstance(f, LessThanOrEqual))
        else:
            return False
        return True

    def __contains__(self, x: int) -> bool:
        return self.low <= x < self.high and (self.listed is None or x in self.listed)

    def ranges(self, low: int, high: int) -> Iterator[tuple[int, int]]:
        """Of [low, high), what is let through."""
        low, high = max(low, self.low), min(high, self.high)
        if self.listed is None:
            if low < high:
                yield low, high
            return
        yield from joined((x, x + 1) for x in sorted(self.listed) if low <= x < high)


def joined(ranges: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Ranges in order, those that touch as one."""
    now: tuple[int, int] | None = None
    for low, high in ranges:
        if now and now[1] == low:
            now = now[0], high
            continue
        if now:
            yield now
        now = low, high
    if now:
        yield now


class _Files:
    """How files are cut into input partitions and read, for batches and streams."""

    def __init__(self, options: dict) -> None:
        self.path, self.paired, self.runs = options["path"], *(options.get(k, "false").lower() == "true" for k in ("paired", "runs"))
        self.shards, self.places = Bounds(), Bounds()

    def cut(self, files: list[Path]) -> list[Stretches]:
        width = np.dtype(IDS).itemsize
        most = PARTITION_BYTES // width
        out: list[Stretches] = []
        room = 0
        for k, p in enumerate(files):
            index = shard_index(p, k)
            if index not in self.shards:
                continue
            n = os.path.getsize(p) // width
            for start in range(0, n, most):
                end = min(n, start + most)
                # runs begin at fixed places, so that a filter picks whole ones
                ranges = joined((at, min(at + RUN, end)) for at in range(start, end, RUN) if at in self.places) if self.runs else self.places.ranges(start, end)
                for low, high in ranges:
                    if not out or high - low > room:
                        out.append(Stretches([]))
                        room = most
                    out[-1].stretches.append(Stretch(index, str(p), low, high))
                    room -= high - low
        return out

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        for own in partition.stretches:
            yield from self._read(own)

    def _read(self, own: Stretch) -> Iterator[pa.RecordBatch]:
        columns = [_mapped(own.path, IDS, own.low, own.high)]
        if self.paired:
            columns.append(_mapped(targets_of(own.path), TARGETS, own.low, own.high))
        for at in range(own.low, own.high, RUN):
            n = min(RUN, own.high - at)
            values = [pa.array(np.asarray(c[at - own.low : at - own.low + n]).astype(np.int32)) for c in columns]
            if self.runs:
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), v) for v in values]
                yield pa.RecordBatch.from_arrays([pa.array([own.index], pa.int32()), pa.array([at], pa.int64()), *lists], ["shard", "first", "tokens", "targets"][: 2 + len(lists)])
            else:
                at_each = [pa.array(np.full(n, own.index, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))]
                yield pa.RecordBatch.from_arrays([*at_each, *values], ["shard", "pos", "tok", "target"][: 2 + len(values)])


def shard_index(path: Path, place: int) -> int:
    m = re.search(r"_(\d{4,})(?:_inputs)?\.bin$", path.name)
    return int(m[1]) if m else place


def targets_of(path: str) -> str:
    """The targets' file beside an inputs' file, of as many values."""
    out = path.removesuffix("_inputs.bin") + "_targets.bin"
    inputs, targets = os.path.getsize(path) // np.dtype(IDS).itemsize, os.path.getsize(out) // np.dtype(TARGETS).itemsize
    if inputs != targets:
        raise ValueError(f"Mismatch: {inputs} inputs and {targets} targets in {path}")
    return out


class Reader(_Files, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """What filters rule out is not opened."""
        columns = {("shard",): self.shards, ("first" if self.runs else "pos",): self.places}
        for f in filters:
            own = columns.get(getattr(f, "attribute", None))
            if own is None or not own.take(f):
                yield f

    def partitions(self) -> list[Stretches]:
        return self.cut(discover(self.path, self.paired)) or [Stretches([])]


class StreamReader(_Files, DataSourceStreamReader):
    """The offset is the number of shards from 0 on that are described without a gap, or have been and are deleted."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.prefix = options.get("prefix", "shard")
        self.deletes = options.get("cleanSource", "off").lower() == "delete"
        self.seen = deleted(local(self.path), self.prefix)

    def initialOffset(self) -> dict:
        return {"next": deleted(local(self.path), self.prefix)}

    def latestOffset(self) -> dict:
        while (local(self.path) / f"{self.prefix}_{self.seen:04d}_meta.json").exists():
            self.seen += 1
        return {"next": self.seen}

    def partitions(self, start: dict, end: dict) -> list[Stretches]:
        ending = "_inputs.bin" if self.paired else ".bin"
        return self.cut([local(self.path) / f"{self.prefix}_{k:04d}{ending}" for k in range(start["next"], end["next"])])

    def commit(self, end: dict) -> None:
        """A batch up to here is committed. That its shards go is written down before they do; what a stop then leaves goes the next time."""
        root = local(self.path)
        if not self.deletes or not end["next"]:
            return
        if end["next"] > deleted(root, self.prefix):
            write_json(deletions(root, self.prefix), {"next": end["next"]})
        own = re.compile(re.escape(self.prefix) + r"_(\d{4,})(_inputs|_targets)?(\.bin|_meta\.json)")
        with os.scandir(root) as entries:
            gone = [e.path for e in entries if (m := own.fullmatch(e.name)) and int(m[1]) < end["next"]]
        for p in gone:
            Path(p).unlink(missing_ok=True)


def deletions(root: Path, prefix: str) -> Path:
    """Where it is written down which shards of a folder have been deleted behind a stream."""
    return root / f"_{prefix}_deleted.json"


def deleted(root: Path, prefix: str) -> int:
    """How many of a folder's shards, from 0 on, have been deleted behind a stream."""
    path = deletions(root, prefix)
    return json.loads(path.read_text())["next"] if path.exists() else 0


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (shard, tokens, targets that count) of each, and what the names of their files hold until they are renamed."""

    attempt: str
    shards: list[tuple[int, int, int]]


#: What describes a shard: the end of the file's name.
META = "_meta.json"
#: Descriptions that are on their way to the disk at a time, where a stream's batch is committed.
SYNCS = 16


class _Shards:
    """What writers of batches and streams share."""

    #: Whether tasks know the final numbers, and so can describe their shards.
    described = True

    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.path, self.prefix = options["path"], options.get("prefix", "shard")
        self.about = json.loads(options.get("about", "{}"))
        self.paired = "targets" in schema.fieldNames()
        self.ends = ("_inputs.bin", "_targets.bin") if self.paired else (".bin",)
        self.job = uuid.uuid4().hex
        root = local(self.path)
        self.root = str(root)
        root.mkdir(parents=True, exist_ok=True)
        if overwrite:
            for p in [*root.glob(f"{self.prefix}_*.bin"), *root.glob(f"{self.prefix}_*.json"), deletions(root, self.prefix)]:
                p.unlink(missing_ok=True)

    def _name(self, shard: int, end: str) -> str:
        return f"{self.prefix}_{shard:04d}{end}"

    def _beside(self, shard: int, end: str, attempt: str) -> str:
        return f"{self.root}/.{self._name(shard, end)}.{attempt}.tmp"

    def _about(self, index: int, tokens: int, active: int) -> dict:
        """What describes a shard."""
        paired = {"loss_tokens": active, "loss_token_ratio": round(active / max(1, tokens), 4), "inputs_dtype": "uint16", "targets_dtype": "int32"}
        return {"shard_index": index, "tokens": tokens, **self.about} | (paired if self.paired else {"dtype": "uint16"})

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        out, done = Written(f"{self.job}.{uuid.uuid4().hex}", []), set()
        now: int | None = None
        files: list[IO[bytes]] = []
        n = active = 0

        def finish() -> None:
            if now is None:
                return
            for f in files:
                f.flush()
                os.fsync(f.fileno())
                f.close()
            if self.described:
                write_synced(Path(self._beside(now, META, out.attempt)), as_json(self._about(now, n, active)))
            out.shards.append((now, n, active))
            files.clear()
            done.add(now)

        for batch in batches:
            ids, targets = batch.column("tokens"), batch.column("targets") if self.paired else None
            firsts = batch.column("first").to_pylist() if "first" in batch.schema.names else None
            for k, shard in enumerate(batch.column("shard").to_pylist()):
                if shard != now:
                    finish()
                    if shard in done:
                        raise ValueError(f"the rows of shard {shard} do not come together")
                    now, n, active = shard, 0, 0
                    files += [open(self._beside(shard, end, out.attempt), "wb") for end in self.ends]
                if firsts is not None and firsts[k] != n:
                    raise ValueError(f"shard {shard} goes on at {firsts[k]} after {n} tokens")
                own = ids[k].values.to_numpy(zero_copy_only=False) if ids[k].is_valid else np.zeros(0, np.int64)
                if len(own) and (own.min() < 0 or own.max() > 65_535):
                    raise ValueError("a token id does not fit in 16 bits")
                columns = [own.astype(IDS)]
                if targets is not None:
                    aims = targets[k].values.to_numpy(zero_copy_only=False) if targets[k].is_valid else np.zeros(0, np.int64)
                    if len(aims) != len(own):
                        raise ValueError("Mismatch: inputs and targets differ in length")
                    active += int((aims != -1).sum())
                    columns.append(aims.astype(TARGETS))
                for f, values in zip(files, columns, strict=True):
                    f.write(values.tobytes())
                n += len(own)
        finish()
        return out

    def _rename(self, parts: list[tuple[int, int, str]], ends: tuple[str, ...]) -> None:
        """Files of these ends under their final numbers; parts: final number, the task's own, attempt."""
        for index, shard, attempt in parts:
            for end in ends:
                os.replace(self._beside(shard, end, attempt), f"{self.root}/{self._name(index, end)}")
        sync_folder(local(self.path))

    def sweep(self) -> None:
        """Delete files that no job or batch has taken up."""
        with os.scandir(local(self.path)) as entries:
            left = [e.path for e in entries if e.name[0] == "." and e.name.endswith(".tmp")]
        for p in left:
            Path(p).unlink(missing_ok=True)


class Writer(_Shards, DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        super().__init__(schema, options, overwrite)
        self.sweep()  # what a job before has left

    def commit(self, messages: list[Written | None]) -> None:
        parts = [(k, k, m.attempt) for m in messages if m for k, _, _ in m.shards]
        self._rename(parts, self.ends)
        self._rename(parts, (META,))

    def abort(self, messages: list[Written | None]) -> None:
        for p in local(self.path).glob(f".*.{self.job}.*.tmp"):
            p.unlink(missing_ok=True)


class StreamWriter(_Shards, DataSourceStreamArrowWriter):
    """Each batch has a line in a log: its first number, how many shards it has, and whether all of them are there. Batches are
    committed in turn, by a process that is not the tasks', so that what is still beside the set after a commit belongs to none."""

    described = False

    def publish(self, first: int, parts: list[tuple[int, int, int, str]]) -> None:
        """Shards under their final numbers first, then what describes them; parts: the task's own number, tokens, targets that count, attempt."""
        root = local(self.path)
        self._rename([(first + k, p[0], p[3]) for k, p in enumerate(parts)], self.ends)

        def describe(part: tuple[int, tuple[int, int, int, str]]) -> None:
            k, (_, tokens, active, _) = part
            write_json(root / self._name(first + k, META), self._about(first + k, tokens, active), False)

        with ThreadPoolExecutor(SYNCS) as pool:  # they wait for the disk, not for each other
            for _ in pool.map(describe, enumerate(parts)):
                pass
        sync_folder(root)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        parts = sorted((*s, m.attempt) for m in messages if m for s in m.shards)
        if len({p[0] for p in parts}) < len(parts):
            raise ValueError("the rows of a shard come from several tasks")
        logs = local(self.path) / f"_{self.prefix}_commits"
        logs.mkdir(exist_ok=True)
        log = logs / f"{batchId:09d}.json"
        entry = json.loads(log.read_text()) if log.exists() else {"first": self._next(logs, log), "shards": len(parts), "done": False}
        if entry["done"]:
            self.sweep()
            return
        if entry["shards"] != len(parts):
            raise ValueError(f"batch {batchId} had {entry['shards']} shards and now has {len(parts)}")
        write_json(log, entry)
        self.publish(entry["first"], parts)
        write_json(log, entry | {"done": True})
        self.sweep()

    def _next(self, logs: Path, log: Path) -> int:
        before = max((p for p in logs.glob("*.json") if p.name < log.name), default=None)
        if before:
            last = json.loads(before.read_text())
            return last["first"] + last["shards"]
        return max(deleted(local(self.path), self.prefix), 1 + max((shard_index(p, -1) for p in local(self.path).glob(f"{self.prefix}_*.bin")), default=-1))

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.sweep()


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        paired, runs = (self.options.get(k, "false").lower() == "true" for k in ("paired", "runs"))
        if runs:
            return "shard int, first long, tokens array<int>" + ", targets array<int>" * paired
        return "shard int, pos long, tok int" + ", target int" * paired

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(schema, self.options, overwrite)


def register(spark) -> None:
    bound_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenShards)

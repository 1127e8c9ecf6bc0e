import json
import shutil
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, StringContains
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tokenweir.functions import tokenizers as T
from tokenweir.operators import chat, choices, fetch, packing, splits, templates, validation
from tokenweir.session import materialise
from tokenweir.sources import publication, token_shards
from tokenweir.streaming import ingest, rates, summary


@pytest.mark.parametrize("parts", [1, 5])
def test_offsets_keep_rows_of_null_and_repeated_ids(spark, parts):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d e f"), (None, None), (2, "g"), (3, ""), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    tokens = T.with_eos(T.words(F.col("text")))
    got = packing.chunks(packing.place(df, "doc_id", F.size(tokens)), {"tokens": tokens}, 4).orderBy("shard").collect()
    stream = [t for r in got for t in r["tokens"]]
    assert sorted(stream) == sorted([w for _, t in rows for w in [*(t or "").split(), T.EOS]]) and [len(r["tokens"]) for r in got] == [4] * (len(stream) // 4) + [len(stream) % 4] * (len(stream) % 4 > 0)
    assert " ".join(stream).count("d e f <eos>") == 1 and stream.count("a") == 2
    offsets = packing.doc_offsets(df, tokens).collect()
    assert len(offsets) == len(rows) and max(r["end"] for r in offsets) == len(stream)


def test_byte_arrays_equal_byte_ids(spark):
    df = spark.createDataFrame([("né 中😀",), ("",), (None,), ("x" * 3000,)], "t string").repartition(2)
    got = df.select(T.byte_arrays()(F.col("t")).alias("a"), T.byte_ids(F.col("t")).alias("b"), T.byte_arrays(258)(F.col("t")).alias("c")).collect()
    assert all(r["a"] == r["b"] and r["c"] == [*r["a"], 258] for r in got)
    assert df.limit(0).select(T.byte_arrays(1)(F.col("t"))).collect() == []


def write_shards(spark, path, sizes, first=0):
    token_shards.register(spark)
    ids = np.random.default_rng(7).integers(0, 65_536, sum(sizes))
    cuts = np.cumsum([0, *sizes])
    rows = [(first + k, ids[a:b].tolist()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    spark.createDataFrame(rows, "shard int, tokens array<int>").write.format("token_shards").option("path", str(path)).mode("append").save()
    return [np.array(t) for _, t in rows]


def pushed(path, filters, runs=False):
    reader = token_shards.Reader({"path": str(path), "runs": str(runs).lower()})
    return reader, list(reader.pushFilters(filters))


def test_filters_become_byte_ranges(spark, tmp_path, monkeypatch):
    ids = write_shards(spark, tmp_path / "s", [5000, 70_000, 140_000, 9])
    mapped = []
    own = token_shards._mapped
    monkeypatch.setattr(token_shards, "_mapped", lambda path, kind, low, high: mapped.append((high - low) * np.dtype(kind).itemsize) or own(path, kind, low, high))

    def read(filters, runs=False):
        mapped.clear()
        reader, left = pushed(tmp_path / "s", filters, runs)
        out = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        return out, left, sum(mapped)

    rows, left, size = read([GreaterThanOrEqual(("pos",), 100), LessThan(("pos",), 164)])
    assert not left and size == 3 * 64 * 2 and [r["tok"] for r in rows if r["shard"] == 1] == ids[1][100:164].tolist()
    rows, left, size = read([In(("shard",), [0, 2, 9]), GreaterThan(("pos",), 4990), LessThanOrEqual(("pos",), 5001), StringContains(("pos",), "x")])
    assert len(left) == 1 and size == 2 * (9 + 11) and {r["shard"] for r in rows} == {0, 2}
    rows, left, size = read([In(("pos",), [3, 4, 8, 10**6]), IsNotNull(("pos",)), GreaterThan(("shard",), 1)])
    assert not left and size == 2 * 6 and [(r["shard"], r["pos"]) for r in rows] == [(2, 3), (2, 4), (2, 8), (3, 3), (3, 4), (3, 8)]
    rows, left, size = read([GreaterThan(("first",), 0)], runs=True)
    assert not left and [(r["shard"], r["first"]) for r in rows] == [(1, 65_536), (2, 65_536), (2, 131_072)] and rows[0]["tokens"] == ids[1][65_536:].tolist()
    assert size == 2 * (70_000 + 140_000 - 2 * 65_536)
    rows, left, size = read([EqualTo(("shard",), 7)])
    assert rows == [] and size == 0
    frame = spark.read.format("token_shards").load(str(tmp_path / "s"))
    assert [r["tok"] for r in frame.where("shard = 2 AND pos BETWEEN 70000 AND 70003").orderBy("pos").collect()] == ids[2][70_000:70_004].tolist()
    assert frame.where("pos > 10 AND pos < 12 AND tok IS NOT NULL").count() == 3 and frame.where("shard > 40").count() == 0


def test_windows_are_fetched_in_any_order(spark, tmp_path, monkeypatch):
    """A shuffled epoch against slices; short shards have no windows; a file's windows come from one task."""
    ids = write_shards(spark, tmp_path / "s", [41, 5, 200, 33])
    windows = [(x[at : at + 8], x[at + 1 : at + 9]) for x in ids for at in range(0, len(x) - 8, 4)]
    order = splits.batches(splits.epoch_order(spark.range(len(windows)).withColumnRenamed("id", "idx"), 42, 1), 5, drop_last=True)
    monkeypatch.setattr(fetch, "CUT", 24)
    got = fetch.fetch(order, str(tmp_path / "s"), 8, 4).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(windows) // 5 * 5 and sorted(r["rank"] for r in got) == list(range(len(got)))
    for r in got:
        assert (r["x"], r["y"]) == (windows[r["idx"]][0].tolist(), windows[r["idx"]][1].tolist()) and r["batch"] == r["rank"] // 5
    owner = np.repeat(np.arange(4), [packing_windows(len(x)) for x in ids])
    assert all(len({r["task"] for r in got if owner[r["idx"]] == k}) == 1 for k in (0, 2, 3))
    again = fetch.fetch(spark.createDataFrame([(0, "a"), (0, "b"), (-1, "c")], "idx long, tag string"), str(tmp_path / "s"), 8, 4).collect()
    assert {r["tag"]: r["x"] for r in again} == {"a": windows[0][0].tolist(), "b": windows[0][0].tolist(), "c": windows[-1][0].tolist()}
    with pytest.raises(Exception, match="out of range"):
        fetch.fetch(spark.createDataFrame([(len(windows),)], "idx long"), str(tmp_path / "s"), 8, 4).collect()


def packing_windows(n):
    return max(0, (n - 9) // 4 + 1)


def test_paired_windows(spark, tmp_path):
    token_shards.register(spark)
    inputs, targets = list(range(50)), [-1 if k % 3 else k for k in range(50)]
    spark.createDataFrame([(0, inputs, targets)], "shard int, tokens array<int>, targets array<int>").write.format("token_shards").option("path", str(tmp_path / "p")).mode("append").save()
    got = fetch.fetch(spark.range(6).withColumnRenamed("id", "idx"), str(tmp_path / "p"), 8, paired=True).collect()
    assert all(r["x"] == inputs[8 * r["idx"] : 8 * r["idx"] + 8] and r["y"] == targets[8 * r["idx"] + 1 : 8 * r["idx"] + 9] for r in got) and len(got) == 6


def follow(spark, base, **options):
    stream = spark.readStream.format("token_shards").option("runs", "true").options(**options).load(f"{base}/set")
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    return sorted((r["shard"], r["first"]) for r in spark.read.schema("shard int, first long, tokens array<int>").parquet(f"{base}/out").collect())


def test_shards_as_a_stream(spark, tmp_path):
    """New shards come once each over restarts; a shard that is not described yet, or stands behind a gap, waits."""
    write_shards(spark, tmp_path / "set", [10, 20])
    assert follow(spark, tmp_path) == [(0, 0), (1, 0)]
    assert follow(spark, tmp_path) == [(0, 0), (1, 0)]
    write_shards(spark, tmp_path / "set", [70_000, 5], first=2)
    about = tmp_path / "set" / "shard_0002_meta.json"
    about.rename(tmp_path / "later")
    assert follow(spark, tmp_path) == [(0, 0), (1, 0)]
    (tmp_path / "later").rename(about)
    assert follow(spark, tmp_path) == [(0, 0), (1, 0), (2, 0), (2, 65_536), (3, 0)]


SCHEMA = StructType().add("shard", IntegerType()).add("tokens", ArrayType(IntegerType()))


def batch_of(shards):
    return [pa.RecordBatch.from_pylist([{"shard": k, "tokens": t} for k, t in shards], pa.schema([("shard", pa.int32()), ("tokens", pa.list_(pa.int32()))]))]


def contents(path):
    return {p.name: np.fromfile(p, "<u2").tolist() for p in sorted(path.glob("*.bin"))}


@pytest.mark.parametrize("crash", ["no", "log", "files", "done"])
def test_a_batch_that_runs_again_leaves_one_set(tmp_path, monkeypatch, crash):
    path = tmp_path / "set"

    def writer():
        return token_shards.StreamWriter(SCHEMA, {"path": str(path)}, False)

    def run(batch, *tasks):
        w = writer()
        w.commit([w.write(iter(batch_of(t))) for t in tasks], batch)

    run(0, [(4, [1, 2])], [(3, [9])])
    if crash != "no":
        own = {"log": (token_shards.StreamWriter, "publish"), "files": (token_shards, "sync_folder"), "done": (token_shards, "write_json")}[crash]
        real, calls = getattr(*own), []

        def broken(*a):
            calls.append(a)
            # the log, two descriptions, and then the line that says all is there
            if crash != "done" or len(calls) == 4:
                raise OSError("lost")
            return real(*a)

        with monkeypatch.context() as m:
            # write_json syncs the folder, too: the break is to come after the log
            if crash == "files":
                m.setattr(token_shards, "write_atomic", lambda p, data: p.write_bytes(data))
            m.setattr(*own, broken)
            with pytest.raises(OSError, match="lost"):
                run(1, [(0, [5, 6]), (1, [7])])
    run(1, [(1, [7])], [(0, [5, 6])])
    run(1, [(0, [5, 6]), (1, [7])])
    run(2, [(0, [8])])
    assert contents(path) == {"shard_0000.bin": [9], "shard_0001.bin": [1, 2], "shard_0002.bin": [5, 6], "shard_0003.bin": [7], "shard_0004.bin": [8]}
    assert [json.loads((path / f"shard_{k:04d}_meta.json").read_text())["shard_index"] for k in range(5)] == list(range(5))
    assert not list(path.glob(".*.tmp"))
    w = writer()
    w.abort([w.write(iter(batch_of([(0, [1])])))], 3)
    assert not list(path.glob(".*.tmp")) and len(contents(path)) == 5
    w = writer()
    with pytest.raises(ValueError, match="several tasks"):
        w.commit([w.write(iter(batch_of([(0, [1])]))), w.write(iter(batch_of([(0, [2])])))], 3)
    token_shards.write_json(path / "_shard_commits" / "000000004.json", {"first": 5, "shards": 2, "done": False})
    w = writer()
    with pytest.raises(ValueError, match="had 2 shards"):
        w.commit([w.write(iter(batch_of([(0, [1])])))], 4)


def test_stream_into_shards(spark, tmp_path):
    token_shards.register(spark)
    want = []
    for part in range(3):
        rows = [(part * 2 + k, [part, k] * 5) for k in range(2)]
        want += [t for _, t in rows]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        stream.writeStream.format("token_shards").option("path", str(tmp_path / "set")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert list(contents(tmp_path / "set").values()) == want


TALKS = "conv_id long, messages array<struct<role:string,content:string>>"


def test_paired_stream_equals_one_batch(spark, tmp_path):
    """Files and state are the same after any number of restarts; a batch that is run again changes nothing; pending pairs are counted."""
    talks = [(k, [("user", "q" * (k % 5)), ("assistant", "answer " * (k % 4)), ("user", "")][: 1 + k % 3]) for k in range(40)]

    def run(name, cuts):
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            spark.createDataFrame(talks[a:b], TALKS).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            sink = ingest.PairedSink(str(tmp_path / name / "out"), 100, T.byte_ids)
            state = ingest.ingest(spark, str(tmp_path / name / "in"), TALKS, sink, str(tmp_path / name / "cp"), 1)
            assert state["batch"] == k
        return state

    one, many = run("one", [0, 40]), run("many", [0, 7, 8, 21, 40])
    assert {k: v for k, v in one.items() if k not in ("batch", "pending")} == {k: v for k, v in many.items() if k not in ("batch", "pending")}
    files = [{p.name: p.read_bytes() for p in (tmp_path / n / "out").glob("chat_*")} for n in ("one", "many")]
    assert files[0] == files[1] and len(files[0]) == 3 * one["next_shard"] and one["pending_tokens"] > 0
    ids, aims = chat.encode(F.col("messages"), T.byte_ids)
    flat = spark.createDataFrame(talks, TALKS).select("conv_id", ids.alias("i"), aims.alias("t")).orderBy("conv_id").collect()
    stream, n = [[x for r in flat for x in r[c]] for c in "it"], one["next_shard"] * 100
    for c, (end, kind) in enumerate((("inputs", "<u2"), ("targets", "<i4"))):
        assert np.concatenate([np.fromfile(p, kind) for p in sorted((tmp_path / "many" / "out").glob(f"*_{end}.bin"))]).tolist() == stream[c][:n]
    sink = ingest.PairedSink(str(tmp_path / "many" / "out"), 100, T.byte_ids)
    sink(spark.createDataFrame(talks[:3], TALKS), many["batch"])
    assert sink.state() == many
    pending = tmp_path / "many" / "out" / many["pending"]
    short = [(0, list(range(many["pending_tokens"])), [1])]
    shutil.rmtree(pending)
    spark.createDataFrame(short, "at long, inputs array<int>, targets array<int>").write.parquet(str(pending))
    with pytest.raises(ValueError, match="pending tokens"):
        sink(spark.createDataFrame(talks[:3], TALKS), many["batch"] + 1)


def test_summaries_take_late_and_repeated_batches(spark, tmp_path):
    kind = "run long, step long, name string, value double"
    store = summary.SummaryStore(spark, str(tmp_path / "s"), {"dev": "min", "rate": "max"})
    assert store.read().count() == 0
    batches = [[(1, 5, "loss", 2.0), (1, 5, "dev", 2.5), (1, 6, "rate", 10.0), (2, 1, "loss", 9.0)], [(1, 7, "loss", 1.5), (1, 7, "dev", 2.8), (1, 8, "loss", float("nan"))], [(1, 2, "loss", 8.0), (1, 3, "rate", 30.0), (1, 3, "dev", None)]]
    for k, rows in enumerate(batches):
        for _ in range(2):
            store(spark.createDataFrame(rows, kind), k)
    want = {1: {"loss": 1.5, "dev": 2.5, "rate": 30.0}, 2: {"loss": 9.0}}
    assert {r["run"]: r["summary"] for r in store.read().collect()} == want
    # a crash before the swap: the version is there, and nothing names it
    spark.range(1).write.parquet(str(tmp_path / "s" / "v-000000003"))
    assert {r["run"]: r["summary"] for r in store.read().collect()} == want
    store(spark.createDataFrame([(2, 2, "loss", 3.0)], kind), 3)
    assert {r["run"]: r["summary"] for r in summary.SummaryStore(spark, str(tmp_path / "s")).read().collect()}[2] == {"loss": 3.0}
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")) == ["current.json", "v-000000003"]
    with pytest.raises(ValueError, match="median"):
        summary.SummaryStore(spark, "x", {"a": "median"})


def rate_stream(spark, base, batches, window, keep=None):
    """The rows that come out over several runs of one query, each with a new file."""
    for rows in batches:
        frame = spark.createDataFrame(rows, "run long, seq long, t long, total long")
        frame.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{base}/in")
        out = rates.rolling_rate(stream, window, keep)
        out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return {(r["run"], r["seq"], r["t"]): r for r in spark.read.schema(rates.SCHEMA).parquet(f"{base}/out").collect()}


def test_rates_on_a_stream(spark, tmp_path):
    """State goes over restarts; a falling counter starts anew; late samples are given out as such and change nothing."""
    rows = [(1, 1, 0, 100), (1, 2, 2000, 140), (1, 3, 22_000, 240), (2, 1, 0, 100), (2, 2, 2000, 120), (2, 3, 3000, 5)]
    got = rate_stream(spark, tmp_path, [rows[:2] + rows[3:4], rows[4:], [(1, 1, 1500, 130), *rows[2:3], (2, 4, 2500, 9)]], 10_000)
    assert [got[k]["rate"] for k in ((1, 2, 2000), (1, 3, 22_000), (2, 2, 2000), (2, 3, 3000))] == [20, 5, 10, 0]
    assert {k for k, r in got.items() if r["late"]} == {(1, 1, 1500), (2, 4, 2500)} and got[2, 4, 2500]["rate"] is None and len(got) == 8
    for window, keep in ((0, None), (10, 5)):
        with pytest.raises(ValueError):
            rates.rolling_rate(spark.createDataFrame(rows, "run long, seq long, t long, total long"), window, keep)


def test_silent_runs_are_forgotten(spark, tmp_path):
    """With a timer: event time goes on with another run, and the first one's samples are gone when it comes back."""
    batches = [[(1, 1, 0, 10), (1, 2, 1000, 20)], [(2, 1, 400_000, 1)], [(2, 2, 401_000, 2)], [(1, 3, 402_000, 60)]]
    assert rate_stream(spark, tmp_path / "kept", batches, 10_000)[1, 3, 402_000]["rate"] == pytest.approx(40 / 401)
    assert rate_stream(spark, tmp_path / "timed", batches, 10_000, 20_000)[1, 3, 402_000]["rate"] == 0


def test_state_is_that_of_a_window():
    samples, rng = deque(), np.random.default_rng(4)
    rows = [(k, int(t), float(u)) for k, (t, u) in enumerate(zip(np.cumsum(rng.integers(0, 40, 3000)), np.cumsum(rng.integers(-1, 9, 3000)), strict=True))]
    for r, (seq, t, total, elapsed, rate, late) in zip(rows, rates.rated(samples, iter(rows), 500), strict=True):
        assert (seq, t, total) == r and not late and samples[0][1] >= t - 500 and elapsed >= 0 and rate >= 0
    assert len(samples) < 500


TASKS = "task string, item long, prompt string, choices array<string>, gold int"


def test_choices_by_sum_and_by_byte(spark):
    """A scorer that pays for each byte: the sum takes the shortest choice, the mean for a byte the best bytes; ties take the first."""
    rows = [("a", 1, "p", ["zz", "zzzz", "aaaaaa"], 2), ("a", 2, "long prompt", ["b", "b"], 0), ("a", 3, None, ["", None, "x"], 0), ("b", 1, "p", ["q"], 0), ("b", 2, "p", [], 0), ("b", 3, "p", ["q", "r"], 5)]
    cost = lambda ids, ends, starts: np.array([-ids[a + s : e].sum() / 100.0 for a, s, e in zip([0, *ends[:-1]], starts, ends, strict=True)])
    df = spark.createDataFrame(rows, TASKS).repartition(3)
    asked = {(r["task"], r["item"], r["choice"]): (bytes(r["tokens"]), r["start"]) for r in choices.requests(df.where("item = 2 AND task = 'a'"), T.byte_arrays()).collect()}
    assert asked == {("a", 2, k): (b"long promptb", 11) for k in (0, 1)}
    own = {(r["task"], r["item"]): (r["answer"], r["answer_norm"]) for r in choices.answers(choices.scored(choices.requests(df, T.byte_arrays()), cost)).collect()}
    assert own == {("a", 1): (0, 2), ("a", 2): (0, 0), ("a", 3): (0, 0), ("b", 1): (0, 0), ("b", 2): (None, None), ("b", 3): (0, 0)}
    found = {r["task"]: (r["items"], r["metrics"]) for r in choices.evaluate(df, T.byte_arrays(), cost).collect()}
    assert found == {"a": (3, {"acc,none": pytest.approx(2 / 3), "acc_norm,none": 1.0}), "b": (3, {"acc,none": pytest.approx(1 / 3), "acc_norm,none": pytest.approx(1 / 3)})}
    few = {r["task"]: r["items"] for r in choices.evaluate(df, T.byte_arrays(), cost, 2).collect()}
    assert few == {"a": 2, "b": 2}
    assert {r["task"]: r["accuracy"] for r in choices.report(choices.evaluate(df, T.byte_arrays(), cost, 1)).collect()} == {"a": 0.0, "b": 1.0, "macro_average": 0.5}
    with pytest.raises(ValueError):
        choices.limited(df, -1)


def test_publication_goes_on_where_it_broke_off(spark, tmp_path):
    """Only what is missing or differs is copied; what is not of the set never goes; the manifest comes last."""
    write_shards(spark, tmp_path / "set", [10, 20, 30])
    for name in ("state.json", "secret.txt", "pending-1.parquet", "other_0001.bin"):
        (tmp_path / "set" / name).write_text("x")
    target = tmp_path / "to"
    target.mkdir()
    shutil.copyfile(tmp_path / "set" / "shard_0000.bin", target / "shard_0000.bin")
    (target / "shard_0001.bin").write_bytes(b"\0" * 40)  # of the right length and another content
    (target / ".shard_0002.bin.1.tmp").write_bytes(b"half")
    assert publication.publish(spark, str(tmp_path / "set"), str(target))[0] == 5
    want = {f"shard_{k:04d}{e}" for k in range(3) for e in (".bin", "_meta.json")}
    assert {p.name for p in target.iterdir()} == want | {publication.MANIFEST}
    assert all((target / n).read_bytes() == (tmp_path / "set" / n).read_bytes() for n in want) and set(json.loads((target / publication.MANIFEST).read_text())) == want
    assert publication.publish(spark, str(tmp_path / "set"), str(target)) == (0, 0)
    (target / publication.MANIFEST).unlink()
    (tmp_path / "set" / "shard_0002.bin").chmod(0o600)
    own = publication._copied
    try:
        publication._copied = lambda source, to: own(source + "-gone", to)
        (target / "shard_0002.bin").unlink()
        with pytest.raises(Exception, match="No such file"):
            publication.publish(spark, str(tmp_path / "set"), str(target))
    finally:
        publication._copied = own
    assert not (target / publication.MANIFEST).exists()
    assert publication.publish(spark, str(tmp_path / "set"), str(target)) == (1, 60)


TALK = [("system", " be brief "), ("user", "hi"), ("assistant", "yo"), ("user", None)]


@pytest.mark.parametrize(
    "template,prompt,want",
    [
        ("{% for m in messages %}\n{{ m.role }}:{{ m['content'] }}\n{% endfor %}\n{% if add_generation_prompt %}go{% endif %}", True, "system: be brief \nuser:hi\nassistant:yo\nuser:\ngo"),
        ("a  {%- for m in messages[1:] -%}  {{ loop.index0 ~ loop.index }}{% if loop.first %}<{% elif loop.last %}>{% else %}-{% endif %}{%- endfor -%}  b", False, "a01<12-23>b"),
        ("{# a note #}{% set s = messages[0]['content'] | trim %}{{ '[' + s + ']' }}{{ messages | length }}{{ 1 + 2 }}", False, "[be brief]43"),
        ("{% if messages[0].role == 'system' and not add_generation_prompt %}{{ bos }}{% endif %}{% if tools is defined or 'x' in messages[1].content %}T{% endif %}{{ \"q\\n\" }}", False, "<s>q\n"),
        ("{% if bos is not none and messages[1].content != 'hi' %}no{% else %}{{ (bos | upper) + '!' }}{% endif %}", False, "<S>!"),
        ("{% for m in messages %}{% if m.role == 'user' %}{% for n in messages %}{{ n.role | upper }}{% endfor %};{% endif %}{% endfor %}", False, "SYSTEMUSERASSISTANTUSER;" * 2),
    ],
)
def test_templates(spark, template, prompt, want):
    df = spark.createDataFrame([(TALK,)], "messages array<struct<role:string,content:string>>")
    assert df.select(templates.chat_template(template, bos="<s>")(F.col("messages"), prompt)).first()[0] == want


def test_templates_that_are_refused(spark):
    for template, said in (("{{ x | tojson }}", "filter tojson"), ("{% macro a() %}", "block macro"), ("{% for m in messages %}", "before endfor"), ("{{ a b }}", "goes on"), ("{{ a == }}", "needs"), ("{{ a ! b }}", "cannot be read"), ("{% if x is odd %}{% endif %}", "is odd"), ("{{ (a }}", "needs")):
        with pytest.raises(ValueError, match=said):
            templates.chat_template(template)
    df = spark.createDataFrame([(TALK,)], "messages array<struct<role:string,content:string>>")
    with pytest.raises(Exception, match="no system"):
        df.select(templates.chat_template("{% if messages[0].role == 'system' %}{{ raise_exception('no system') }}{% endif %}")(F.col("messages"))).collect()
    assert df.limit(0).select(templates.chat_template("{{ messages | length }}")(F.col("messages"))).collect() == []


def test_tasks_describe_the_shards_that_they_write(tmp_path):
    """The driver only renames: what it does for a shard must not wait for the disk."""
    w = token_shards.Writer(SCHEMA, {"path": str(tmp_path / "set")}, False)
    message = w.write(iter(batch_of([(0, [1, 2]), (2, [3])])))
    beside = sorted((tmp_path / "set").glob(".shard_*_meta.json.*.tmp"))
    assert [json.loads(p.read_text())["shard_index"] for p in beside] == [0, 2]
    w.commit([message])
    assert {p.name for p in (tmp_path / "set").iterdir()} == {f"shard_{k:04d}{e}" for k in (0, 2) for e in (".bin", "_meta.json")}


def test_files_are_opened_by_many_tasks(spark, tmp_path, monkeypatch):
    """Tasks go by files, not by bytes: small ones must not all come to one task, nor each few to a task of their own."""
    write_shards(spark, tmp_path / "set", [10] * 12)
    (tmp_path / "set" / ".shard_0099.bin.tmp").write_bytes(b"half")
    found = validation.shard_files(spark, str(tmp_path / "set"))
    assert found.rdd.getNumPartitions() == 1 and sorted(map(tuple, found.collect())) == [(k, f"shard_{k:04d}.bin", 20) for k in range(12)]
    monkeypatch.setattr(token_shards, "TASK_FILES", 2)
    assert validation.shard_files(spark, str(tmp_path / "set")).rdd.getNumPartitions() > 4
    assert sorted(r["tokens"] for r in validation.shard_metadata(spark, str(tmp_path / "set")).collect()) == [10] * 12
    (tmp_path / "set" / "shard_0003_meta.json").write_text("{")
    with pytest.raises(Exception, match="(?i)malformed"):
        validation.shard_metadata(spark, str(tmp_path / "set")).collect()


def test_manifest_is_read_a_line_at_a_time(spark, tmp_path):
    write_shards(spark, tmp_path / "set", [10, 20])
    publication.publish(spark, str(tmp_path / "set"), str(tmp_path / "to"))
    text = (tmp_path / "to" / publication.MANIFEST).read_text()
    assert len(text.splitlines()) == 4 + 2
    rows = {r["name"]: (r["length"], r["sha256"]) for r in publication.manifest(spark, str(tmp_path / "to")).collect()}
    assert rows == {n: (a["length"], a["sha256"]) for n, a in json.loads(text).items()} and rows["shard_0001.bin"][0] == 40


def test_calls_to_the_tokenizer_are_bounded_by_size():
    """Few long texts are as much work for a call as many short ones."""
    assert list(T.runs(pa.array([5, 5, None, 30, 1, 1, 9]), 10)) == [(0, 3), (3, 4), (4, 6), (6, 7)]
    assert list(T.runs(pa.array([], pa.int32()), 10)) == []


def test_runs_are_dealt_to_tasks_by_their_samples(spark, monkeypatch):
    from tokenweir.operators import metrics

    rows = spark.range(1000).select((F.col("id") % 40).alias("run"), F.col("id").alias("seq"), F.col("id").alias("t"), F.col("id").alias("total"))
    monkeypatch.setattr(metrics, "TASK_ROWS", 50)
    dealt = metrics.dealt(rows, "run", 1000)
    assert dealt.rdd.getNumPartitions() == 20
    plan = metrics.rolling_rate(dealt, "run", "seq", "t", "total", 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Union" not in plan


def test_conversations_as_bytes_in_arrow(spark):
    rows = [(1, [("user", "hé"), ("assistant", "yo"), (None, "x"), ("assistant", None)]), (2, [("assistant", "")]), (3, [])]
    df = spark.createDataFrame(rows, TALKS).repartition(1)
    a, b = chat.encode(F.col("messages"), T.byte_ids), chat.encode_bytes(F.col("messages"))
    got = df.select(a[0].alias("i"), a[1].alias("t"), b[0].alias("i2"), b[1].alias("t2")).collect()
    assert all((r["i"], r["t"]) == (r["i2"], r["t2"]) for r in got) and len(got) == 3
    assert "_byte_pairs" in df.select(*b)._jdf.queryExecution().toString()


def test_files_in_turn(spark, tmp_path):
    """A stream takes files by their time, which follows the key though all are written at once."""
    from tokenweir.plans import storage

    storage._in_turn(spark.range(100).select(((F.col("id") * 37) % 100).alias("k")).repartition(3), "k", 6, str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files) > 4 and [x for p in files for x in pd.read_parquet(p)["k"]] == list(range(100))


def test_files_of_a_stream_grow_in_number(spark, data, monkeypatch):
    """More rows are more files, three batches all the same, and the same result."""
    from tokenweir.plans import storage

    seen = []
    real = ingest.ingest
    monkeypatch.setattr(ingest, "ingest", lambda *a: seen.append(a) or real(*a))
    want = storage.stream_pack_available_now(spark, data).collect()
    monkeypatch.setattr(storage, "FILE_BYTES", 20_000)
    assert storage.stream_pack_available_now(spark, data).collect() == want
    assert seen[0][-1] == 2 and seen[1][-1] > 4 and spark.read.parquet(seen[1][1]).rdd.getNumPartitions() > 0


def test_relay_deals_shards_by_their_size(spark, data, monkeypatch):
    from tokenweir.plans import storage

    want = sorted(storage.stream_shard_relay(spark, data).collect())
    monkeypatch.setattr(storage, "FILE_BYTES", 100_000)
    assert storage._files(7, 3) == 3 and sorted(storage.stream_shard_relay(spark, data).collect()) == want


def test_relay_leaves_only_what_it_returns(spark, data, monkeypatch):
    from tokenweir import session
    from tokenweir.plans import storage

    want = sorted(storage.stream_shard_relay(spark, data).collect())
    monkeypatch.setattr(storage, "FILE_BYTES", 100_000)
    with session.collecting([]) as own:
        got = storage.stream_shard_relay(spark, data)
    assert len(own) == 1 and all(own[0] in f for f in got.inputFiles())
    assert sorted(got.collect()) == want and not list(token_shards.local(own[0]).parent.glob("relay-*/*"))


def test_bytes_are_dealt_out_and_then_become_ids(spark):
    texts = ["né 中😀" * 9, "", None, "x" * 50, "é", "né 中😀"]
    placed = materialise(packing.place(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id", T.byte_count(F.col("text")) + 1), "placed")
    want = packing.pieces(placed, {"tokens": T.byte_arrays(258)(F.col("text"))}, 16).orderBy("shard", "first").collect()
    cut = packing.byte_pieces(placed, "text", 16)
    assert dict(cut.dtypes)["data"] == "binary"
    assert cut.repartition("shard").select("shard", "first", T.byte_pieces(258)("data", "ended").alias("tokens")).orderBy("shard", "first").collect() == want
    met = packing.met_pieces(cut.repartitionByRange(3, "shard"), ["data", "ended"])
    runs = met.select("shard", T.byte_runs(258)("parts.data", "parts.ended").alias("tokens"))
    assert {r["shard"]: r["tokens"] for r in runs.collect()} == {r["shard"]: r["tokens"] for r in packing.chunk_pieces(spark.createDataFrame(want), ["tokens"]).collect()}
    assert "hashpartitioning" not in runs._jdf.queryExecution().executedPlan().toString()
    assert cut.limit(0).select(T.byte_pieces(1)("data", "ended")).collect() == []


def test_shuffle_files_go_with_their_query(spark, data):
    from tokenweir.plans import storage
    from tokenweir.session import SHEDS

    def shuffled():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    before = shuffled()
    storage._written(spark, data)
    # what only counts rows may stay until the driver collects its garbage; that is a few hundred bytes for a task
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    sizes = [found.apply(k).length() for k in range(found.size()) if found.apply(k).getName() in shuffled() - before]
    assert sum(sizes) < 20_000 and spark.conf.get(SHEDS) == "false"


def test_shards_that_a_stream_has_read_are_deleted(spark, tmp_path, monkeypatch):
    folder = tmp_path / "s"
    want = write_shards(spark, folder, [5, 6, 7, 8])
    (folder / "other.bin").write_bytes(b"1")
    options = {"path": str(folder), "runs": "true", "cleanSource": "delete"}
    reader = token_shards.StreamReader(options)
    assert (reader.initialOffset(), reader.latestOffset()) == ({"next": 0}, {"next": 4})
    reader.commit({"next": 0})
    assert len(list(folder.glob("shard_*"))) == 8
    # stopped when it was written down which are to go, and before they did
    with monkeypatch.context() as m:
        m.setattr(token_shards.os, "scandir", lambda path: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            reader.commit({"next": 2})
    again = token_shards.StreamReader(options)
    assert (again.initialOffset(), again.latestOffset()) == ({"next": 2}, {"next": 4})
    again.commit({"next": 3})
    again.commit({"next": 2})
    assert sorted(p.name for p in folder.glob("[!_]*")) == ["other.bin", "shard_0003.bin", "shard_0003_meta.json"]
    got = [b.column("tokens")[0].as_py() for p in again.partitions({"next": 3}, again.latestOffset()) for b in again.read(p)]
    assert got == [want[3].tolist()]
    again.commit({"next": 4})
    # numbers go on, and a reader without the option deletes nothing
    writer = token_shards.StreamWriter(SCHEMA, {"path": str(folder)}, False)
    writer.commit([writer.write(iter(batch_of([(0, [1, 2])])))], 0)
    plain = token_shards.StreamReader({"path": str(folder)})
    assert plain.latestOffset() == {"next": 5}
    plain.commit({"next": 5})
    assert (folder / "shard_0004.bin").exists()


def test_paired_shards_are_deleted_behind_a_stream(spark, tmp_path):
    token_shards.register(spark)
    rows = [(k, [1, 2, k], [-1, 2, k]) for k in range(6)]
    spark.createDataFrame(rows, "shard int, tokens array<int>, targets array<int>").write.format("token_shards").option("path", str(tmp_path / "s")).option("prefix", "chat").mode("append").save()
    read = spark.readStream.format("token_shards").options(runs="true", paired="true", prefix="chat", cleanSource="delete").load(str(tmp_path / "s"))
    for last in (6, 9):
        read.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        more = [(k, [1, 2, k], [-1, 2, k]) for k in range(last, last + 3)]
        assert spark.read.parquet(str(tmp_path / "out")).count() == last
        spark.createDataFrame(more, "shard int, tokens array<int>, targets array<int>").write.format("token_shards").option("path", str(tmp_path / "s")).option("prefix", "chat").mode("append").save()
        rows += more
    left = {p.name for p in (tmp_path / "s").glob("chat_*")}
    assert {f"chat_{k:04d}_{e}" for k in range(6, 12) for e in ("inputs.bin", "targets.bin", "meta.json")} == left
    got = sorted((r["shard"], r["tokens"], r["targets"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(r for r in rows if r[0] < 9)


def test_relay_keeps_the_shards_of_a_few_turns(spark, data, monkeypatch):
    from tokenweir import session
    from tokenweir.plans import storage

    monkeypatch.setattr(storage, "FILE_BYTES", 200_000)
    monkeypatch.setattr(storage, "BATCH_FILES", 2)
    there, through = [], storage._through

    def seen(*writers):
        through(*writers)
        there.append(len(list(token_shards.local(session.shared_dir(spark)).glob("relay-*/set/*.bin"))))

    monkeypatch.setattr(storage, "_through", seen)
    n = storage.stream_shard_relay(spark, data).count()
    assert len(there) > 6 and n > 24 and max(there) <= n // 2


def test_streams_stop_together(spark, tmp_path):
    from tokenweir.plans import storage

    token_shards.register(spark)
    spark.range(3).selectExpr("int(id) AS shard", "array(70000) AS tokens").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("shard int, tokens array<int>").parquet(str(tmp_path / "in"))
    bad = stream.writeStream.format("token_shards").option("path", str(tmp_path / "set")).option("checkpointLocation", str(tmp_path / "a"))
    good = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "b"))
    with pytest.raises(Exception, match="16 bits"):
        storage._through(bad, good)
    assert not spark.streams.active

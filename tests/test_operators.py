import datetime
import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenweir.functions import scalars as S
from tokenweir.functions import tokenizers as T
from tokenweir.operators import chat, decoding, losses, metrics, packing, splits, validation
from tokenweir.sources import token_shards
from tokenweir.session import collecting, drop, materialise, scope, scratch
from tokenweir.streaming import ingest, reports


def shards(spark, *ranges):
    return spark.createDataFrame([(k, list(range(a, b))) for k, (a, b) in enumerate(ranges)], "shard int, tokens array<int>")


def test_windows_do_not_cross_shards(spark):
    got = packing.windows(shards(spark, (0, 13), (100, 113)), "tokens", 4).orderBy("shard", "window").collect()
    assert len(got) == 6
    assert got[2]["x"] == [8, 9, 10, 11] and got[3]["x"] == [100, 101, 102, 103]
    assert all(r["y"] == [v + 1 for v in r["x"]] for r in got)


def test_default_stride_and_bad_geometry(spark):
    got = packing.windows(shards(spark, (0, 17)), "tokens", 4).orderBy("window").collect()
    assert len(got) == 4 and got[-1]["y"] == [13, 14, 15, 16]
    for length, step in ((0, None), (-1, None), (4, 0), (4, -1)):
        with pytest.raises(ValueError, match="greater than zero"):
            packing.window_count(F.lit(10), length, step)


def test_short_shard_has_no_window(spark):
    assert spark.range(1).select(packing.window_count(F.lit(5), 8)).first()[0] == 0


def test_window_lookup(spark):
    offsets = packing.window_offsets(spark.createDataFrame([(0, 4), (1, 0), (2, 4)], "shard int, windows long"))
    got = {r["idx"]: (r["shard"], r["local"]) for r in packing.locate(spark.createDataFrame([(0,), (4,), (-1,)], "idx long"), offsets).collect()}
    assert got == {0: (0, 0), 4: (2, 0), -1: (2, 3)}
    with pytest.raises(Exception, match="out of range"):
        packing.locate(spark.createDataFrame([(8,)], "idx long"), offsets).collect()


def test_prefix_sum_over_parts(spark):
    rows = [(i, (i * 7) % 5) for i in range(200)]
    got = packing.prefix_sum(spark.createDataFrame(rows, "k long, n long").repartition(7), ["k"], "n").orderBy("k").collect()
    total = 0
    for r, (_, n) in zip(got, rows, strict=True):
        assert (r["start"], r["end"]) == (total, total + n)
        total += n


def test_split_rounds_half_even(spark):
    for n in (2, 3, 10, 30, 70):
        got = splits.shard_split(spark.range(n).withColumnRenamed("id", "shard")).where("split = 'train'").count()
        assert got == min(n - 1, max(1, round(0.95 * n)))
    assert splits.window_split(97, 8, 2) == (92, 96)


def test_epoch_order(spark):
    ids = spark.range(100).withColumnRenamed("id", "idx")
    one, two = ([r["idx"] for r in splits.epoch_order(ids, 42, e).orderBy("rank").collect()] for e in (0, 1))
    assert sorted(one) == list(range(100)) and one != two
    with pytest.raises(ValueError):
        splits.epoch_order(ids, 42, -1)
    want = np.arange(100)
    np.random.default_rng(45).shuffle(want)
    assert [r["idx"] for r in splits.exact_order(spark, 100, 42, 3).orderBy("rank").collect()] == want.tolist()


def test_positions_and_cursor(spark):
    epoch, batch = splits.data_position(F.col("s"), 1, 4)
    rows = spark.createDataFrame([(0,), (1,), (3,), (4,), (9,)], "s long").select("s", epoch.alias("e"), batch.alias("b")).orderBy("s").collect()
    assert [(r["e"], r["b"]) for r in rows] == [(0, 0), (0, 1), (0, 3), (1, 0), (2, 1)]
    got = splits.dev_cursor(spark.range(3).withColumnRenamed("id", "eval"), 2, 4).orderBy("eval", "slot").collect()
    assert [r["batch"] for r in got] == [0, 1, 2, 3, 0, 1]


def test_chat_masks(spark):
    m = [("user", "hé"), ("assistant", "yo")]
    df = spark.createDataFrame([(1, m)], "conv_id long, messages array<struct<role:string,content:string>>")
    inputs, targets = chat.encode(F.col("messages"), T.byte_ids)
    r = df.select(inputs.alias("i"), targets.alias("t"), chat.render(F.col("messages")).alias("text")).first()
    assert bytes(r["i"]).decode() == r["text"] == "<|im_start|>user\nhé<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert bytes(t for t in r["t"] if t != -1).decode() == "yo<|im_end|>\n"
    assert all(t in (-1, i) for i, t in zip(r["i"], r["t"], strict=True))
    turned = df.select(chat.inject_system(F.col("messages")).alias("a"), chat.inject_system(F.col("messages"), "be brief").alias("b")).first()
    assert turned["a"][0]["content"] == chat.SYSTEM and turned["b"][0]["content"] == "be brief"


def test_rolling_rate(spark):
    def rates(samples):
        df = spark.createDataFrame([(1, k, t * 1000, u) for k, (t, u) in enumerate(samples)], "run long, seq long, t long, total long")
        return [r["rate"] for r in metrics.rolling_rate(df, "run", "seq", "t", "total", 10_000).orderBy("seq").collect()]

    assert rates([(0, 100), (2, 140), (22, 240)]) == [0, 20, 5]
    assert rates([(0, 100), (2, 120), (3, 5)]) == [0, 10, 0]


def test_interval_average_and_carry(spark):
    rows = [(1, 1, 4.0, False), (1, 2, 2.0, False), (1, 3, 3.0, True), (1, 4, 5.0, False), (1, 5, 1.0, True), (1, 6, float("nan"), True)]
    df = spark.createDataFrame(rows, "run long, step long, loss double, is_eval boolean")
    got = {r["step"]: r["average"] for r in metrics.interval_average(df, "run", "step", "loss", "is_eval").collect()}
    assert got[3] == 3.0 and got[5] == 3.0 and math.isnan(got[6])


def test_rate_format(spark):
    values = [0.0, -1.0, float("nan"), float("inf"), 1500.0, 2.5e6, 3e9, 2150.0, 0.25, 999.95, 12.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(S.format_rate(F.col("v"), "x")).collect()]
    want = ["— x/s"] * 4 + ["1.5k x/s", "2.50M x/s", "3.00G x/s"] + [f"{2150 / 1e3:.1f}k x/s", f"{0.25:.1f} x/s", f"{999.95:.1f} x/s", "12.0 x/s"]
    assert got == want


def test_schedule_and_lists(spark):
    lr = S.wsd_rate(F.col("id"), 1e-2, 1e-3, 2, 10)
    got = {r["id"]: r["lr"] for r in spark.range(11).select("id", lr.alias("lr")).collect()}
    assert [round(got[k], 9) for k in (0, 2, 8, 10)] == [5e-3, 1e-2, 1e-2, 1e-3]
    df = spark.createDataFrame([(" arc_easy,hellaswag,arc_easy, ",)], "c string")
    assert df.select(S.parse_list(F.col("c"))).first()[0] == ["arc_easy", "hellaswag"]
    assert [S.normalize_limit(n) for n in (0, 1, 50)] == [None, 1, 50]
    with pytest.raises(ValueError):
        S.normalize_limit(-1)


def test_accuracy_preference(spark):
    rows = [("a", {"acc,none": 0.25, "acc_norm,none": 0.5}), ("b", {"acc_norm,none": 0.5}), ("c", {"acc": 0.75}), ("d", {"acc,none": 0.0}), ("e", {"exact_match": 1.0})]
    got = {r["task"]: r["accuracy"] for r in losses.accuracy_report(spark.createDataFrame(rows, "task string, metrics map<string,double>")).collect()}
    assert got == {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.0, "e": None, "macro_average": 0.375}


def logits(spark, values):
    return spark.createDataFrame([(0, t, float(v)) for t, v in enumerate(values)], "row long, tok long, logit double")


def history(spark, tokens):
    return spark.createDataFrame([(0, p, t) for p, t in enumerate(tokens)], "row long, pos long, tok long")


def kept(df):
    return sorted(r["tok"] for r in df.collect())


def test_decoding(spark):
    assert kept(decoding.top_k(logits(spark, [1, 4, 3, 2]), 2)) == [1, 2]
    assert kept(decoding.top_k(logits(spark, [1, 3, 3, 3]), 2)) == [1, 2, 3]
    got = {r["tok"]: r["logit"] for r in decoding.repetition_penalty(logits(spark, [1, 4, 3]), history(spark, [1, 1]), 2.0).collect()}
    assert got == {0: 1, 1: 2, 2: 3}
    assert kept(decoding.banned_tokens(history(spark, [1, 2, 3, 1, 2]), 3)) == [3]
    assert kept(decoding.banned_tokens(history(spark, [4, 5, 6, 4, 7]), 3)) == []
    assert kept(decoding.banned_tokens(history(spark, [4, 5, 4]), 1)) == [4, 5]
    assert kept(decoding.next_token(logits(spark, [0, 1, 2, 10]), history(spark, [1, 2, 3, 1, 2]), is_greedy=True, ngram=3)) == [2]
    assert kept(decoding.greedy(logits(spark, [0, 4, 4]))) == [1]
    p = [math.log(x) for x in (0.5, 0.3, 0.15, 0.05)]
    assert kept(decoding.nucleus(logits(spark, p), 0.6)) == [0, 1]
    assert kept(decoding.min_p(logits(spark, p), 0.25)) == [0, 1, 2]
    for name in ("temperature", "k", "p", "min_prob", "penalty", "ngram"):
        with pytest.raises(ValueError):
            decoding.next_token(logits(spark, p), history(spark, [0]), **{name: -1})


def test_masked_loss(spark):
    rows = [([0.1, 0.9, 0.3], t) for t in (0, 1, 2, 0, -1, -1)]
    df = spark.createDataFrame(rows, "e array<double>, y int").select(losses.cross_entropy(F.col("e"), F.col("y")).alias("nll"))
    lse = math.log(sum(math.exp(x) for x in (0.1, 0.9, 0.3)))
    got = losses.masked_loss(df).first()
    assert got["active"] == 4 and abs(got["loss"] - (4 * lse - 1.4) / 4) < 1e-12


def test_shard_files(spark, tmp_path):
    token_shards.register(spark)
    rows = [(0, [1, 2, 40000, 65535]), (1, [5, 6, 7, 8])]
    path = str(tmp_path / "s")
    spark.createDataFrame(rows, "shard int, tokens array<int>").write.format("token_shards").option("path", path).mode("append").save()
    back = spark.read.format("token_shards").load(path)
    assert [r["tok"] for r in back.where("shard = 0").orderBy("pos").collect()] == rows[0][1]
    state = {"schema_version": 1, "next_shard": 2, "shard_size_tokens": 4, "max_shards": 2, "committed_tokens": 8}
    validation.check_set(spark, path, state, publish=True)
    (tmp_path / "s" / "shard_0001.bin").write_bytes(b"xx")
    with pytest.raises(ValueError, match="invalid size"):
        validation.check_set(spark, path, state)
    with pytest.raises(Exception, match="16 bits"):
        spark.createDataFrame([(2, [70000])], "shard int, tokens array<int>").write.format("token_shards").option("path", path).mode("append").save()
    assert not (tmp_path / "s" / "shard_0002.bin").exists()


def test_paired_shards(spark, tmp_path):
    token_shards.register(spark)
    path = str(tmp_path / "p")
    spark.createDataFrame([(0, [1, 2, 3], [-1, 2, 3])], "shard int, tokens array<int>, targets array<int>").write.format("token_shards").option("path", path).mode("append").save()
    back = spark.read.format("token_shards").option("paired", "true").load(path).orderBy("pos").collect()
    assert [(r["tok"], r["target"]) for r in back] == [(1, -1), (2, 2), (3, 3)]
    about = json.loads((tmp_path / "p" / "shard_0000_meta.json").read_text())
    assert about["loss_tokens"] == 2 and about["loss_token_ratio"] == 0.6667
    (tmp_path / "p" / "shard_0000_targets.bin").write_bytes(b"\0" * 4)
    with pytest.raises(Exception, match="Mismatch"):
        spark.read.format("token_shards").option("paired", "true").load(path).collect()


def test_runs_and_split_shards(spark, tmp_path, monkeypatch):
    """A shard of many rows and several input partitions; runs hold the same ids as rows of one."""
    token_shards.register(spark)
    path = str(tmp_path / "r")
    ids = np.random.default_rng(1).integers(0, 65_536, 150_000)
    cuts = [0, 10, 10, 70_000, 149_999, 150_000]
    rows = [(3, a, ids[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)] + [(4, 0, []), (5, 0, [7])]
    df = packing.by_shard(spark.createDataFrame(rows, "shard int, first long, tokens array<int>").where("size(tokens) > 0 OR shard = 4"))
    df.write.format("token_shards").option("path", path).mode("append").save()
    assert np.fromfile(tmp_path / "r" / "shard_0003.bin", "<u2").tolist() == ids.tolist()
    assert json.loads((tmp_path / "r" / "shard_0003_meta.json").read_text())["tokens"] == 150_000
    monkeypatch.setattr(token_shards, "PARTITION_BYTES", 120_000)
    parts = token_shards.Reader({"path": path}).partitions()
    assert len(parts) == 3 and sum(x.high - x.low for p in parts for x in p.stretches) == 150_001
    runs = spark.read.format("token_shards").option("runs", "true").load(path).orderBy("shard", "first").collect()
    assert [t for r in runs if r["shard"] == 3 for t in r["tokens"]] == ids.tolist() and all(len(r["tokens"]) <= token_shards.RUN for r in runs)
    assert {r["shard"] for r in runs} == {3, 5} and spark.read.format("token_shards").load(path).count() == 150_001
    with pytest.raises(Exception, match="goes on at"):
        spark.createDataFrame([(6, 0, [1]), (6, 5, [2])], "shard int, first long, tokens array<int>").coalesce(1).write.format("token_shards").option("path", path).mode("append").save()
    with pytest.raises(Exception, match="do not come together"):
        spark.createDataFrame([(6, [1]), (7, [2]), (6, [2])], "shard int, tokens array<int>").coalesce(1).write.format("token_shards").option("path", path).mode("append").save()
    with pytest.raises(ValueError, match="mounted"):
        token_shards.local("s3a://bucket/x")


def test_paired_set_for_publication(spark, tmp_path):
    token_shards.register(spark)
    path, columns = str(tmp_path / "q"), "shard int, tokens array<int>, targets array<int>"
    spark.createDataFrame([(k, [1, 2, 3, 4], [-1, 2, 3, 4]) for k in range(2)], columns).write.format("token_shards").option("path", path).mode("append").save()
    state = {"next_shard": 2, "shard_size_tokens": 4, "max_shards": 2, "committed_tokens": 8}
    validation.check_set(spark, path, state, publish=True, paired=True)
    with pytest.raises(ValueError, match="incomplete"):
        validation.check_set(spark, path, state | {"next_shard": 1}, publish=True, paired=True)
    (tmp_path / "q" / "shard_0001_targets.bin").write_bytes(b"xx")
    with pytest.raises(ValueError, match="0001: targets shard has an invalid size"):
        validation.check_set(spark, path, state, publish=True, paired=True)
    (tmp_path / "q" / "shard_0000_inputs.bin").unlink()
    with pytest.raises(ValueError, match="0000: inputs shard is missing"):
        validation.check_set(spark, path, state, paired=True)


def test_checkpoint_config(spark, tmp_path):
    defaults, path = {"n_layer": 12, "n_head": 8}, tmp_path / "training_state.json"
    path.write_text(json.dumps({"step": 12, "model_config": {"n_layer": 4}}))
    config, state = validation.checkpoint_config(spark, str(tmp_path), defaults)
    assert config == {"n_layer": 4, "n_head": 8} and state["step"] == 12
    path.write_text(json.dumps({"step": 12}))
    with pytest.warns(RuntimeWarning, match="no saved model_config"):
        assert validation.checkpoint_config(spark, str(tmp_path), defaults)[0] == defaults
    path.write_text(json.dumps({"model_config": {"n_layers": 4}}))
    with pytest.raises(ValueError, match="n_layers"):
        validation.checkpoint_config(spark, str(tmp_path), defaults)


def test_bounds_and_divisibility():
    assert S.task_names(" arc_easy,hellaswag,arc_easy, ") == ["arc_easy", "hellaswag"]
    with pytest.raises(ValueError, match="at least one"):
        S.task_names(" , ")
    for target, start in ((0, 0), (-1, 0), (10, -1), (10, 11)):
        with pytest.raises(ValueError):
            metrics.check_bounds(target, start)
    metrics.check_bounds(10, 10)
    splits.check_split(1, 1)
    for train, dev in ((0, 1), (1, 0)):
        with pytest.raises(ValueError, match="too little"):
            splits.check_split(train, dev)
    splits.check_accumulation(8, 4)
    with pytest.raises(ValueError, match="divisible"):
        splits.check_accumulation(9, 4)


def test_vocabulary_and_special_ids(spark):
    assert T.special_ids(5) == {"eos": 5, "bos": None, "pad": 5, "im_start": 0, "im_end": 0}
    assert T.special_ids(5, 6, 7, 8, 9) == {"eos": 5, "bos": 7, "pad": 6, "im_start": 8, "im_end": 9}
    for size, eos in ((None, 1), (70_000, 1), (100, None)):
        with pytest.raises(ValueError):
            T.check_vocabulary(size, eos)
    import public_tokenizers

    byte, file = T.tokenizer("bytes"), T.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([("Hé, <|endoftext|> you",), ("",)], "t string")
    for t in (byte, file):
        assert [r[0] for r in df.select(t.text(t.ids(F.col("t")))).collect()] == ["Hé, <|endoftext|> you", ""]
    assert byte.special["eos"] == 258 and byte.special["im_start"] == 256 and file.special == {"eos": 50256, "bos": None, "pad": 50256, "im_start": 0, "im_end": 0}
    assert spark.range(1).select(S.shard_name("chat", F.col("id"))).first()[0] == "chat_0000"


def test_bpe_counts_equal_the_library(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tokenweir.plans import catalog

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in catalog.QUERIES["bpe_token_counts"](spark, data).collect()} == want


def test_skip_first(spark):
    rows = spark.createDataFrame([(k, "x") for k in (5, 3, 9, 1, 7)], "k long, more string").repartition(3)
    assert sorted(r["k"] for r in packing.skip_first(rows, ["k"], 2).collect()) == [5, 7, 9] and packing.skip_first(rows, ["k"], 9).count() == 0


def test_ranks_and_random_split(spark):
    rows = spark.range(300).withColumnRenamed("id", "window").withColumn("more", F.lit("x"))
    got = splits.random_split(rows, 25, 42)
    assert got.columns == ["window", "more", "split"] and got.where("split = 'dev'").count() == 25 and got.count() == 300


def test_rolling_rate_equals_a_scan(spark):
    rng = np.random.default_rng(2)
    rows, seq = [], 0
    for run in range(4):
        total = 0
        for _ in range(120):
            seq, total = seq + 1, max(0, total + int(rng.integers(-1, 6)))
            rows.append((run, seq, int(rng.integers(0, 3000)) if run else seq * 37, total))
    got = {r["seq"]: r["rate"] for r in metrics.rolling_rate(spark.createDataFrame(rows, "run long, seq long, t long, total long"), "run", "seq", "t", "total", 500).collect()}
    for run in range(4):
        own, segment, before = [r for r in rows if r[0] == run], [], None
        for r in own:
            segment.append(segment[-1] + (r[3] < before[3]) if segment else 0)
            before = r
        for k, (_, seq, t, u) in enumerate(own):
            same = [i for i in range(len(own)) if segment[i] == segment[k]]
            first = min(i for i in same if t - 500 <= own[i][2] <= t)
            first = max([i for i in same if i < k], default=first) if first == k else first
            passed = (t - own[first][2]) / 1000
            assert got[seq] == pytest.approx(max(0.0, (u - own[first][3]) / passed) if passed > 0 else 0.0)


def test_reports(spark, tmp_path):
    path = str(tmp_path / "nested" / "results.json")
    for value in (0.25, 0.5):
        reports.write_report(spark, path, reports.evaluation_results({"results": {"arc_easy": {"acc,none": value, "at": datetime.date(2026, 1, 2)}}, "ignored": 1}))
    assert json.loads((tmp_path / "nested" / "results.json").read_text()) == {"arc_easy": {"acc,none": 0.5, "at": "2026-01-02"}}
    assert not [p for p in (tmp_path / "nested").iterdir() if p.name.endswith(".tmp")]


def test_run_identity():
    now = datetime.datetime(2026, 1, 2, 3, 4, 5)
    assert reports.run_identity({"run_id": "a", "run_name": "b"}, "sft", "continue", now) == {"id": "a", "resume": "must", "name": "b"}
    assert reports.run_identity({"run_id": "a"}, "sft", "fresh", now) == {"name": "20260102-030405-sft", "resume": "never"}
    assert reports.run_identity(None, "pretrain", "continue", now) == {"name": "20260102-030405-pretrain", "resume": "allow"}


def test_progress_listener(spark, tmp_path):
    spark.range(30).write.parquet(str(tmp_path / "in"))
    seen = reports.Progress()
    spark.streams.addListener(seen)
    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if seen.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert sum(n for _, _, n, _ in seen.seen) == 30 and len(seen.ended) == 1


def test_scopes_own_their_tables(spark):
    """A scope drops its own tables and no others; nothing of it is left."""
    import os

    kept = materialise(spark.range(5), "kept")
    with scope(spark) as own:
        lost = materialise(spark.range(6), "lost")
        assert lost.count() == 6
        folder = token_shards.local(own[0])
        inner: list[str] = []
        with collecting(inner):
            other = materialise(spark.range(7), "other")
            scratch(spark, "never-written")
    assert not os.path.exists(folder) and kept.count() == 5 and other.count() == 7 and len(inner) == 2
    drop(spark, inner)
    assert inner == [] and kept.count() == 5


def test_state_checks():
    good = {"schema_version": 1, "shard_size_tokens": 8, "max_shards": 2, "pending_tokens": 4, "next_shard": 2, "committed_tokens": 16}
    validation.check_state(good, {"max_shards": 2}, True, 4)
    for state, expected, outputs, pending, said in ((None, {}, True, None, "without"), (good | {"schema_version": 999}, {}, True, 4, "version"), (good, {"max_shards": 3}, True, 4, "mismatch"), (good, {}, True, None, "missing")):
        with pytest.raises(ValueError, match=said):
            validation.check_state(state, expected, outputs, pending)
    validation.check_state(good, {}, True, (4, 4))
    with pytest.raises(ValueError, match="missing"):
        validation.check_state(good, {}, True, (4, 3))
    assert validation.is_complete(good) and not validation.is_complete(good | {"max_shards": 3}) and not validation.is_complete(good | {"max_shards": None})


def test_stream_resumes_exactly(spark, tmp_path):
    docs = [(i, "x" * (i % 9)) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(docs[k * 20 : (k + 1) * 20], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sink = ingest.PackingSink(str(tmp_path / "out"), 32, T.byte_ids, 258)
        state = ingest.ingest(spark, str(tmp_path / "in"), "doc_id long, text string", sink, str(tmp_path / "cp"), 1)
    stream = [t for _, text in docs for t in [*text.encode(), 258]]
    got = np.concatenate([np.fromfile(p, "<u2") for p in sorted((tmp_path / "out").glob("shard_*.bin"))])
    assert got.tolist() == stream[: len(stream) // 32 * 32]
    assert state["pending_tokens"] == len(stream) % 32 and state["source_documents_consumed"] == 60
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.endswith(".tmp")]
    assert len(list((tmp_path / "out").glob("pending-*"))) <= 1
    batch = spark.createDataFrame(docs[:5], "doc_id long, text string")
    ingest.PackingSink(str(tmp_path / "out"), 32, T.byte_ids, 258)(batch, state["batch"])
    assert sink.state() == state
    with pytest.raises(ValueError, match="mismatch"):
        ingest.PackingSink(str(tmp_path / "out"), 64, T.byte_ids, 258)


def test_run_names(spark):
    df = spark.createDataFrame([(datetime.datetime(2026, 1, 2, 3, 4, 5),)], "t timestamp_ntz")
    assert df.select(S.run_name("sft", F.col("t"))).first()[0] == "20260102-030405-sft"

"""Queries of files, streams and plug-ins. They write to a folder of their own; the files' readers are what is queried."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import LongType

from ..functions import tokenizers as T
from ..operators import chat, choices, fetch, packing, splits, validation
from ..session import bound_batches, load, materialise, scope, scratch, shedding
from ..sources import publication, token_shards
from ..streaming import ingest, rates, reports, summary
from . import catalog
from .catalog import SHARD, query

EOS = T.BYTE_SPECIALS[T.EOS]
BYTES_SQL = f"WITH n AS (SELECT sum(strlen(coalesce(text, '')) + 1)::BIGINT AS t FROM documents), s AS (SELECT unnest(range(0, t // {SHARD})) AS shard FROM n)"
#: The stream of ids, a row each: the bytes of every text, then the end id.
IDS_SQL = f"""
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, sum(n + 1) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n - 1 AS start FROM b),
u AS (SELECT start, n, h, unnest(range(0, n + 1)) AS i FROM o),
i AS (SELECT (start + i) // {SHARD} AS shard, (start + i) % {SHARD} AS pos, CASE WHEN i = n THEN {EOS} ELSE ('0x' || substr(h, 2 * i + 1, 2))::INT END AS tok FROM u)
"""


def _byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all full shards, as bytes: ``_ids`` is for when they have been dealt out."""
    bound_batches(spark)
    path = scratch(spark, "placed")
    with shedding(spark), scope(spark):
        placed = packing.place(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", T.byte_count(F.col("text")) + 1)
        placed.select("text", "start", "end").write.option("compression", "zstd").parquet(path)
    placed = spark.read.schema("text string, start long, end long").parquet(path)
    full = placed.agg(F.coalesce(F.floor(F.max("end") / SHARD), F.lit(0)).alias("n")).first()["n"]
    cut = packing.byte_pieces(placed, "text", SHARD)
    return cut.where(F.col("shard") < full).withColumn("shard", F.col("shard").cast("int"))


def _ids(cut: DataFrame) -> DataFrame:
    """The pieces with their ids."""
    return cut.select("shard", "first", T.byte_pieces(EOS)("data", "ended").alias("tokens"))


@F.arrow_udf(LongType())
def run_checksum(tokens: pa.Array, first: pa.Array) -> pa.Array:
    """The sum of each run's ids, weighted by their places."""
    sizes = pa.compute.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    ids, ends = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(sizes)
    places = np.repeat(first.to_numpy(zero_copy_only=False) - (ends - sizes), sizes) + np.arange(len(ids))
    sums = np.concatenate([[0], np.cumsum(ids * (places % 1009 + 1))])
    return pa.array(sums[ends] - sums[ends - sizes])


def _written(spark: SparkSession, sf_dir: str) -> str:
    token_shards.register(spark)
    folder = scratch(spark, "shards")
    with shedding(spark), scope(spark):
        _ids(packing.by_shard(_byte_shards(spark, sf_dir))).write.format("token_shards").option("path", folder).mode("append").save()
    return folder


@query(f"{BYTES_SQL}, {IDS_SQL} SELECT shard::INT AS shard, count(*) AS n, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last, sum(tok * (pos % 1009 + 1))::BIGINT AS checksum FROM i JOIN s USING (shard) GROUP BY shard")
def shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards written as files and read back in runs; the checksum is one of ids and their places."""
    read = spark.read.format("token_shards").option("runs", "true").load(_written(spark, sf_dir))
    runs = read.select("shard", F.col("first").alias("low"), F.size("tokens").cast("long").alias("size"), run_checksum("tokens", "first").alias("own"))
    return runs.groupBy("shard").agg(F.sum("size").alias("n"), F.min("low").alias("first"), F.max(F.col("low") + F.col("size") - 1).alias("last"), F.sum("own").alias("checksum"))


@query(BYTES_SQL + f" SELECT shard, {2 * SHARD}::BIGINT AS length, {SHARD}::BIGINT AS tokens, 'uint16' AS dtype FROM s")
def shard_file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir)
    files, meta = validation.shard_files(spark, folder), validation.shard_metadata(spark, folder)
    return files.select("shard", "length").join(meta.select("shard", "tokens", "dtype"), "shard", "full_outer")


#: Of every shard, the places that a slice takes.
SLICE_LOW, SLICE_HIGH = 4000, 4064


@query(f"{BYTES_SQL}, {IDS_SQL} SELECT shard::INT AS shard, pos::BIGINT AS pos, tok FROM i JOIN s USING (shard) WHERE pos >= {SLICE_LOW} AND pos < {SLICE_HIGH}")
def shard_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of every shard: the filter reaches the source as byte ranges, so that no other part of a file is mapped."""
    read = spark.read.format("token_shards").load(_written(spark, sf_dir))
    return read.where((F.col("pos") >= SLICE_LOW) & (F.col("pos") < SLICE_HIGH)).select("shard", "pos", "tok")


WINDOW_SQL = f"""
l AS (SELECT shard, list(tok ORDER BY pos) AS w FROM i JOIN s USING (shard) GROUP BY shard),
k AS (SELECT shard, w, unnest(range(0, {(SHARD - catalog.LENGTH - 1) // catalog.LENGTH + 1})) AS "local" FROM l),
v AS (SELECT (shard * {(SHARD - catalog.LENGTH - 1) // catalog.LENGTH + 1} + "local")::BIGINT AS idx, md5(array_to_string(w["local" * {catalog.LENGTH} + 1 : "local" * {catalog.LENGTH} + {catalog.LENGTH}], ' ')) AS x, md5(array_to_string(w["local" * {catalog.LENGTH} + 2 : "local" * {catalog.LENGTH} + {catalog.LENGTH + 1}], ' ')) AS y FROM k),
r AS (SELECT idx, x, y, row_number() OVER (ORDER BY md5('{catalog.SEED + 3}-' || idx), idx) - 1 AS rank, count(*) OVER () AS n FROM v)
"""


@query(f"{BYTES_SQL}, {IDS_SQL}, {WINDOW_SQL} SELECT rank // {catalog.BATCH} AS batch, rank, idx, x, y FROM r WHERE rank // {catalog.BATCH} < n // {catalog.BATCH}")
def train_batch_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of an epoch with their tokens: windows of written shards in shuffled order, the last batch dropped if not full."""
    folder = _written(spark, sf_dir)
    n = fetch.windows_of(spark, folder, catalog.LENGTH).agg(F.coalesce(F.max("end_window"), F.lit(0))).first()[0]
    order = splits.batches(splits.epoch_order(spark.range(n).withColumnRenamed("id", "idx"), catalog.SEED, 3), catalog.BATCH, drop_last=True)
    text = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), " ")).alias(c)
    return fetch.fetch(order, folder, catalog.LENGTH).select("batch", "rank", "idx", text("x"), text("y"))


@query("SELECT shard, problem FROM (VALUES (1, 'shard is missing'), (2, 'shard has an invalid size'), (3, 'metadata is missing'), (4, 'metadata is invalid'), (6, 'shard is missing'), (6, 'metadata is missing')) AS v(shard, problem)")
def shard_meta_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliberate damage to a described set, and what the check finds."""
    ids = spark.range(6).withColumnRenamed("id", "shard")
    files = ids.where("shard <> 1").select("shard", F.when(F.col("shard") == 2, 10).otherwise(16).cast("long").alias("length"))
    meta = ids.where("shard <> 3").select("shard", F.when(F.col("shard") == 4, 7).otherwise(F.col("shard")).cast("long").alias("shard_index"), F.lit(8).cast("long").alias("tokens"), F.lit("uint16").alias("dtype"), F.lit(None).cast("string").alias("inputs_dtype"))
    return validation.violations(spark, files, meta, 7, 8)


@query("SELECT ['transformer.h.9.bias'] AS missing, ['lm_head.extra'] AS unexpected")
def key_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([("transformer.wte.weight",), ("lm_head.extra",)], "key string")
    return validation.check_keys(keys, ["transformer.wte.weight", "lm_head.weight", "transformer.h.9.bias"], ("transformer.wte.weight", "lm_head.weight"))


def _paired(spark: SparkSession, sf_dir: str) -> str:
    """The conversations as full paired shards."""
    token_shards.register(spark)
    placed = packing.place(catalog._chat_ids(spark, sf_dir), "conv_id", F.size("inputs"))
    full = placed.agg(F.coalesce(F.floor(F.max("end") / SHARD), F.lit(0)).alias("n")).first()["n"]
    cut = packing.pieces(placed, {"inputs": F.col("inputs"), "targets": F.col("targets")}, SHARD)
    cut = cut.where(F.col("shard") < full).select(F.col("shard").cast("int").alias("shard"), "first", F.col("inputs").alias("tokens"), "targets")
    folder = scratch(spark, "paired")
    packing.by_shard(cut).write.format("token_shards").option("path", folder).option("prefix", "chat").mode("append").save()
    return folder


@query(catalog.ORACLES["sft_shard_loss_ratio"])
def paired_shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired shards written as files, checked as for publication, and what describes them."""
    folder = _paired(spark, sf_dir)
    meta = validation.shard_metadata(spark, folder)
    n = meta.count()
    validation.check_set(spark, folder, {"next_shard": n, "shard_size_tokens": SHARD, "max_shards": n, "committed_tokens": n * SHARD}, publish=True, paired=True)
    return meta.select("shard", "tokens", "loss_tokens", "loss_token_ratio")


@query(f"WITH c AS (SELECT count(*) AS n FROM ({catalog.ORACLES['sft_shard_loss_ratio']})) SELECT kind, n AS files, n * {SHARD} * width AS bytes FROM c, (VALUES ('inputs', 2), ('targets', 4), ('meta', 0)) AS v(kind, width) WHERE n > 0")
def publication_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a paired set is published, by kind, and the bytes of ids and targets."""
    files = validation.publishable(spark, _paired(spark, sf_dir), "chat")
    return files.groupBy("kind").agg(F.count("*").alias("files"), F.sum(F.when(F.col("kind") != "meta", F.col("length")).otherwise(0)).alias("bytes"))


@query(f"{BYTES_SQL} SELECT count(*) AS files, (count(*) * {2 * SHARD})::BIGINT AS bytes FROM s")
def shard_set_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of a set, from the listing alone."""
    return validation.shard_files(spark, _written(spark, sf_dir)).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


@query()
def bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bound_batches(spark)
    count = T.bpe_count(public_tokenizers.path("word_bpe_49k.json"))
    return T.spread(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", count(F.col("text")).alias("n_tokens"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def bpe_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through the ids of a byte-level vocabulary and back."""
    import public_tokenizers

    bound_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = T.spread(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.bpe_ids(path)(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.md5(T.bpe_text(path)(F.col("ids"))).alias("digest"))


@query("SELECT conv_id, turn, role, strlen(coalesce(text, ''))::BIGINT AS n_bytes, turn % 2 = 0 AS even FROM conversations")
def json_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines of JSON and back."""
    turns = load(spark, sf_dir, "conversations")
    line = F.to_json(F.struct("conv_id", "turn", F.struct("role", "text").alias("message"), (F.col("turn") % 2 == 0).alias("even")))
    kind = "conv_id long, turn long, message struct<role:string,text:string>, even boolean"
    back = turns.select(F.from_json(line, kind).alias("j"))
    types = dict(turns.dtypes)
    return back.select(*[F.col(f"j.{c}").cast(types[c]).alias(c) for c in ("conv_id", "turn")], "j.message.role", F.octet_length(F.coalesce("j.message.text", F.lit(""))).cast("long").alias("n_bytes"), "j.even")


@query(catalog.ORACLES["validation_perplexity"])
def validation_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation report as a file, and what it says."""
    path = f"{scratch(spark, 'report')}/validation.json"
    rows = catalog.validation_perplexity(spark, sf_dir).collect()  # a row for each kind of run
    reports.write_report(spark, path, [r.asDict() for r in rows])
    return spark.read.schema("kind string, loss double, tokens long, perplexity double").option("multiLine", True).json(path)


def _event_stream(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    base = scratch(spark, "events")
    events = load(spark, sf_dir, "events")
    events.write.parquet(f"{base}/in")
    return base, spark.readStream.schema(events.schema).parquet(f"{base}/in")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last, count(DISTINCT user_id) AS runs FROM events GROUP BY event_type")
def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream into a JSON log of metrics by kind, and the log read back."""
    base, stream = _event_stream(spark, sf_dir)
    reports.log_metrics(stream.select("event_type", "event_id", "user_id", "value"), f"{base}/log", f"{base}/checkpoint", ["event_type"]).awaitTermination()
    log = spark.read.schema("event_id long, user_id long, value double, event_type string").json(f"{base}/log")
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.countDistinct("user_id").alias("runs"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 70 MINUTE <= (SELECT max(ts) FROM events)")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows of a stream: those that the watermark has closed, once each."""
    base, stream = _event_stream(spark, sf_dir)
    closed = ingest.windowed_counts(stream).select(F.col("window.start").alias("start"), "event_type", "n", "total")
    closed.writeStream.format("parquet").option("path", f"{base}/windows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    out = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{base}/windows")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"SELECT count(*) // 1 AS documents, (sum(strlen(coalesce(text, '')) + 1) // {SHARD})::BIGINT AS shards, (sum(strlen(coalesce(text, '')) + 1) % {SHARD})::BIGINT AS pending FROM documents")
def stream_pack_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files, packed with exact resume."""
    bound_batches(spark)
    base = scratch(spark, "stream")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(T.byte_count(F.col("text"))), F.lit(0))).first()[0]
    files = 2 * _files(size, 6 * FILE_BYTES)  # of each batch
    docs.repartitionByRange(3 * files, "doc_id").write.parquet(f"{base}/in")
    sink = ingest.PackingSink(f"{base}/out", SHARD, T.byte_arrays(), EOS)
    state = ingest.ingest(spark, f"{base}/in", "doc_id long, text string", sink, f"{base}/checkpoint", files)
    return spark.createDataFrame([(state["source_documents_consumed"], state["next_shard"], state["pending_tokens"])], "documents long, shards long, pending long")


@query(f"{BYTES_SQL}, {IDS_SQL} SELECT count(*) AS n, md5(string_agg(tok, ' ' ORDER BY pos)) AS digest FROM i JOIN s USING (shard) GROUP BY shard")
def stream_shard_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards as a stream into the sink, a few files to a batch, and out of the source into a table. The streams take turns of a batch,
    one reads what the other has written the turn before, and what has gone through is deleted behind them: no more than the shards
    of a few batches are on disk."""
    token_shards.register(spark)
    out = scratch(spark, "relayed")
    with scope(spark):
        base = scratch(spark, "relay")
        with shedding(spark), scope(spark):
            cut = _byte_shards(spark, sf_dir)
            last = cut.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
            files = 2 * _files(4 * SHARD * last, 6 * FILE_BYTES)  # of a third
            # pieces meet where they are dealt to, so that they move once
            met = packing.met_pieces(cut.repartitionByRange(3 * files, "shard"), ["data", "ended"])
            met.select("shard", T.byte_runs(EOS)("parts.data", "parts.ended").alias("tokens")).write.option("compression", "zstd").parquet(f"{base}/cut")
        stream = spark.readStream.schema("shard int, tokens array<int>").option("cleanSource", "delete").parquet(_folder(spark, f"{base}/in"))
        to = stream.writeStream.format("token_shards").option("path", f"{base}/set").option("checkpointLocation", f"{base}/to")
        read = spark.readStream.format("token_shards").option("runs", "true").option("cleanSource", "delete").load(_folder(spark, f"{base}/set"))
        back = read.writeStream.format("parquet").option("compression", "zstd").option("path", out).option("checkpointLocation", f"{base}/from")
        for _ in _fed(spark, f"{base}/cut", f"{base}/in", min(files, BATCH_FILES)):
            _through(to, back)
        _through(back)
    runs = spark.read.schema("shard int, first long, tokens array<int>").parquet(out)  # a run for each shard of this size
    return runs.select(F.size("tokens").cast("long").alias("n"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), " ")).alias("digest"))


#: Bytes of rows of a file of a stream, about.
FILE_BYTES = 64 << 20
#: Such files of a turn at most, where what a turn leaves on disk is not to grow with the stream.
BATCH_FILES = 8
#: Samples of such a file, about.
FILE_ROWS = 500_000


def _files(size: int, most: int) -> int:
    """Files of a share of a stream, so that they grow in number and not in size."""
    return max(1, -(-size // most))


def _folder(spark: SparkSession, folder: str) -> str:
    """The folder, made if it is not there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def _parts(spark: SparkSession, folder: str) -> tuple:
    """The file system of a folder, and the data files in it by name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, sorted((f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())


def _fed(spark: SparkSession, source: str, folder: str, n: int) -> Iterator[int]:
    """Hands files over to the folder of a stream, ``n`` at a time; yields how many there are when they are there."""
    fs, found = _parts(spark, source)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    for k in range(0, len(found), n):
        for p in found[k : k + n]:
            if not fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to, p.getName())):
                raise OSError(f"{p.toString()} can't be handed over")
        yield len(found[k : k + n])


def _through(*writers: DataStreamWriter) -> None:
    """Streams side by side, each with what is there for it now."""
    started: list[StreamingQuery] = []
    try:
        for w in writers:
            started.append(w.trigger(availableNow=True).start())
        for q in started:
            q.awaitTermination()
    finally:
        for q in started:
            q.stop()


def _in_turn(rows: DataFrame, key: str, parts: int, folder: str) -> None:
    """Files of a stream in the order of a key, as they would come: a stream takes them by their time. All are written at once, by as
    many tasks, and get times a second apart after that, so that a batch of any number of files is behind those before it."""
    spark = rows.sparkSession
    rows.repartitionByRange(parts, key).sortWithinPartitions(key).write.parquet(folder)
    fs, found = _parts(spark, folder)
    now = int(time.time() * 1000)
    for k, p in enumerate(found):
        fs.setTimes(p, now - 1000 * (len(found) - k), -1)


@query(catalog.ORACLES["sft_shard_loss_ratio"])
def stream_chat_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a stream of files into paired shards, stopped and taken up again between files."""
    base = scratch(spark, "chat")
    bound_batches(spark)
    talks = materialise(catalog._messages(spark, sf_dir).where(F.size("messages") > 0), "talks")
    size = talks.agg(F.coalesce(F.sum(F.octet_length(chat.render(F.col("messages")))), F.lit(0))).first()[0]
    files = _files(size, 4 * FILE_BYTES)  # of each batch
    _in_turn(talks, "conv_id", 4 * files, f"{base}/in")
    sink = ingest.PairedSink(f"{base}/out", SHARD, T.byte_ids, encode=chat.encode_bytes)
    ingest.ingest(spark, f"{base}/in", talks.schema.simpleString()[7:-1].replace(":", " ", 1).replace(",messages:", ", messages "), sink, f"{base}/checkpoint", files)
    return validation.shard_metadata(spark, f"{base}/out").select("shard", "tokens", "loss_tokens", "loss_token_ratio")


@query(f"WITH {catalog.RATE_SQL} SELECT user_id AS run, event_id AS seq, round(elapsed::DOUBLE, 3) AS elapsed, round(rate::DOUBLE, 9) AS rate, FALSE AS late FROM r")
def stream_rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as a stream of files, rated as they come; a run's state goes over from batch to batch."""
    base = scratch(spark, "rates")
    samples = catalog._counter(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), "t", F.col("total").cast("double").alias("total"))
    files = _files(load(spark, sf_dir, "events").count(), 3 * FILE_ROWS)  # of each batch
    samples = materialise(samples, "samples")
    _in_turn(samples, "seq", 3 * files, f"{base}/in")
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    out = rates.rolling_rate(stream, 86_400_000)
    out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    rows = spark.read.schema(rates.SCHEMA).parquet(f"{base}/out")
    return rows.select("run", "seq", F.round("elapsed", 3).alias("elapsed"), F.round("rate", 9).alias("rate"), "late")


CHOICES_SQL = f"""
t AS (SELECT item_id, {catalog.WORDS_SQL} AS w FROM benchmark),
p AS (SELECT item_id, item_id % 3 AS gold, array_to_string(w[: (len(w) // 2)::INT], ' ') || ' ' AS prompt, w[(len(w) // 2)::INT + 1 :] AS rest FROM t),
v AS (SELECT item_id, gold, prompt, k, array_to_string(CASE (k - gold + 3) % 3 WHEN 0 THEN rest WHEN 1 THEN list_reverse(rest) ELSE list_sort(rest) END, ' ') AS text FROM p, (SELECT unnest(range(0, 3)) AS k)),
b AS (SELECT item_id, gold, k, strlen(text) AS n_bytes, strlen(prompt) AS start, hex(encode(prompt || text)) AS h FROM v),
s AS (SELECT item_id, gold, k, n_bytes, coalesce(list_sum(list_transform(range(start, start + n_bytes), lambda i: -((('0x' || substr(h, (2 * i - 1)::INT, 2))::BIGINT * 31 + ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT) % 97 + 1) / 16.0::DOUBLE)), 0) AS score FROM b),
a AS (SELECT item_id, any_value(gold) AS gold, arg_max(k, row(score, -k)) AS raw, arg_max(k, row(score / greatest(1, n_bytes), -k)) AS norm FROM s GROUP BY item_id),
m AS (SELECT 'task' || (item_id % 4) AS task, count(*) AS items, avg((raw = gold)::INT) AS acc, avg((norm = gold)::INT) AS acc_norm FROM a GROUP BY 1)
"""


def _choice_score(ids: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A stand-in for a model that SQL can state: each id's score depends on the one before."""
    each = -((np.concatenate([[0], ids[:-1]]).astype(np.int64) * 31 + ids) % 97 + 1) / 16.0
    sums = np.concatenate([[0.0], np.cumsum(each)])
    before = np.concatenate([[0], ends[:-1]])
    return sums[ends] - sums[before + starts]


@query(f"WITH {CHOICES_SQL} SELECT task, items, acc, acc_norm FROM m UNION ALL SELECT 'macro_average', sum(items)::BIGINT, avg(acc), NULL FROM m")
def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's second half as it is, turned round and sorted: which of the three goes on from the first half."""
    words = load(spark, sf_dir, "benchmark").select("item_id", T.words(F.col("text")).alias("w"), (F.col("item_id") % 3).alias("gold"))
    half = F.floor(F.size("w") / 2).cast("int")
    rest = F.slice("w", half + 1, F.size("w") - half)
    texts = F.array(*[F.array_join(x, " ") for x in (rest, F.reverse(rest), F.array_sort(rest))])
    turned = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get(texts, ((k - F.col("gold") + 3) % 3).cast("int")))
    tasks = words.select(F.concat(F.lit("task"), F.col("item_id") % 4).alias("task"), F.col("item_id").alias("item"), F.concat(F.array_join(F.slice("w", F.lit(1), half), " "), F.lit(" ")).alias("prompt"), turned.alias("choices"), "gold")
    found = choices.evaluate(tasks, T.byte_arrays(), _choice_score).cache()  # a row for each task
    own = found.select("task", "items", F.col("metrics")["acc,none"].alias("acc"), F.col("metrics")["acc_norm,none"].alias("acc_norm"))
    mean = choices.report(found).where("task = 'macro_average'").crossJoin(found.agg(F.sum("items").alias("items")))
    return own.unionByName(mean.select("task", "items", F.col("accuracy").alias("acc"), F.lit(None).cast("double").alias("acc_norm")))


@query(f"{BYTES_SQL} SELECT printf('shard_%04d.bin', shard) AS name, {2 * SHARD}::BIGINT AS length, 0::BIGINT AS again FROM s")
def publication_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set that is published, published again without a copy, and what its manifest says of the shards."""
    target = scratch(spark, "published")
    folder = _written(spark, sf_dir)
    publication.publish(spark, folder, target)
    again, _ = publication.publish(spark, folder, target)
    entries = publication.manifest(spark, target)
    return entries.where(F.col("name").endswith(".bin")).select("name", "length", F.lit(again).cast("long").alias("again"))


#: What of each metric a summary keeps; the rest keep their last value.
FOLDS = {"purchase": "max", "error": "min"}


@query("SELECT user_id AS run, event_type AS name, CASE event_type WHEN 'purchase' THEN max(value) WHEN 'error' THEN min(value) ELSE arg_max(value, event_id) END AS value FROM events GROUP BY user_id, event_type")
def run_summary_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files into the summaries of their runs, a map for each run."""
    base = scratch(spark, "summary")
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("name"), "value")
    events.repartitionByRange(3, F.col("step") % 101).write.parquet(f"{base}/in")
    store = summary.SummaryStore(spark, f"{base}/store", FOLDS)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return store.read().select("run", F.explode("summary").alias("name", "value"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.windowed_counts(load(spark, sf_dir, "events"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def score(rows: DataFrame, model) -> DataFrame:
    """Plug-in for models: ``model`` maps a batch, its values one behind the other and where each row ends, to a loss for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            ends = np.cumsum(pa.compute.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(model(x.flatten().to_numpy(zero_copy_only=False), ends), pa.float64())], ["row", "loss"])

    return rows.select("row", "x").mapInArrow(run, "row long, loss double")


def _squares(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return np.bincount(rows, np.square(values.astype(np.float64)), len(ends))


@query("SELECT vec_id AS row, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS loss FROM embeddings")
def model_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("x"))
    return score(rows, _squares).withColumn("loss", F.round("loss", 6))


assert catalog.QUERIES

"""All queries over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tokenizers as T
from ..operators import chat, decoding, losses, metrics, packing, splits, templates
from ..session import load, materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Geometry of the registered queries: tokens of a shard, tokens of a window, seed.
SHARD, LENGTH, SEED = 8192, 128, 1337


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n]+'), lambda x: x <> '')"
OFFSETS_SQL = f"""
tok AS (SELECT doc_id, list_append({WORDS_SQL}, '<eos>') AS w FROM documents),
off AS (SELECT doc_id, len(w) AS n, (sum(len(w)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - len(w))::BIGINT AS start, (sum(len(w)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS "end" FROM tok)
"""
STREAM_SQL = OFFSETS_SQL + """, pos AS (SELECT off.start + u.i - 1 AS pos, u.t FROM off JOIN (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM tok) u USING (doc_id))"""
WINDOWS_SQL = f"greatest(0, floor((tokens - {LENGTH + 1}) / {LENGTH})::BIGINT + 1)"
SHARDS_SQL = OFFSETS_SQL + f""", span AS (SELECT *, unnest(range(start // {SHARD}, ("end" - 1) // {SHARD} + 1)) AS shard FROM off),
sh AS (SELECT shard, sum(least("end", (shard + 1) * {SHARD}) - greatest(start, shard * {SHARD}))::BIGINT AS tokens, count(*) AS docs FROM span GROUP BY shard),
win AS (SELECT *, tokens = {SHARD} AS is_full, {WINDOWS_SQL} AS windows FROM sh)
"""


def _tokens() -> F.Column:
    return T.with_eos(T.words(F.col("text")))


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.doc_offsets(load(spark, sf_dir, "documents"), _tokens())


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.shard_totals(_offsets(spark, sf_dir), SHARD, LENGTH)


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.chunks(packing.place(docs, "doc_id", F.size(_tokens())), {"tokens": _tokens()}, SHARD)


@query(f"SELECT doc_id, len({WORDS_SQL}) AS n_words, strlen(coalesce(text, '')) AS n_bytes, len({WORDS_SQL}) + 1 AS n_with_eos FROM documents")
def doc_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.words(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"), T.byte_count(F.col("text")).alias("n_bytes"), F.size(T.with_eos(words)).cast("long").alias("n_with_eos"))


@query(f"WITH {OFFSETS_SQL} SELECT doc_id, n, start, \"end\" FROM off")
def doc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offsets(spark, sf_dir).select("doc_id", "n", "start", "end")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r > n // 3")
def scan_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a scan has still to read once it has read a third."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return packing.skip_first(docs, ["doc_id"], docs.count() // 3)


@query("SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents WHERE doc_id > (SELECT max(doc_id) // 2 FROM documents)")
def scan_after_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents behind the key that a scan has come to; files and row groups before it are not read."""
    docs = load(spark, sf_dir, "documents")
    last = docs.agg(F.floor(F.max("doc_id") / 2)).first()[0]  # from the files' statistics
    return packing.after(docs, "doc_id", last).select("doc_id", "source", T.byte_count(F.col("text")).alias("n_bytes"))


@query(f"WITH {SHARDS_SQL} SELECT shard, printf('shard_%04d', shard) AS name FROM win")
def shard_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).select("shard", S.shard_name("shard", F.col("shard")).alias("name"))


@query(f"WITH {SHARDS_SQL} SELECT shard, tokens, docs, is_full, windows FROM win")
def shard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir)


@query(f"WITH {STREAM_SQL} SELECT pos // {SHARD} AS shard, count(*) AS n, md5(string_agg(t, ' ' ORDER BY pos)) AS digest FROM pos GROUP BY 1")
def shard_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shards(spark, sf_dir).select("shard", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(f"WITH {OFFSETS_SQL} SELECT least(max(\"end\") // {SHARD}, 40) AS next_shard, least(max(\"end\") // {SHARD}, 40) * {SHARD} AS committed_tokens, max(\"end\") - least(max(\"end\") // {SHARD}, 40) * {SHARD} AS pending_tokens, count(*) AS source_documents_consumed FROM off")
def pending_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.tail(_offsets(spark, sf_dir), SHARD, 40)


@query(f"WITH {SHARDS_SQL} SELECT shard, windows, (sum(windows) OVER (ORDER BY shard))::BIGINT - windows AS first_window, (sum(windows) OVER (ORDER BY shard))::BIGINT AS end_window FROM win")
def shard_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.window_offsets(_totals(spark, sf_dir).select("shard", "windows"))


#: All windows of the documents, in a table of one row.
COUNT_SQL = f"WITH {SHARDS_SQL}, n AS (SELECT coalesce(sum(windows), 0)::BIGINT AS n FROM win)"
BATCH, ACCUMULATION = 16, 4


def _window_total(spark: SparkSession, sf_dir: str) -> int:
    return _totals(spark, sf_dir).agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]


def _indices(spark: SparkSession, sf_dir: str, column: str = "idx") -> DataFrame:
    return spark.range(_window_total(spark, sf_dir)).withColumnRenamed("id", column)


@query(f"{COUNT_SQL}, o AS (SELECT shard, sum(windows) OVER (ORDER BY shard) - windows AS a, sum(windows) OVER (ORDER BY shard) AS b FROM win), i AS (SELECT unnest(range(-n, n)) AS idx FROM n), r AS (SELECT idx, CASE WHEN idx < 0 THEN idx + (SELECT max(b) FROM o) ELSE idx END AS j FROM i) SELECT idx, shard, (j - a)::BIGINT AS local FROM r JOIN o ON j >= a AND j < b")
def window_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window by its index, from the front and from the end."""
    offsets = packing.window_offsets(materialise(_totals(spark, sf_dir).select("shard", "windows"), "totals"))
    n = offsets.agg(F.coalesce(F.max("end_window"), F.lit(0))).first()[0]
    return packing.locate(spark.range(-n, n).withColumnRenamed("id", "idx"), offsets)


@query(f"WITH {STREAM_SQL}, s AS (SELECT pos // {SHARD} AS shard, list(t ORDER BY pos) AS w FROM pos GROUP BY 1), k AS (SELECT *, unnest(range(0, greatest(0, floor((len(w) - {LENGTH + 1}) / {LENGTH})::BIGINT + 1))) AS \"window\" FROM s) SELECT shard, \"window\", md5(array_to_string(w[\"window\" * {LENGTH} + 1 : \"window\" * {LENGTH} + {LENGTH}], ' ')) AS x, md5(array_to_string(w[\"window\" * {LENGTH} + 2 : \"window\" * {LENGTH} + {LENGTH + 1}], ' ')) AS y FROM k")
def token_windows_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.windows(_shards(spark, sf_dir), "tokens", LENGTH)
    return out.select("shard", "window", F.md5(F.array_join("x", " ")).alias("x"), F.md5(F.array_join("y", " ")).alias("y"))


@query(f"WITH {SHARDS_SQL} SELECT shard, CASE WHEN row_number() OVER (ORDER BY shard) <= least((SELECT count(*) FROM win) - 1, greatest(1, round_even(0.95::DOUBLE * (SELECT count(*) FROM win), 0))) THEN 'train' ELSE 'dev' END AS split FROM win")
def train_dev_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.shard_split(_totals(spark, sf_dir).select("shard"))


@query(f"WITH {OFFSETS_SQL}, t AS (SELECT max(\"end\") AS tokens FROM off), n AS (SELECT floor((tokens - {LENGTH + 1}) / 64)::BIGINT + 1 AS n FROM t), w AS (SELECT n, unnest(range(0, n)) AS \"window\" FROM n) SELECT \"window\", CASE WHEN \"window\" < floor(0.95::DOUBLE * n) THEN 'train' ELSE 'dev' END AS split FROM w WHERE \"window\" < floor(0.95::DOUBLE * n) OR \"window\" >= floor(0.95::DOUBLE * n) + 2")
def single_shard_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _offsets(spark, sf_dir).agg(packing.window_count(F.max("end"), LENGTH, 64).alias("n")).first()["n"]
    train, dev = splits.window_split(total, LENGTH, 64)
    splits.check_split(train, total - dev)
    w = F.col("window")
    return spark.range(total).withColumnRenamed("id", "window").where((w < train) | (w >= dev)).withColumn("split", F.when(w < train, "train").otherwise("dev"))


@query(f"WITH {SHARDS_SQL} SELECT shard, CASE WHEN row_number() OVER (ORDER BY shard DESC) <= greatest(1, floor((SELECT count(*) FROM win) * 0.05::DOUBLE)) THEN 'dev' ELSE 'train' END AS split FROM win")
def sft_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.tail_split(_totals(spark, sf_dir).select("shard"), 0.05)


@query(f"{COUNT_SQL} SELECT w AS \"window\", CASE WHEN row_number() OVER (ORDER BY md5('42-' || w), w) <= greatest(1, n // 20) THEN 'dev' ELSE 'train' END AS split FROM (SELECT unnest(range(0, n)) AS w, n FROM n)")
def sft_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _window_total(spark, sf_dir)
    return splits.random_split(spark.range(n).withColumnRenamed("id", "window"), max(1, n // 20))


ORDER_SQL = f"{COUNT_SQL}, i AS (SELECT unnest(range(0, n)) AS idx, n FROM n), r AS (SELECT idx, row_number() OVER (ORDER BY md5('{SEED + 3}-' || idx), idx) - 1 AS rank, n FROM i)"


@query(f"{ORDER_SQL} SELECT idx, rank FROM r")
def epoch_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.epoch_order(_indices(spark, sf_dir), SEED, 3)


@query()
def epoch_permutation_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.exact_order(spark, _window_total(spark, sf_dir), SEED, 3)


@query(f"{ORDER_SQL} SELECT idx, rank, rank // {BATCH} AS batch FROM r WHERE rank // {BATCH} < n // {BATCH}")
def train_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.batches(epoch_permutation(spark, sf_dir), BATCH, drop_last=True)


@query(f"{COUNT_SQL} SELECT idx, idx AS rank, idx // {BATCH} AS batch FROM (SELECT unnest(range(0, n)) AS idx FROM n)")
def dev_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.batches(_indices(spark, sf_dir).withColumn("rank", F.col("idx")), BATCH, drop_last=False)


def _per_epoch(windows: int) -> int:
    """Batches of an epoch that make whole steps."""
    batches = max(ACCUMULATION, windows // BATCH // ACCUMULATION * ACCUMULATION)
    splits.check_accumulation(batches, ACCUMULATION)
    return batches


EPOCH_SQL = f"greatest({ACCUMULATION}, n // {BATCH} // {ACCUMULATION} * {ACCUMULATION})"


@query(f"{COUNT_SQL}, e AS (SELECT {EPOCH_SQL} AS k FROM n), s AS (SELECT unnest(range(0, k)) AS s, k FROM e) SELECT s AS step, (s * {ACCUMULATION}) // k AS epoch, (s * {ACCUMULATION}) % k AS batch FROM s")
def resume_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each step of the first epochs goes on."""
    n = _per_epoch(_window_total(spark, sf_dir))
    epoch, batch = splits.data_position(F.col("id"), ACCUMULATION, n)
    return spark.range(n).select(F.col("id").alias("step"), epoch.alias("epoch"), batch.alias("batch"))


@query(f"{ORDER_SQL} SELECT idx, rank, rank // {BATCH} AS batch FROM r WHERE rank // {BATCH} < n // {BATCH} AND rank // {BATCH} >= n // {BATCH} * 3 // 5")
def resumed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of an epoch three fifths through."""
    done = _window_total(spark, sf_dir) // BATCH * 3 // 5
    return train_batches(spark, sf_dir).where(F.col("batch") >= done)


@query(f"{COUNT_SQL}, t AS (SELECT greatest(1, (n + {BATCH - 1}) // {BATCH}) AS t FROM n) SELECT e AS eval, s AS slot, (e * least(20, t) + s) % t AS batch FROM (SELECT unnest(range(0, t)) AS e, t FROM t) JOIN (SELECT unnest(range(0, 20)) AS s) ON s < t")
def dev_cursor_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = max(1, -(-_window_total(spark, sf_dir) // BATCH))
    return splits.dev_cursor(spark.range(total).withColumnRenamed("id", "eval"), 20, total).select("eval", F.col("slot").cast("long").alias("slot"), "batch")


TURNS_SQL = f"""
firsts AS (SELECT conv_id, arg_min(role, turn) AS r FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, -1, 'system', '{chat.SYSTEM}' FROM firsts WHERE r <> 'system'),
x AS (SELECT *, '<|im_start|>' || role || chr(10) AS header, text || '<|im_end|>' || chr(10) AS body FROM t)
"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(load(spark, sf_dir, "conversations")).withColumn("messages", chat.inject_system(F.col("messages")))


def _chat_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, targets = chat.encode_bytes(F.col("messages"))
    return _messages(spark, sf_dir).where(F.size("messages") > 0).select("conv_id", inputs.alias("inputs"), targets.alias("targets"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, count(*) AS turns, string_agg(header || body, '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS text FROM x GROUP BY conv_id")
def chatml_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", F.size("messages").cast("long").alias("turns"), chat.render(F.col("messages"), True).alias("text"))


#: Templates with marks of different kinds: a tag before each turn, and turns of the user in brackets.
TAGGED = """{% for message in messages %}
{{ '<|' + message['role'] + '|>' }}
{{ message['content'] | trim }}{{ eos_token }}
{% endfor %}
{% if add_generation_prompt %}
<|assistant|>
{% endif %}"""
BRACKETS = """{{ bos_token }}{%- for message in messages -%}
{%- if message.role == 'user' -%}{{ '[INST] ' ~ message.content ~ ' [/INST]' }}
{%- elif message.role == 'assistant' -%}{{ ' ' + message.content + eos_token }}
{%- else -%}{{ '<<' + (message.role | upper) + '>> ' + message.content + ' ' }}{%- endif -%}
{%- if loop.last and not message.role == 'assistant' -%}{{ ' ' }}{%- endif -%}{%- endfor -%}"""
TRIM_SQL = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(f"WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, turn = max(turn) OVER (PARTITION BY conv_id) AS final FROM conversations) SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || {TRIM_SQL} || '</s>' || chr(10), '' ORDER BY turn) || '<|assistant|>' || chr(10) AS tagged, '<s>' || string_agg(CASE role WHEN 'user' THEN '[INST] ' || text || ' [/INST]' WHEN 'assistant' THEN ' ' || text || '</s>' ELSE '<<' || upper(role) || '>> ' || text || ' ' END || CASE WHEN final AND role <> 'assistant' THEN ' ' ELSE '' END, '' ORDER BY turn) AS brackets FROM c GROUP BY conv_id")
def chat_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations through two templates, compiled to expressions."""
    tagged, brackets = (templates.chat_template(t, bos_token="<s>", eos_token="</s>") for t in (TAGGED, BRACKETS))
    talks = chat.conversations(load(spark, sf_dir, "conversations"))
    return talks.select("conv_id", tagged(F.col("messages"), True).alias("tagged"), brackets(F.col("messages")).alias("brackets"))


PROMPT = "Keep to what the text says."


@query(f"WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT DISTINCT conv_id, -1, 'system', '{PROMPT}' FROM conversations) SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'system') AS system_turns, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS digest FROM t GROUP BY conv_id")
def chatml_given_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A system prompt that is given goes first in every conversation, also before a system turn of its own."""
    talks = chat.conversations(load(spark, sf_dir, "conversations")).withColumn("messages", chat.inject_system(F.col("messages"), PROMPT))
    return talks.select("conv_id", F.size("messages").cast("long").alias("turns"), F.size(F.filter("messages", lambda m: m["role"] == "system")).cast("long").alias("system_turns"), F.md5(chat.render(F.col("messages"))).alias("digest"))


@query(f"WITH {TURNS_SQL} SELECT conv_id, sum(strlen(header) + strlen(body))::BIGINT AS tokens, sum(CASE WHEN role = 'assistant' THEN strlen(body) ELSE 0 END)::BIGINT AS loss_tokens, md5(string_agg(header || body, '' ORDER BY turn)) AS inputs, md5(string_agg(CASE WHEN role = 'assistant' THEN repeat('_', strlen(header)) || body ELSE repeat('_', strlen(header) + strlen(body)) END, '' ORDER BY turn)) AS targets FROM x GROUP BY conv_id")
def chat_loss_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.md5(F.unhex(F.array_join(F.transform(c, lambda b: F.lpad(F.hex(F.when(b < 0, F.lit(95)).otherwise(b)), 2, "0")), "")))
    return _chat_ids(spark, sf_dir).select("conv_id", F.size("inputs").cast("long").alias("tokens"), F.size(F.filter("targets", lambda t: t != chat.MASKED)).cast("long").alias("loss_tokens"), text(F.col("inputs")).alias("inputs"), text(F.col("targets")).alias("targets"))


@query(f"WITH {TURNS_SQL}, p AS (SELECT role, conv_id, turn, 'h' AS k, strlen(header) AS n FROM x UNION ALL SELECT role, conv_id, turn, 't', strlen(body) FROM x), q AS (SELECT *, sum(n) OVER (ORDER BY conv_id, turn, k ROWS UNBOUNDED PRECEDING) AS e FROM p), r AS (SELECT *, unnest(range(((e - n) // {SHARD})::BIGINT, ((e - 1) // {SHARD})::BIGINT + 1)) AS shard FROM q WHERE n > 0), u AS (SELECT shard, sum(least(e, (shard + 1) * {SHARD}) - greatest(e - n, shard * {SHARD}))::BIGINT AS tokens, sum(CASE WHEN role = 'assistant' AND k = 't' THEN least(e, (shard + 1) * {SHARD}) - greatest(e - n, shard * {SHARD}) ELSE 0 END)::BIGINT AS loss_tokens FROM r GROUP BY shard) SELECT *, round_even(loss_tokens::DOUBLE / tokens, 4) AS loss_token_ratio FROM u WHERE tokens = {SHARD}")
def sft_shard_loss_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.place(_chat_ids(spark, sf_dir), "conv_id", F.size("inputs"))
    shards = packing.chunks(placed, {"inputs": F.col("inputs"), "targets": F.col("targets")}, SHARD)
    return chat.loss_stats(shards).where(F.col("tokens") == SHARD)


def _sft_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.place(_chat_ids(spark, sf_dir), "conv_id", F.size("inputs"))
    shards = packing.chunks(placed, {"inputs": F.col("inputs"), "targets": F.col("targets")}, SHARD)
    return packing.windows(shards, "inputs", LENGTH, target="targets")


@query(f"WITH {TURNS_SQL}, s AS (SELECT (sum(strlen(header) + strlen(body)))::BIGINT AS n FROM x), h AS (SELECT unnest(range(0, (n - 1) // {SHARD} + 1)) AS shard, n FROM s), c AS (SELECT shard, least(n, (shard + 1) * {SHARD}) - shard * {SHARD} AS tokens FROM h) SELECT shard, greatest(0, floor((tokens - 1) / {LENGTH})::BIGINT) AS windows FROM c WHERE tokens > {LENGTH}")
def sft_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sft_windows(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("windows"))


RATE_SQL = """
e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t, (sum(CASE WHEN event_id % 97 = 0 THEN -5 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS total FROM events),
g AS (SELECT *, sum(CASE WHEN total < lag_total THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS seg FROM (SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY event_id) AS lag_total FROM e)),
a AS (SELECT *, min(row(event_id, t, total)) OVER (PARTITION BY user_id, seg ORDER BY t RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS f, lag(row(event_id, t, total)) OVER (PARTITION BY user_id, seg ORDER BY event_id) AS b FROM g),
c AS (SELECT user_id, event_id, t, total, CASE WHEN struct_extract(f, 1) = event_id THEN coalesce(b, f) ELSE f END AS k FROM a),
r AS (SELECT user_id, event_id, total, (t - struct_extract(k, 2)) / 1000.0 AS elapsed, CASE WHEN t > struct_extract(k, 2) THEN greatest(0.0, (total - struct_extract(k, 3)) / ((t - struct_extract(k, 2)) / 1000.0)) ELSE 0.0 END AS rate FROM c)
"""


def _counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    step = F.when(F.col("event_id") % 97 == 0, -5).otherwise(1)
    e = metrics.dealt(e, "user_id", e.count())  # a count of files' rows
    return e.withColumn("total", F.sum(step).over(Window.partitionBy("user_id").orderBy("event_id")))


@query(f"WITH {RATE_SQL} SELECT user_id, event_id, round(elapsed::DOUBLE, 3) AS elapsed, round(rate::DOUBLE, 9) AS rate, CASE WHEN rate > 0 THEN floor((1000 - total) / rate)::BIGINT ELSE 0 END AS eta FROM r")
def rolling_event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = metrics.rolling_rate(_counter(spark, sf_dir), "user_id", "event_id", "t", "total", 86_400_000)
    return rated.select("user_id", "event_id", F.round("elapsed", 3).alias("elapsed"), F.round("rate", 9).alias("rate"), metrics.eta(F.lit(1000) - F.col("total"), F.col("rate")).alias("eta"))


@query(f"WITH {RATE_SQL}, v AS (SELECT user_id, event_id, total, coalesce(lag(total) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS previous FROM e) SELECT user_id, event_id, total, previous FROM v WHERE total < previous OR total - previous <> 1")
def counter_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counter(spark, sf_dir).withColumn("added", F.lit(1))
    return metrics.counter_violations(c, "user_id", "event_id", "total", "added").select("user_id", "event_id", "total", "previous")


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("loss"), (F.col("event_id") % 11 == 0).alias("is_eval"))


LOSS_SQL = "l AS (SELECT user_id, event_id, CASE WHEN event_id % 13 = 0 THEN 'nan'::DOUBLE ELSE value END AS loss, event_id % 11 = 0 AS is_eval FROM events)"


@query(f"WITH {LOSS_SQL}, i AS (SELECT *, coalesce(sum(is_eval::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM l) SELECT user_id, max(event_id) FILTER (is_eval) AS step, round(coalesce(avg(loss) FILTER (isfinite(loss)), max(loss) FILTER (is_eval)), 6) AS average FROM i GROUP BY user_id, k HAVING max(event_id) FILTER (is_eval) IS NOT NULL")
def interval_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.interval_average(_losses(spark, sf_dir), "user_id", "event_id", "loss", "is_eval").select("user_id", "step", F.round("average", 6).alias("average"))


@query(f"WITH {LOSS_SQL} SELECT user_id, event_id, last_value(CASE WHEN is_eval AND isfinite(loss) THEN loss END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS dev_loss FROM l")
def carry_forward_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _losses(spark, sf_dir).withColumn("dev", F.when(F.col("is_eval") & S.is_finite(F.col("loss")), F.col("loss")))
    return metrics.carry_forward(rows, "user_id", "event_id", "dev", "dev_loss").select("user_id", "event_id", "dev_loss")


@query("SELECT user_id, event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.running_best(load(spark, sf_dir, "events"), "user_id", "event_id", "value", "best").select("user_id", "event_id", "best")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS last, min(value) AS min, max(value) AS max, count(*) AS n FROM events GROUP BY user_id, event_type")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.run_summary(load(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "value")


@query("SELECT user_id, count(*) AS units, (max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) / 1000.0::DOUBLE AS elapsed, CASE WHEN max(ts) > min(ts) THEN round(count(*) / ((max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) / 1000.0::DOUBLE), 9) ELSE 0.0 END AS per_second FROM events GROUP BY user_id")
def run_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", F.lit(1).alias("u"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return metrics.throughput(e, "user_id", "u", "t").withColumn("per_second", F.round("per_second", 9))


@query("SELECT event_id, CASE WHEN value IS NULL OR isnan(r) OR isinf(r) OR r <= 0 THEN '—' WHEN r >= 1e9 THEN printf('%.2fG', r / 1e9) WHEN r >= 1e6 THEN printf('%.2fM', r / 1e6) WHEN r >= 1e3 THEN printf('%.1fk', r / 1e3) ELSE printf('%.1f', r) END || ' tok/s' AS text FROM (SELECT event_id, value, floor(value) * power(10, event_id % 9) * CASE WHEN event_id % 17 = 0 THEN -1 ELSE 1 END AS r FROM events)")
def rate_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.floor("value") * F.pow(F.lit(10.0), F.col("event_id") % 9) * F.when(F.col("event_id") % 17 == 0, -1).otherwise(1)
    return load(spark, sf_dir, "events").select("event_id", S.format_rate(rate, "tok").alias("text"))


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') || '-pretrain' AS name FROM events")
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", S.run_name("pretrain", F.col("ts")).alias("name"))


@query("SELECT s AS step, round(CASE WHEN s < 200 THEN 6e-4 * (s + 1) / 200 WHEN s < 4000 THEN 6e-4 ELSE 6e-5 + (1 - (s - 4000) / 1000.0) * (6e-4 - 6e-5) END::DOUBLE, 12) AS lr, round(0.04 * (CASE WHEN s < 200 THEN 6e-4 * (s + 1) / 200 WHEN s < 4000 THEN 6e-4 ELSE 6e-5 + (1 - (s - 4000) / 1000.0) * (6e-4 - 6e-5) END) / 6e-4::DOUBLE, 10) AS muon_lr, s * 65536 AS tokens, round(100.0::DOUBLE * s / 5000, 6) AS progress FROM (SELECT unnest(range(0, 5001)) AS s)")
def wsd_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    lr = S.wsd_rate(F.col("id"), 6e-4, 6e-5, 200, 5000)
    return spark.range(5001).select(F.col("id").alias("step"), F.round(lr, 12).alias("lr"), F.round(0.04 * lr / 6e-4, 10).alias("muon_lr"), (F.col("id") * S.tokens_per_step(BATCH, ACCUMULATION, 1024)).alias("tokens"), F.round(100.0 * F.col("id") / 5000, 6).alias("progress"))


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("tok", "x")).select("row", F.col("tok").cast("long").alias("tok"), F.col("x").cast("double").alias("logit"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"))
    return rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos")).select("row", F.col("pos").cast("long").alias("pos"), ((F.col("pos") * F.col("pos") + F.col("row")) % 7).cast("long").alias("tok"))


LOGITS_SQL = """
lg AS (SELECT vec_id AS row, generate_subscripts(embedding, 1) - 1 AS tok, unnest(embedding)::DOUBLE AS logit FROM embeddings),
hist AS (SELECT vec_id AS row, p AS pos, (p * p + vec_id) % 7 AS tok FROM embeddings, (SELECT unnest(range(0, 12)) AS p)),
sm AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY row)) / sum(exp(logit - m)) OVER (PARTITION BY row) AS p FROM (SELECT *, max(logit) OVER (PARTITION BY row) AS m FROM lg))
"""


@query(f"WITH {LOGITS_SQL}, c AS (SELECT row, tok, 2 * tanh(logit / 2) AS logit FROM lg), e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY row)) AS e FROM c) SELECT row, tok, round(logit, 6) AS logit, round(e / sum(e) OVER (PARTITION BY row), 6) AS p FROM e")
def softmax_softcap(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = _logits(spark, sf_dir).withColumn("logit", S.soft_cap(F.col("logit"), 2.0))
    return losses.softmax(capped).select("row", "tok", F.round("logit", 6).alias("logit"), F.round("p", 6).alias("p"))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("vec_id") % 3 == 0, F.lit(losses.IGNORED)).otherwise(F.col("vec_id") % 64)
    return load(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("seq"), target.alias("y"), (F.col("vec_id") % 64).alias("full_y"), "embedding")


NLL_SQL = """
z AS (SELECT vec_id, vec_id // 10 AS seq, vec_id % 64 AS fy, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE vec_id % 64 END AS y, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ll AS (SELECT seq, y, list_max(e) + ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))) - e[fy + 1] AS nll FROM z)
"""


@query(f"WITH {NLL_SQL} SELECT seq, round(avg(nll), 6) AS loss, count(*) AS tokens FROM ll GROUP BY seq")
def sequence_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _positions(spark, sf_dir).select("seq", losses.cross_entropy(F.col("embedding"), F.col("full_y")).alias("nll"))
    return losses.sequence_loss(p).withColumn("loss", F.round("loss", 6))


@query(f"WITH {NLL_SQL} SELECT round(coalesce(sum(nll) FILTER (y <> -1), 0), 4) AS loss_sum, count(*) FILTER (y <> -1) AS active, round(coalesce(sum(nll) FILTER (y <> -1), 0) / greatest(1, count(*) FILTER (y <> -1)), 6) AS loss FROM ll")
def masked_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _positions(spark, sf_dir).select("seq", losses.cross_entropy(F.col("embedding"), F.col("y")).alias("nll"))
    return losses.masked_loss(p).select(F.round("loss_sum", 4).alias("loss_sum"), "active", F.round("loss", 6).alias("loss"))


@query(f"WITH {NLL_SQL}, s AS (SELECT seq, avg(nll) AS l, count(*) AS n FROM ll GROUP BY seq) SELECT 'pretrain' AS kind, round(sum(l) / count(*), 6) AS loss, sum(n)::BIGINT AS tokens, round(exp(sum(l) / count(*)), 4) AS perplexity FROM s UNION ALL SELECT 'sft', round(sum(nll) / count(*), 6), count(*), round(exp(sum(nll) / count(*)), 4) FROM ll WHERE y <> -1")
def validation_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _positions(spark, sf_dir)
    full = losses.validation_report(p.select("seq", losses.cross_entropy(F.col("embedding"), F.col("full_y")).alias("nll")), weighted=False).withColumn("kind", F.lit("pretrain"))
    masked = losses.validation_report(p.select("seq", losses.cross_entropy(F.col("embedding"), F.col("y")).alias("nll")), weighted=True).withColumn("kind", F.lit("sft"))
    return full.unionByName(masked).select("kind", F.round("loss", 6).alias("loss"), "tokens", F.round("perplexity", 4).alias("perplexity"))


@query(f"WITH {NLL_SQL}, b AS (SELECT seq // 4 AS batch, avg(nll) FILTER (y <> -1) AS l, count(*) AS n FROM ll GROUP BY 1) SELECT round(sum(l * n) / sum(n), 6) AS dev_loss, sum(n)::BIGINT AS tokens FROM b")
def sampled_dev_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _positions(spark, sf_dir).select(F.floor(F.col("seq") / 4).alias("batch"), losses.cross_entropy(F.col("embedding"), F.col("y")).alias("nll"))
    batches = p.groupBy("batch").agg(F.avg("nll").alias("loss"), F.count("*").alias("tokens"))
    return losses.sampled_loss(batches).withColumn("dev_loss", F.round("dev_loss", 6))


@query("WITH r AS (SELECT source AS task, avg((quality)::DOUBLE) AS acc, avg((toxic)::DOUBLE) AS tox FROM labels JOIN documents USING (doc_id) GROUP BY source), a AS (SELECT task, CASE WHEN task < 'src15' THEN acc ELSE tox END AS accuracy FROM r) SELECT task, round(accuracy, 9) AS accuracy FROM a UNION ALL SELECT 'macro_average', round(avg(accuracy), 9) FROM a")
def task_accuracy_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("quality").alias("acc"), F.avg("toxic").alias("tox"))
    own = F.when(F.col("source") < "src15", F.create_map(F.lit("acc,none"), F.col("acc"), F.lit("acc_norm,none"), F.col("tox"))).otherwise(F.create_map(F.lit("acc_norm,none"), F.col("tox"), F.lit("acc"), F.col("acc")))
    return losses.accuracy_report(met.select(F.col("source").alias("task"), own.alias("metrics"))).withColumn("accuracy", F.round("accuracy", 9))


@query("WITH p AS (SELECT doc_id, string_split(replace(coalesce(text, ''), ' ', ','), ',') AS p FROM documents), u AS (SELECT doc_id, trim(unnest(p)) AS x, generate_subscripts(p, 1) AS i FROM p), f AS (SELECT doc_id, x, min(i) AS i FROM u WHERE x <> '' GROUP BY doc_id, x), t AS (SELECT doc_id, string_agg(x, '|' ORDER BY i) AS tasks FROM f GROUP BY doc_id) SELECT p.doc_id, coalesce(tasks, '') AS tasks FROM p LEFT JOIN t ON p.doc_id = t.doc_id")
def task_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(","))
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(S.parse_list(text), "|").alias("tasks"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def task_row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d = load(spark, sf_dir, "documents").select("source", "doc_id")
    n = S.normalize_limit(5)
    return d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where(F.col("r") <= n).drop("r")


@query(f"WITH {LOGITS_SQL} SELECT lg.row, lg.tok, CASE WHEN h.tok IS NULL THEN logit WHEN logit < 0 THEN logit * 1.3::DOUBLE ELSE logit / 1.3::DOUBLE END AS logit FROM lg LEFT JOIN (SELECT DISTINCT row, tok FROM hist) h ON lg.row = h.row AND lg.tok = h.tok")
def repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.repetition_penalty(_logits(spark, sf_dir), _history(spark, sf_dir), 1.3)


@query(f"WITH {LOGITS_SQL} SELECT DISTINCT a.row, c.tok FROM hist a JOIN hist b ON a.row = b.row AND b.pos = a.pos + 1 JOIN hist c ON a.row = c.row AND c.pos = a.pos + 2 JOIN hist y ON y.row = a.row AND y.pos = 10 AND y.tok = a.tok JOIN hist z ON z.row = a.row AND z.pos = 11 AND z.tok = b.tok")
def ngram_ban(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.banned_tokens(_history(spark, sf_dir), 3)


@query(f"WITH {LOGITS_SQL} SELECT row, tok, logit FROM (SELECT *, rank() OVER (PARTITION BY row ORDER BY logit DESC) AS r FROM lg) WHERE r <= 10")
def topk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.top_k(_logits(spark, sf_dir), 10)


@query(f"WITH {LOGITS_SQL} SELECT row, tok, logit FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY row ORDER BY logit DESC, tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM sm) WHERE c <= 0.8")
def nucleus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.nucleus(_logits(spark, sf_dir), 0.8)


@query(f"WITH {LOGITS_SQL} SELECT row, tok, logit FROM sm WHERE logit >= m + ln(0.7)")
def min_p_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.min_p(_logits(spark, sf_dir), 0.7)


@query(f"WITH {LOGITS_SQL} SELECT row, tok FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY logit DESC, tok) AS r FROM lg) WHERE r = 1")
def greedy_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.greedy(_logits(spark, sf_dir))


DRAW_SQL = "SELECT row, arg_min(tok, c) AS tok FROM (SELECT *, max(c) OVER (PARTITION BY row) AS mc FROM (SELECT *, sum(p) OVER (PARTITION BY row ORDER BY logit DESC, tok ROWS UNBOUNDED PRECEDING) AS c, ('0x' || substr(md5('7-' || row), 1, 8))::BIGINT / 4294967296.0 AS u FROM sm)) WHERE c > u OR c = mc GROUP BY row"


@query(f"WITH {LOGITS_SQL} {DRAW_SQL}")
def hash_sampled_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.draw(_logits(spark, sf_dir), 7)


@query("WITH " + LOGITS_SQL.split("sm AS")[0] + """
pen AS (SELECT lg.row, lg.tok, (CASE WHEN h.tok IS NULL THEN logit WHEN logit < 0 THEN logit * 1.1::DOUBLE ELSE logit / 1.1::DOUBLE END) AS logit FROM lg LEFT JOIN (SELECT DISTINCT row, tok FROM hist) h ON lg.row = h.row AND lg.tok = h.tok),
ban AS (SELECT DISTINCT a.row, c.tok FROM hist a JOIN hist b ON a.row = b.row AND b.pos = a.pos + 1 JOIN hist c ON a.row = c.row AND c.pos = a.pos + 2 JOIN hist y ON y.row = a.row AND y.pos = 10 AND y.tok = a.tok JOIN hist z ON z.row = a.row AND z.pos = 11 AND z.tok = b.tok),
kept AS (SELECT row, tok, logit / 0.7::DOUBLE AS logit FROM pen WHERE NOT EXISTS (SELECT 1 FROM ban WHERE ban.row = pen.row AND ban.tok = pen.tok)),
tk AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY row ORDER BY logit DESC) AS r FROM kept) WHERE r <= 20),
s1 AS (SELECT row, tok, logit, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY row) AS p FROM (SELECT *, max(logit) OVER (PARTITION BY row) AS m FROM tk)),
np AS (SELECT row, tok, logit FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY row ORDER BY logit DESC, tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM s1) WHERE c <= 0.9),
mp AS (SELECT * FROM (SELECT *, max(logit) OVER (PARTITION BY row) AS m FROM np) WHERE logit >= m + ln(0.05)),
sm AS (SELECT row, tok, logit, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY row) AS p FROM mp) """ + DRAW_SQL)
def decode_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.next_token(_logits(spark, sf_dir), _history(spark, sf_dir), temperature=0.7, k=20, p=0.9, min_prob=0.05, penalty=1.1, ngram=3, seed=7)


@query(f"SELECT item_id, sample, array_to_string(w[greatest(1, len(w) - 23) :], ' ') AS prompt FROM (SELECT item_id, {WORDS_SQL} AS w FROM benchmark), (SELECT unnest(range(0, 3)) AS sample)")
def prompt_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = load(spark, sf_dir, "benchmark").select("item_id", F.array_join(S.keep_last(T.words(F.col("text")), 64, 40), " ").alias("prompt"))
    return decoding.replicate(prompts, 3).select("item_id", F.col("sample").cast("long").alias("sample"), "prompt")


@query("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, round(unnest(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)) / len(embedding) + 1e-5))), 6) AS x FROM embeddings")
def rmsnorm_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(S.rms_norm(F.col("embedding"))).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


PARAMETERS = [("_orig_mod.transformer.wte.weight", 2), ("_orig_mod.transformer.h.0.attn.q.weight", 2), ("transformer.h.0.norm.weight", 1), ("lm_head.weight", 2), ("transformer.h.0.mlp.bias", 1)]


@query("SELECT name, CASE WHEN name = 'transformer.wte.weight' THEN 'adamw_nodecay' WHEN ndim = 2 THEN 'muon' ELSE 'adamw_decay' END AS grp FROM (SELECT regexp_replace(n, '^_orig_mod\\.', '') AS name, ndim FROM (VALUES " + ", ".join(f"('{n}', {d})" for n, d in PARAMETERS) + ") AS v(n, ndim))")
def optimizer_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame(PARAMETERS, "n string, ndim int").select(S.strip_prefix(F.col("n")).alias("name"), "ndim")
    return p.select("name", S.optimizer_group(F.col("name"), F.col("ndim")).alias("grp"))


KEYS_SQL = "d AS (SELECT doc_id, source, source || '/' || lang AS key FROM documents), l AS (SELECT d.*, quality, toxic FROM d JOIN labels USING (doc_id))"


@query(f"WITH {KEYS_SQL} SELECT 'union' AS op, key FROM (SELECT source AS key FROM d UNION ALL SELECT source FROM l) UNION ALL SELECT 'except', key FROM (SELECT DISTINCT key FROM d EXCEPT SELECT key FROM l WHERE toxic = 1) UNION ALL SELECT 'intersect', key FROM (SELECT key FROM l WHERE quality = 1 INTERSECT SELECT key FROM l WHERE toxic = 1)")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and languages of all documents against those of labelled ones."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.concat("source", F.lit("/"), "lang").alias("key"))
    found = d.join(load(spark, sf_dir, "labels"), "doc_id")
    toxic, good, source = found.where("toxic = 1").select("key"), found.where("quality = 1").select("key"), F.col("source").alias("key")
    parts = {"union": d.select(source).unionByName(found.select(source)), "except": d.select("key").subtract(toxic), "intersect": good.intersect(toxic)}
    return reduce(DataFrame.unionByName, [part.select(F.lit(name).alias("op"), "key") for name, part in parts.items()])


from . import storage  # noqa: E402,F401  registers the queries of files and streams

"""Importance resampling: documents drawn so that their n-grams resemble those of a target.

The words of a run of a partition's texts become ids; the suffixes of all texts, as far as n words, stand in a suffix array,
whose longest common prefixes tell where a run of equal n-grams begins. Each such run is hashed once, from its words, and its
bucket is scattered back to its occurrences. A document's buckets are written; their counts in the corpus and in the target, a
number for each bucket, give each bucket a gain, and a document's weight is the sum of its gains. The highest weights with a
Gumbel term from a hash of doc_id are drawn: sampling without replacement.

Defined cases: a null text has no words; a document without features has weight 0; a null doc_id is hashed as an empty one;
rows of one doc_id share their Gumbel term and are ranked each by itself; an empty corpus gives no rows, an empty target gains by
the corpus alone; extra columns do no harm; a text longer than a run is a run by itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.packing import prefix_sum
from .common import materialise, pieces
from .tokens import Places

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of text that share a suffix array, about.
RUN_BYTES = 8 << 20
SIZE, BUCKETS, SEED = 1, 10_000, 2024
#: Words that a document needs to be drawn, and the share of those documents that is drawn, in hundredths.
MIN_WORDS, PERCENT = 20, 10


def suffixes(ids: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, prefix): the places of all words in the order of the next ``size`` words, and how many of them each shares with the
    one before. ``ends``: of each word's text; a suffix stops there."""
    columns = []
    for k in range(size):
        ahead = np.full(len(ids), -1, np.int64)
        ahead[: max(0, len(ids) - k)] = ids[k:]
        ahead[np.arange(len(ids)) + k >= ends] = -1
        columns.append(ahead)
    order = np.lexsort(columns[::-1]) if size > 1 else np.argsort(ids)
    prefix = np.zeros(len(ids), np.int64)
    same = np.ones(max(0, len(ids) - 1), bool)
    for c in columns:
        own = c[order]
        same &= (own[1:] == own[:-1]) & (own[1:] >= 0)
        prefix[1:] += same
    return order, prefix


def feature_buckets(ids: np.ndarray, names: list[bytes], ends: np.ndarray, size: int, buckets: int) -> list[np.ndarray]:
    """For each length up to ``size``, the bucket of the n-gram at every place, -1 where the text ends before."""
    order, prefix = suffixes(ids, ends, size)
    room = ends - np.arange(len(ids))
    out = []
    for n in range(1, size + 1):
        own = np.full(len(ids), -1, np.int64)
        whole = order[room[order] >= n]
        first = np.flatnonzero((prefix < n)[room[order] >= n])
        hashed = np.fromiter((zlib.crc32(b" ".join([names[w] for w in ids[at : at + n]])) % buckets for at in whole[first]), np.int64, len(first))
        own[whole] = np.repeat(hashed, np.diff(np.append(first, len(whole))))
        out.append(own)
    return out


def _featured(size: int, buckets: int) -> Callable:
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").cast(pa.binary())
            sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < len(texts):
                end = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + RUN_BYTES, "right")))
                yield _features(batch.column("doc_id").slice(first, end - first), texts.slice(first, end - first), size, buckets, kind)
                first = end

    return run


def _features(doc_ids: pa.Array, texts: pa.Array, size: int, buckets: int, kind: np.dtype) -> pa.RecordBatch:
    place = Places()
    parts, n = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        for part in pieces(text.as_py(), _BREAK):
            words = _WORD.findall(part.lower())
            n[k] += len(words)
            parts.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
    ids = np.concatenate([np.zeros(0, np.int64), *parts])
    stops = np.cumsum(n)
    per_length = feature_buckets(ids, list(place), np.repeat(stops, n), size, buckets)
    met = np.stack(per_length, axis=1) if size > 1 else per_length[0][:, None]
    held = met >= 0
    each = np.concatenate([[0], np.cumsum(held.sum(axis=1))])[np.concatenate([[0], stops])]
    flat = met[held].astype(kind).tobytes()
    cuts = each * kind.itemsize
    packed = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(flat)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n), pa.array(np.diff(each)), packed], ["doc_id", "n_words", "n_features", "buckets"])


def features(docs: DataFrame, size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the buckets of all features, packed."""
    return docs.select("doc_id", "text").mapInArrow(_featured(size, buckets), "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(table: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features each bucket holds: each task adds up its own, so that as many numbers leave it as there are buckets."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column("buckets"):
                total += np.bincount(np.frombuffer(b.as_py(), kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    out = [0] * buckets
    for r in table.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """What a feature of each bucket adds to a weight: thousandths of the log ratio of smoothed shares."""
    n, s, t = len(corpus), float(sum(corpus)), float(sum(target))
    return np.array([floor(1000 * log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus, target, strict=True)], np.int64)


def weights(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """The features' table with ``weight`` in place of the buckets."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.fromiter((gain[np.frombuffer(b.as_py(), kind)].sum() for b in batch.column("buckets")), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(own)], ["doc_id", "n_words", "n_features", "weight"])

    return table.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw from a hash of the document's id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, size: int = SIZE, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank, null where a document is not drawn. Scores are ranked by range parts, so
    no task holds them all."""
    own = materialise(features(docs, size, buckets), "features")
    gain = gains(bucket_counts(own, buckets), bucket_counts(features(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), size, buckets), buckets))
    scored = weights(own, gain).withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long"))
    fit = (F.col("n_words") >= min_words).cast("long")
    placed = prefix_sum(scored.withColumns({"__unfit": 1 - fit, "__low": -F.col("score"), "__one": F.lit(1).cast("long")}), ["__unfit", "__low", "doc_id", "n_features"], "__one", "__at", "__to")
    drawn = placed.agg(F.coalesce(F.floor(F.sum(fit) * percent / 100), F.lit(0)).alias("n")).first()["n"]
    rank = F.when((F.col("__unfit") == 0) & (F.col("__to") <= drawn), F.col("__to"))
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op12_importance(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark).drop("n_words")


#: The reflected polynomial of CRC-32 in its table of 256 values, as DuckDB has no such function.
_CRC = "list_reduce([b]::BIGINT[] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)"
ORACLE_SQL = f"""
WITH crc AS (SELECT list({_CRC} ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
x AS (SELECT 'd' AS kind, doc_id, row_number() OVER () AS k, text FROM documents UNION ALL SELECT 'b', NULL, 0, text FROM benchmark),
w AS (SELECT kind, k, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM x),
c AS (SELECT kind, k, word, count(*) AS n FROM w GROUP BY ALL),
v AS (SELECT word, hex(encode(word)) AS h, strlen(word) AS size FROM (SELECT DISTINCT word FROM c)),
h AS (SELECT word, xor(4294967295, list_reduce([4294967295]::BIGINT[] || list_transform(range(size), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT), lambda a, y: xor(t[(xor(a, y) % 256 + 1)::INT], a // 256))) % {BUCKETS} AS bucket FROM v, crc),
s AS (SELECT bucket, sum(n) FILTER (kind = 'd') AS s, sum(n) FILTER (kind = 'b') AS t FROM c JOIN h ON c.word = h.word GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM s),
g AS (SELECT bucket, floor(1000 * ln((coalesce(s.t, 0)::DOUBLE + 1) * (z.s + {BUCKETS}) / ((coalesce(s.s, 0)::DOUBLE + 1) * (z.t + {BUCKETS}))))::BIGINT AS gain FROM s, z),
f AS (SELECT c.k, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight FROM c JOIN h ON c.word = h.word JOIN g ON h.bucket = g.bucket WHERE kind = 'd' GROUP BY c.k),
r AS (SELECT x.doc_id, coalesce(f.n, 0) AS n_features, coalesce(f.weight, 0) AS weight, coalesce(f.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(x.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x LEFT JOIN f ON x.k = f.k WHERE kind = 'd'),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS i, count(*) FILTER (n_features >= {MIN_WORDS}) OVER () AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND i <= n * {PERCENT} // 100 THEN i END AS rank FROM o
"""

"""Token ids as a binary corpus: canonical length-limited Huffman codes from global counts, in independent blocks.

Format. A corpus is a folder with two tables that Spark writes and commits. ``codebook``: id and code length of every id
that occurs; codes are canonical (by length, then id), so lengths suffice. ``blocks``: part, block (in its part), first (ids
of the part before the block), n_docs, n_ids and payload. Parts and blocks are in ascending doc_id order, and a block holds
whole documents. A payload is little-endian:

    "TWH1", uint32 n_docs, uint64 n_ids, uint32 n_checkpoints, uint8[n_docs] doc_id is null, int64[n_docs] doc_id,
    uint64[n_docs] ids of each document, uint64[n_checkpoints] bit offset of every CHECKPOINT-th id, then the code bits,
    first bit highest.

A block is decoded by itself: its checkpoints are lanes that a table look-up advances together, one id a step.

Defined cases: a null or empty text is its end id alone; documents of one doc_id stand by a hash of their ids, then by their
bytes, and repeated rows are documents each; null doc_ids come first; a long text is a block by itself, whose codes must fit
in a cell of 2 GB; a corpus without documents has empty tables; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch, text_views
from .tokens import WORD_LEVEL, encoder, vocabulary_file

END_ID = 2
MAX_BITS = 18
CHECKPOINT = 64
BLOCK_IDS = 1 << 16
MAGIC = b"TWH1"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code lengths of at most ``limit`` bits that are best for ``counts``, by package-merge; 0 where a count is 0."""
    present = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(present) < 2:
        out[present] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(present)))))
    order = present[np.argsort(counts[present], kind="stable")]
    weight = counts[order].astype(np.int64)
    n = len(order)
    levels = []  # for each level whether its k-th item is a symbol; packages pair the items of the level below
    items = weight
    for _ in range(limit):
        levels.append(None)
    below = np.zeros(0, np.int64)
    for level in range(limit):
        items = np.concatenate([weight, below])
        at = np.argsort(items, kind="stable")
        levels[level] = at < n
        items = items[at]
        below = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for level in range(limit - 1, -1, -1):
        symbols = int(levels[level][:take].sum())
        lengths[:symbols] += 1  # the items taken of a level are its lightest, and so the first symbols in order of weight
        take = 2 * (take - symbols)
    out[order] = lengths
    return out


class Codebook:
    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(self.lengths[-1]) if len(ids) else 1
        # canonical: in order of length, each code follows the one before it
        step = np.int64(1) << (self.bits - self.lengths)
        self.first = np.cumsum(step) - step
        self.codes = self.first >> (self.bits - self.lengths)

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        top = int(self.ids.max()) + 1 if len(self.ids) else 1
        code, size = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        code[self.ids], size[self.ids] = self.codes, self.lengths
        return code, size

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length of the code at the front of every possible run of bits."""
        reach = np.int64(1) << (self.bits - self.lengths)
        ids, size = np.zeros(1 << self.bits, np.uint32), np.ones(1 << self.bits, np.uint8)
        used = int(reach.sum())
        ids[:used], size[:used] = np.repeat(self.ids, reach), np.repeat(self.lengths, reach)
        return ids, size


def encode_block(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, code: np.ndarray, size: np.ndarray) -> bytes:
    length = size[ids]
    ends = np.cumsum(length)
    at = ends - length
    out = np.zeros((int(ends[-1]) if len(ends) else 0) // 64 + 2, np.uint64)
    word, room = at >> 6, 64 - (at & 63) - length
    value = code[ids]
    if len(ids):
        # the codes that begin in one word of 64 bits stand together, and at most one of them goes on in the next word
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[first]] = np.add.reduceat(np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64)), first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] += value[over] << (64 + room[over]).astype(np.uint64)
    checkpoints = at[::CHECKPOINT].astype("<u8")
    return b"".join([
        MAGIC, struct.pack("<IQI", len(doc_ids), len(ids), len(checkpoints)), bytes(d is None for d in doc_ids), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        sizes.astype("<u8").tobytes(), checkpoints.tobytes(), out.astype(">u8").tobytes(),
    ])


#: Ids decoded together at most, or one block.
TOGETHER = 1 << 20


def decode_blocks(payloads: list[bytes], table: tuple[np.ndarray, np.ndarray], bits: int) -> list[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """doc_ids, ids of each document, and all ids of each block. The lanes of all blocks take their steps together."""
    docs, sizes, places, words, counts, base = [], [], [], [], [], 0
    for payload in payloads:
        if payload[:4] != MAGIC:
            raise ValueError("not a block")
        n_docs, n, lanes = struct.unpack_from("<IQI", payload, 4)
        at = 20
        null, doc = payload[at : at + n_docs], np.frombuffer(payload, "<i8", n_docs, at + n_docs)
        docs.append([None if x else int(d) for x, d in zip(null, doc, strict=True)])
        sizes.append(np.frombuffer(payload, "<u8", n_docs, at + 9 * n_docs).astype(np.int64))
        places.append(np.frombuffer(payload, "<u8", lanes, at + 17 * n_docs).astype(np.int64) + 64 * base)
        words.append(np.frombuffer(payload, ">u8", -1, at + 17 * n_docs + 8 * lanes).astype(np.uint64))
        counts.append((lanes, n))
        base += len(words[-1])
    place, word = np.concatenate(places), np.concatenate(words)
    out = np.zeros((CHECKPOINT, len(place)), np.uint32)
    ids, size = table
    last, shift = len(word) - 2, np.uint64(64 - bits)
    for step in range(CHECKPOINT if len(place) else 0):
        w = np.minimum(place >> 6, last)  # a lane that is through reads on, and what it reads is cut off below
        r = (place & 63).astype(np.uint64)
        front = (word[w] << r) | ((word[w + 1] >> np.uint64(1)) >> (np.uint64(63) - r))
        front >>= shift
        out[step] = ids[front]
        place = place + size[front]
    lane = np.cumsum([0, *(x for x, _ in counts)])
    return [(docs[k], sizes[k], out[:, lane[k] : lane[k + 1]].T.ravel()[:n]) for k, (_, n) in enumerate(counts)]


ENCODED = "doc_id long, ids binary, width int, counts binary"


def tokenized(docs: DataFrame, path: str, stretch: str = WORD_LEVEL, end_id: int = END_ID) -> DataFrame:
    """A row for each whole text: doc_id and its ids with the end id, as little-endian bytes of ``width`` each. Each task adds one
    row of its own, with how often it met each id (64-bit counts in order of id) and no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, stretch)
        names, size = ["doc_id", "ids", "width", "counts"], max(enc.tokenizer.get_vocab_size(), end_id + 1)
        kind, counts = "<u2" if size <= 1 << 16 else "<u4", np.zeros(size, np.int64)
        for batch in batches:
            texts = batch.column("text")
            for first, end, data, offsets in text_views(texts):
                ids, sizes = enc.encode_utf8(data, offsets)
                counts += np.bincount(ids, minlength=size)
                counts[end_id] += end - first
                ends = np.cumsum(sizes)
                ids = np.insert(ids.astype(kind), ends, end_id)
                cuts = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * ids.itemsize
                values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), values.cast(pa.binary()), pa.array(np.full(end - first, ids.itemsize), pa.int32()), pa.nulls(end - first, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the counts of the tasks."""
    total = np.zeros(1, np.int64)
    for batch in batches:
        for raw in batch.column("counts"):
            got = np.frombuffer(raw.as_buffer(), "<i8")
            total = np.append(total, np.zeros(max(0, len(got) - len(total)), np.int64))
            total[: len(got)] += got
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["id", "n"])


def _blocks(ids: np.ndarray, lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, size = Codebook(ids, lengths).encoder()
        part, block, first = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, first
            own = np.concatenate(held).astype(np.int64)
            payload = encode_block(docs, np.array([len(x) for x in held]), own, code, size)
            row = [part, block, first, len(docs), len(own), payload]
            block, first = block + 1, first + len(own)
            docs.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "block", "first", "n_docs", "n_ids", "payload"])

        n = 0
        for batch in batches:
            for doc, raw, width in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("width").to_pylist(), strict=True):
                docs.append(doc)
                held.append(np.frombuffer(raw.as_py(), f"<u{width}"))
                n += len(held[-1])
                if n >= BLOCK_IDS:
                    yield flush()
                    n = 0
        if docs:
            yield flush()

    return run


def write_corpus(docs: DataFrame, path: str, vocabulary: str | None = None, max_bits: int = MAX_BITS) -> None:
    """Tokenize, count, and write the corpus folder at ``path``. The counts on the driver are bounded by the vocabulary."""
    spark = docs.sparkSession
    encoded = materialise(tokenized(docs, vocabulary or vocabulary_file("word_bpe_49k.json")), "ids")
    ids = encoded.where("ids is not null").drop("counts")
    counts = encoded.select("counts").where("counts is not null").mapInArrow(_id_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    dense = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        dense[r["id"]] = r["n"]
    lengths = code_lengths(dense, max_bits)
    at = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in at], "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    # by a hash, too, so that documents of one doc_id, or of none, need not all come to one task
    keyed = ids.withColumn("h", F.xxhash64("ids"))
    sorted_ids = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").drop("h")
    sorted_ids.mapInArrow(_blocks(at, lengths[at]), "part int, block long, first long, n_docs long, n_ids long, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of each document, from the files alone."""
    return _decoded(spark, path, digest=False)


def _decoded(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    book = spark.read.parquet(f"{path}/codebook").collect()  # bounded by the vocabulary
    codebook = Codebook(np.array([r["id"] for r in book], np.int64), np.array([r["bits"] for r in book], np.int64))
    blocks = spark.read.parquet(f"{path}/blocks")
    # a sum for each file part: as many as tasks wrote, whatever their size
    base, total = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["part"]):
        base[r["part"]], total = total, total + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = codebook.decoder()
        for batch in batches:
            begin = 0
            n_ids = batch.column("n_ids").to_pylist()
            while begin < batch.num_rows:
                end, n = begin + 1, n_ids[begin]
                while end < batch.num_rows and n + n_ids[end] <= TOGETHER:
                    n, end = n + n_ids[end], end + 1
                own = batch.slice(begin, end - begin)
                found = decode_blocks([x.as_py() for x in own.column("payload")], table, codebook.bits)
                for part, first, (docs, sizes, ids) in zip(own.column("part").to_pylist(), own.column("first").to_pylist(), found, strict=True):
                    ends = np.cumsum(sizes)
                    starts = pa.array(base[part] + first + ends - sizes)
                    if digest:
                        raw = ids.astype("<u4")
                        crc = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), starts, pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    else:
                        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), starts, lists], ["doc_id", "start", "ids"])
                begin = end

    return blocks.select("part", "first", "n_ids", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" if digest else "doc_id long, start long, ids array<int>")


def op7_token_binary(docs: DataFrame) -> DataFrame:
    path = scratch(docs.sparkSession, "corpus")
    write_corpus(docs, path)
    return _decoded(docs.sparkSession, path, digest=True)

"""Packing of token ids into sequences by Karmarkar-Karp multiway differencing.

Each document is tokenized and ends with an end id. Whole sequences are cut off its front while it has that many ids; what
is left is cut into pieces of at most ``piece`` ids. The pieces of a task are packed in groups: each piece starts as a
partial partition of its group's windows, and the two partitions with the widest spread are merged again and again, the
fullest windows of one upon the emptiest of the other, until one is left. A group starts with as few windows as its ids
need; whenever a window exceeds the capacity the count rises and the group is merged anew.

A task packs the rows of its own partition in their order, so no text is shuffled and a lost task gives the same rows again.
What does not fill a task's last group is left over: the leftovers of all tasks, a light row for each piece, are dealt out
to as many tasks as they need and packed there, so that many small partitions cost no padding.

Defined cases: a null or empty text is its end id alone; a text of any length is encoded whole, by itself if it is longer than
a run of texts; repeated rows are packed each; a null doc_id is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, bound_batches, materialise, released, text_views
from .tokens import BYTE_LEVEL, encoder, vocabulary_file

CAPACITY = 1024
END_ID = 0
#: Ids of a piece at most, and windows of a group about: small pieces balance well, and a group costs time with the product.
PIECE = 128
GROUP_WINDOWS = 128
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``windows`` parts of near-equal sums. A partition lists its non-empty windows, fullest first."""
    heap = [(-s, k, [(s, [k])]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # both are filled up with empty windows; the fullest of a meets the emptiest of b
        free = windows - len(b)
        merged = [(s + t, x + y) for (s, x), (t, y) in zip(a[free:], reversed(b), strict=False)]
        alone = len(a) - free
        merged += a[:free]
        merged += b[: len(b) - max(0, alone)]
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[0][0], k, merged))
        k += 1
    return [x for _, x in heap[0][2]] if heap else []


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Parts of ``sizes`` none of which exceeds ``capacity``; the number of windows rises until that holds."""
    windows = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while windows:
        parts = difference(sizes, windows)
        over = max(sum(sizes[i] for i in p) for p in parts)
        if over <= capacity:
            return parts
        windows += 1
    return []


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
#: Sequence ids of leftovers start here.
LATER = 1 << 61
#: Groups of leftovers for a task.
TOGETHER = 4


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)], NAMES)


class _Waiting:
    """Pieces (doc_id, start, size, checksum, ids of the document) that wait for a full group; numbers sequences from ``base`` on."""

    def __init__(self, base: int, capacity: int, group_windows: int) -> None:
        self.number, self.capacity, self.full = base, capacity, group_windows * capacity
        self.pieces: list[tuple[int | None, int, int, int, int]] = []
        self.held = 0

    def add(self, piece: tuple[int | None, int, int, int, int]) -> None:
        self.pieces.append(piece)
        self.held += piece[2]

    def take(self) -> int:
        self.number += 1
        return self.number - 1

    def packed(self) -> list[tuple]:
        out = []
        for part in pack([w[2] for w in self.pieces], self.capacity):
            at, number = 0, self.take()
            for i in sorted(part):
                out.append((*self.pieces[i], number, at))
                at += self.pieces[i][2]
        self.pieces.clear()
        self.held = 0
        return out


def _pieces(path: str, capacity: int, piece: int, group_windows: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, BYTE_LEVEL)
        waiting = _Waiting(TaskContext.get().partitionId() << 40, capacity, group_windows)
        for batch in batches:
            texts = batch.column("text")
            for first, end, data, offsets in text_views(texts):
                ids, sizes = enc.encode_utf8(data, offsets)
                raw, at, out = ids.astype("<u4").tobytes(), 0, []
                for doc, n in zip(batch.column("doc_id").slice(first, end - first).to_pylist(), sizes.tolist(), strict=True):
                    own, total = raw[4 * at : 4 * (at + n)] + END_ID.to_bytes(4, "little"), n + 1
                    at += n
                    whole = total // capacity * capacity
                    for start in range(0, whole, capacity):
                        out.append((doc, start, capacity, zlib.crc32(own[4 * start : 4 * (start + capacity)]), total, waiting.take(), 0))
                    for start in range(whole, total, piece):
                        size = min(piece, total - start)
                        waiting.add((doc, start, size, zlib.crc32(own[4 * start : 4 * (start + size)]), total))
                    if waiting.held >= waiting.full:
                        out += waiting.packed()
                yield _rows(out)
        yield _rows([(*w, None, None) for w in waiting.pieces])
        enc.shrink()

    return run


def _left_over(capacity: int, group_windows: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = _Waiting(LATER + (TaskContext.get().partitionId() << 40), capacity, group_windows)
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in NAMES[:5]), strict=True):
                waiting.add(row)
                if waiting.held >= waiting.full:
                    out += waiting.packed()
            yield _rows(out)
        yield _rows(waiting.packed())

    return run


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """One row for each piece: its document, place in it, checksum of its ids, and its sequence and place there."""
    bound_batches(docs.sparkSession, CHUNK_BYTES)
    path = vocabulary or vocabulary_file("byte_bpe_50k.json")
    made = materialise(docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, piece, group_windows), SCHEMA), "pieces")
    left = made.where("sequence_id is null")
    ids = left.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-ids // (TOGETHER * group_windows * capacity)))
    dealt = left.repartition(tasks).sortWithinPartitions("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    return made.where("sequence_id is not null").unionByName(dealt.mapInArrow(_left_over(capacity, group_windows), SCHEMA))


def op6_packing(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)

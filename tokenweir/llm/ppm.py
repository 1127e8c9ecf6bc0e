"""Documents scored by prediction by partial matching, beside a unigram base.

A text is its lower-cased words with a space between them and an end after them, as bytes. The model is a byte-context trie of the
training texts: how often each byte follows each context of 0 to ``ORDER`` bytes, across words. A byte that a context has not been
followed by costs an escape to the context that is one byte shorter, where the bytes already seen in the longer one are excluded
from all counts; escapes are estimated as in method C, by the number of different bytes that followed. Below the empty context all
remaining bytes are alike.

The trie is a table (level, node, count), and no task holds it. Each task cuts its partition into chunks of about ``CHUNK_BYTES``,
or less where texts hold very many different leaves or tokens, and writes them, compressed, with each chunk's distinct contexts and next bytes (8 bytes each) and its distinct tokens. Their sums
over all chunks are the trie's leaves and the token counts, inner nodes are sums of leaves, and joins give each distinct leaf its
probability. Each chunk then gets the values of its own leaves and tokens by a join, and is read against them. So memory is
bounded by a chunk, the trie grows with the corpus without a limit, and nothing of it is broadcast or passes through the driver but
two totals.

Defined cases: a null text is empty: one token, the end; a null doc_id counts as the empty text and trains; repeated rows are
scored alike and train as often as they stand; without training texts every byte costs log10(252), and a token log10(1 / 1) = 0
in the base, as the vocabulary is empty; an empty table gives no rows; extra columns do no harm; a text longer than a chunk is a chunk
by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise, pieces, release, released
from .tokens import Places

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
END = b"\n"
#: Bytes that can stand in a text as it is scored: all but tab and three of the line characters.
SYMBOLS = 252
#: Bytes of the longest context; with the byte after it they fit in a long.
ORDER = 5
CHUNK_BYTES = 32 << 20
#: Of zstd, for the texts of a chunk, which are written once and shuffled once.
LEVEL = 3
#: Distinct leaves or tokens that end a chunk before; texts of the given tables have fewer.
LEAVES = 2 << 20
TOKENS = 1 << 20
#: Bytes whose contexts are worked on at once.
SLICE = 1 << 19
#: Distinct leaves, at least, that wait to be merged with those of their chunk.
WAITING = 1 << 19
#: Leaves or tokens that a task hands to Spark at a time.
ROWS = 1 << 16


def is_held(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds == fold


def normal(text: bytes) -> bytes:
    """The text as it is scored, without its end."""
    return b" ".join([w for part in pieces(text, _SPACE) for w in _WORD.findall(part.lower())])


def tokens_of(body: bytes) -> Iterator[list[bytes]]:
    """The tokens of a text as it is scored, a list for each piece, and the end."""
    if body:
        for part in pieces(body, _SPACE):
            yield part.split()
    yield [END]


def numbered(place: Places, body: bytes) -> np.ndarray:
    return np.fromiter(map(place.__getitem__, chain.from_iterable(tokens_of(body))), np.int32)


def leaves(bodies: Iterable[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of texts in turn: the leaf at every byte, and the number of the text it is in. A leaf is a context of ``order`` bytes and the
    byte after it, as a number; before a text there are ends."""
    held: list[bytes] = []
    owners: list[tuple[int, int, int]] = []  # text, bytes before its own, own bytes
    size = 0

    def given() -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(held), np.uint8).astype(np.int64)
        key = np.zeros(len(data) - order, np.int64)
        for j in range(order + 1):
            key |= data[order - j : len(data) - j] << (8 * j)
        own = np.concatenate([np.arange(at, at + n) for _, at, n in owners])
        return key[own - order], np.repeat([t for t, _, _ in owners], [n for _, _, n in owners])

    for k, body in enumerate(bodies):
        for at in range(0, len(body) + 1, SLICE):
            own = body[at : at + SLICE] + END * (at + SLICE > len(body))
            before = (END * order + body[max(0, at - order) : at])[-order:] if order else b""
            held += [before, own]
            owners.append((k, size + order, len(own)))
            size += order + len(own)
            if size > SLICE:
                yield given()
                held, owners, size = [], [], 0
    if owners:
        yield given()


class _Chunk:
    """Texts of a partition in a row, until they are ``CHUNK_BYTES`` or hold ``LEAVES`` or ``TOKENS``; each is counted and compressed as it
    comes, and not kept."""

    def __init__(self) -> None:
        self.doc_ids: list[int | None] = []
        self.held: list[bool] = []
        self.sizes: list[int] = []
        self.full = False
        self.place = Places()  # of each token, as it is first met
        self.counts = np.zeros(0, np.int64)  # of each token, in texts that train
        self.trained, self.waiting = [np.zeros(0, np.int32)], 0  # places of the tokens of texts that train, until they are counted
        self.packer, self.packed = zstandard.ZstdCompressor(level=LEVEL).compressobj(), []

    def taken(self, rows: Iterator[tuple]) -> Iterator[bytes]:
        size = 0
        for doc_id, held, text in rows:
            body = normal(text)
            self.doc_ids.append(doc_id)
            self.held.append(held)
            self.sizes.append(len(body))
            own = numbered(self.place, body)
            if not held:
                self.trained.append(own)
                self.waiting += len(own)
                if self.waiting > SLICE:
                    self.count()
            self.packed.append(self.packer.compress(body))
            yield body
            size += len(body) + 1
            if size > CHUNK_BYTES or len(self.place) > TOKENS or self.full:
                return

    def count(self) -> None:
        """The tokens of texts that train, since they were last counted."""
        before = self.counts
        self.counts = np.bincount(np.concatenate(self.trained), minlength=len(self.place))
        self.counts[: len(before)] += before
        del self.trained[1:]
        self.waiting = 0

    def listed(self, rows: Iterator[tuple], number: int, order: int) -> Iterator[pa.RecordBatch]:
        """The distinct leaves and tokens, and how often they stand in training texts; then the texts."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for leaf, owner in leaves(self.taken(rows), order):
            # the lowest bit tells whether the text trains, so that one sort counts both
            found.append(_counted(leaf << 1 | ~np.array(self.held, bool)[owner]))
            del leaf, owner
            if sum(len(keys) for keys, _ in found[1:]) > max(WAITING, len(found[0][0])):
                found.append(_merged(found))
                self.full = len(found[0][0]) > LEAVES
        self.count()
        both, n = _merged(found)
        n *= (both & 1).astype(n.dtype)
        both >>= 1
        first = _firsts(both)
        leaf, n = both[first], np.add.reduceat(n, first, dtype=np.int64)
        del both, first
        for at in range(0, len(leaf), ROWS):
            yield _rows(number, leaf=pa.array(leaf[at : at + ROWS]), n=pa.array(n[at : at + ROWS]))
        words = list(self.place)
        for at in range(0, len(words), ROWS):
            own = words[at : at + ROWS]
            # a token's place among the chunk's, from -1 down
            yield _rows(number, leaf=pa.array(-1 - np.arange(at, at + len(own))), token=pa.array(own, pa.binary()), n=pa.array(self.counts[at : at + ROWS]))
        self.packed.append(self.packer.flush())
        yield _rows(number, **{name: pa.array([value], LISTED.field(name).type) for name, value in (("doc_ids", self.doc_ids), ("held", self.held), ("sizes", self.sizes), ("texts", b"".join(self.packed)))})


LISTED = pa.schema([("chunk", pa.int64()), ("leaf", pa.int64()), ("token", pa.binary()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])
LISTED_SQL = "chunk long, leaf long, token binary, n long, doc_ids array<long>, held array<boolean>, sizes array<long>, texts binary"


def _rows(number: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of a chunk; the columns that are not given are null."""
    size = len(next(iter(columns.values())))
    columns["chunk"] = pa.array(np.full(size, number))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in LISTED], schema=LISTED)


def _listed(order: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        rows = (
            (doc_id.as_py(), held.as_py(), text.as_py() or b"")
            for batch in batches
            for doc_id, held, text in zip(batch.column("doc_id"), batch.column("held"), batch.column("text").cast(pa.binary()), strict=True)
        )
        for row in rows:
            yield from _Chunk().listed(chain([row], rows), number, order)
            release()
            number += 1

    return released(run)


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each of sorted keys is first met."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and how often each is there; sorts them in place."""
    keys.sort()
    first = _firsts(keys)
    return keys[first], np.diff(first, append=len(keys)).astype(np.uint32)


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of several lists, and the sums of their numbers; empties the list, as it is most of a task's memory."""
    keys, n = (np.concatenate(x) for x in zip(*found, strict=True))
    found.clear()
    order = np.argsort(keys)
    keys = keys[order]
    n = n[order]
    del order
    first = _firsts(keys)
    return keys[first], np.add.reduceat(n, first, dtype=np.uint32)


def trie(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(level, node, n) of all nodes from the leaves (leaf, n): a node of level k is a context of k bytes and the byte after it."""
    up = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("level")
    nodes = counts.where("n > 0").select("leaf", "n", up)
    return nodes.groupBy("level", _cut(F.col("leaf"), F.col("level")).alias("node")).agg(F.sum("n").alias("n"))


def _cut(leaf: Column, level: Column) -> Column:
    """The node of a level that a leaf lies under."""
    return leaf.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (8 * (level + 1)).cast("int")) - 1)


def contexts(nodes: DataFrame) -> DataFrame:
    """(level, context, n, kinds, n_below, kinds_below): how often and by how many bytes a context is followed; and the same of the
    context that is one byte shorter, without the bytes that follow the longer one."""
    context = F.shiftright("node", 8)
    below = nodes.select((F.col("level") + 1).alias("level"), F.col("node").alias("short"), F.col("n").alias("n_short"))
    met = nodes.withColumn("short", _cut(F.col("node"), F.col("level") - 1)).join(below, ["level", "short"], "left")
    own = met.groupBy("level", context.alias("context")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum("n_short").alias("seen"))
    short = own.select((F.col("level") + 1).alias("level"), F.col("context").alias("__short"), F.col("n").alias("n_all"), F.col("kinds").alias("kinds_all"))
    out = own.withColumn("__short", F.when(F.col("level") > 1, _cut(F.col("context"), F.col("level") - 2)).otherwise(F.lit(0).cast("long"))).join(short, ["level", "__short"], "left")
    return out.select("level", "context", "n", "kinds", (F.col("n_all") - F.col("seen")).alias("n_below"), (F.col("kinds_all") - F.col("kinds")).alias("kinds_below"))


def probabilities(counts: DataFrame, nodes: DataFrame, followed: DataFrame, order: int = ORDER) -> DataFrame:
    """(leaf, cost): log10 of the probability of each leaf's byte after its context."""
    known = counts.where("n > 0").withColumn("context", F.shiftright("leaf", 8)).join(followed.where(F.col("level") == order).select("context", F.col("n").alias("total"), "kinds"), "context")
    known = known.select("leaf", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("cost"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("level")
    asked = counts.where("n <= 0").select("leaf", levels).withColumn("node", _cut(F.col("leaf"), F.col("level"))).withColumn("context", F.shiftright("node", 8))
    met = asked.join(nodes, ["level", "node"], "left").join(followed.withColumnsRenamed({"n": "total"}), ["level", "context"], "left")
    fields = ["level", "n", "total", "kinds", "n_below", "kinds_below"]
    path = met.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("path"))  # a struct for each level
    hit = F.coalesce(F.array_max(F.transform(F.filter("path", lambda x: x["n"].isNotNull()), lambda x: x["level"])), F.lit(-1))
    top = F.coalesce(F.array_max(F.transform(F.filter("path", lambda x: x["total"].isNotNull()), lambda x: x["level"])), F.lit(-1))
    path = path.withColumns({"hit": hit, "top": top})
    at = lambda k: F.get("path", k)
    left = lambda x: x["n_below"] + x["kinds_below"]
    first = F.when(F.col("top") > F.col("hit"), F.log10(at(F.col("top"))["kinds"] / (at(F.col("top"))["total"] + at(F.col("top"))["kinds"]))).otherwise(0.0)
    # from a context of level k one comes to level k - 1, and past it unless the byte is there
    past = F.filter("path", lambda x: (x["level"] <= F.col("top")) & (x["level"] > F.col("hit") + 1) & (left(x) > 0))
    later = F.aggregate(past, F.lit(0.0), lambda a, x: a + F.log10(x["kinds_below"] / left(x)))
    own = at(F.col("hit"))
    found = F.when(F.col("hit") == F.col("top"), F.log10(own["n"] / (own["total"] + own["kinds"]))).otherwise(F.log10(own["n"] / left(at(F.col("hit") + 1))))
    unseen = -F.log10(F.lit(SYMBOLS) - F.coalesce(at(F.lit(0))["kinds"], F.lit(0)))
    rest = path.select("leaf", (first + later + F.when(F.col("hit") >= 0, found).otherwise(unseen)).alias("cost"))
    return known.unionByName(rest)


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Values of known keys for arrays of keys: a table of slots, where keys that meet move on by one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            out = self.slots[at] != left
            at, left = (at[out] + 1) & (len(self.slots) - 1), left[out]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """All keys must be known."""
        at = self._slot(keys)
        found = self.slots[at]
        left = np.flatnonzero(self.keys[found] != keys)
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            found[left] = self.slots[at[left]]
            if (found[left] < 0).any():
                raise KeyError("a leaf has no value")
            left = left[self.keys[found[left]] != keys[left]]
        return self.values[found]


def _scored(order: int, total: int, kinds: int) -> Callable:
    divisor = total + 0.5 * (kinds + 1)

    def scores(chunks: pa.Table, values: pa.Table) -> pa.Table:
        leaf, value = (values.column(c).to_numpy() for c in ("leaf", "value"))
        own = leaf >= 0
        cost = Lookup(leaf[own], value[own])
        count = np.zeros(len(leaf) - np.count_nonzero(own), np.int64)
        count[-1 - leaf[~own]] = value[~own]
        del leaf, value, own
        (chunk,) = chunks.to_batches()
        doc_ids, held, sizes = (chunk.column(c).flatten() for c in ("doc_ids", "held", "sizes"))
        ends = np.cumsum(sizes.to_numpy()).tolist()
        data = pa.decompress(chunk.column("texts")[0].as_buffer(), ends[-1], "zstd", asbytes=True) if ends[-1] else b""
        bodies = lambda: (data[a:b] for a, b in pairwise([0, *ends]))
        place = Places()
        n, known, base, score = (np.zeros(len(ends), kind) for kind in (np.int64, np.int64, float, float))
        for k, body in enumerate(bodies()):
            c = count[numbered(place, body)]
            n[k], known[k], base[k] = len(c), np.count_nonzero(c), np.log10((c + 0.5) / divisor).sum()
        del place, count
        for leaf, owner in leaves(bodies(), order):
            score += np.bincount(owner, cost(leaf), len(score))
        return pa.table({"doc_id": doc_ids, "held_out": held, "n_tokens": n, "n_known": known, "train_tokens": np.full(len(n), total), "base_score": base, "score": score})

    def run(key: tuple, chunks: pa.Table, values: pa.Table) -> pa.Table:
        try:
            return scores(chunks, values)
        finally:
            release()

    return run


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held: Column, order: int = ORDER) -> DataFrame:
    """Every document's log10 probability under the model of the documents that are not ``held``, and under their unigrams."""
    if not 0 <= order <= 6:
        raise ValueError("contexts of 0 to 6 bytes fit in a leaf")
    bound_batches(docs.sparkSession)
    own = docs.select("doc_id", held.alias("held"), "text")
    listed = materialise(own.mapInArrow(_listed(order), LISTED_SQL), "listed")
    counts = materialise(listed.where("leaf >= 0").groupBy("leaf").agg(F.sum("n").alias("n")), "leaves")
    nodes = materialise(trie(counts, order), "nodes")
    costs = probabilities(counts, nodes, materialise(contexts(nodes), "contexts"), order)
    tokens = materialise(listed.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    totals = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("kinds")).first()
    of_leaf = listed.where("leaf >= 0").select("chunk", "leaf").join(costs.hint("shuffle_hash"), "leaf").select("chunk", "leaf", F.col("cost").alias("value"))
    of_token = listed.where("token is not null").select("chunk", "leaf", "token").join(tokens.hint("shuffle_hash"), "token").select("chunk", "leaf", F.col("n").cast("double").alias("value"))
    values = of_leaf.unionByName(of_token)
    texts = listed.where("texts is not null").select(*[F.col(c).alias(c) for c in ("chunk", "doc_ids", "held", "sizes", "texts")])
    return texts.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(_scored(order, totals["n"], totals["kinds"]), SCHEMA)


def op13_language_model(docs: DataFrame) -> DataFrame:
    return score(docs, is_held(F.col("doc_id")))

"""Benchmark decontamination by suffix arrays of the training texts.

Each shard (a run of documents in one task) is turned into word numbers, and the suffixes that can hold a whole window
are sorted into a suffix array by prefix doubling. Every suffix of every benchmark item is then searched in it by
narrowing its interval one word at a time, which gives the longest verbatim match and all places of each window. The
benchmark is cut into blocks of a stated size. AT_ONCE of them go to the tasks together and are searched for in one pass over
the documents, whose results a task puts together row by row; only a benchmark of more blocks needs more passes: then the rows
are numbered and written first, and the passes' results meet by that number. Either way each row is judged by itself.

Words: runs of ASCII letters, digits and characters beyond ASCII after lower-casing A-Z. A window is ``window`` words in
a row, or the whole item where that has fewer. Defined cases: null texts have no words; items without words have no
window; items of the same text are counted each; a null item_id is left out of lists but its words are hit; a null
doc_id, repeated rows and extra columns are passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, CHUNK_BYTES, bound_batches, lower_ascii, materialise, released, text_views, words

WINDOW = 10
#: Bytes of benchmark text in one block, and blocks that are sent to the tasks together at most.
BLOCK_BYTES = 4 << 20
AT_ONCE = 16


def _numbers(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text begins."""
    column = pa.array(texts, pa.string())
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, _, data, offsets in text_views(column):
        _, _, row, h = words(data, offsets, ALNUM_WORD)
        hashes.append(h)
        rows.append(row + first)
    row = np.concatenate(rows)
    return np.concatenate(hashes), np.searchsorted(row, np.arange(len(texts) + 1))


class Block:
    """A block of benchmark items, ready to be searched."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int) -> None:
        self.ids, self.window = ids, window
        h, self.begin = _numbers(texts)
        self.known = np.unique(h)
        self.numbers = np.searchsorted(self.known, h).astype(np.int64) + 1  # 0: a word of no item
        size = np.diff(self.begin)
        item = np.repeat(np.arange(len(texts)), size)
        left = self.begin[1:][item] - np.arange(len(h))
        need = np.minimum(window, size)[item]
        at = np.flatnonzero(left >= need)  # suffixes that start a window
        self.at, self.item, self.need, self.left = at, item[at], need[at], left[at]
        self.least = int(need.min()) if len(need) else 0
        bits = max(10, int(np.ceil(np.log2(len(self.known) + 1))) + 6)
        self.shift = np.uint64(64 - bits)
        self.sieve = np.zeros(1 << bits, bool)
        self.sieve[(self.known >> self.shift).astype(np.int64)] = True

    def number(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        may = np.flatnonzero(self.sieve[(h >> self.shift).astype(np.int64)])
        at = np.searchsorted(self.known, h[may])
        at[at == len(self.known)] = 0
        hit = self.known[at] == h[may]
        out[may[hit]] = at[hit] + 1
        return out


def suffix_array(numbers: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` sorted by the first ``depth`` or more words of their suffixes; 0 ends a suffix. Prefix doubling over ranks."""
    rank = np.zeros(len(numbers) + 1, np.int64)
    rank[:-1] = numbers
    span = 1
    while span < depth:
        second = np.zeros(len(rank), np.int64)
        second[: len(rank) - span] = rank[span:] if span < len(rank) else 0
        second[rank == 0] = 0
        key = rank * (rank.max() + 1) + second if rank.max() < 1 << 31 else rank
        _, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64)
        span *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def _narrow(numbers: np.ndarray, array: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray, right: bool) -> np.ndarray:
    """Within each [low, high) of the array, the bound of ``want`` at the word ``depth`` of the suffixes: a binary search of all at once."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        at = np.minimum(array[np.minimum(mid, len(array) - 1)] + depth, len(numbers) - 1)
        less = (numbers[at] <= want if right else numbers[at] < want) & open_
        low = np.where(less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def matches(numbers: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place where a window occurs: the place, the benchmark suffix, and the longest verbatim match of that suffix in this shard."""
    none = np.zeros(0, np.int64)
    if not block.least or not len(numbers):
        return none, none, none
    numbers = np.append(numbers, 0)
    gaps = np.flatnonzero(numbers == 0)
    run = gaps[np.searchsorted(gaps, np.arange(len(numbers)))] - np.arange(len(numbers))  # known words from here on
    starts = np.flatnonzero(run >= block.least)
    if not len(starts):
        return none, none, none
    # words outside of every run of the least length cannot be part of a match; the array is built over what is left
    inside = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + block.least, -1)
    live = np.flatnonzero((np.cumsum(inside[:-1]) > 0) | (numbers == 0))
    live = live[(numbers[live] != 0) | (np.diff(live, prepend=-1) > 0) & (np.append(numbers[live][1:], 1) != 0) | (np.arange(len(live)) == len(live) - 1)]
    packed = numbers[live]
    home = np.full(len(numbers), -1, np.int64)
    home[live] = np.arange(len(live))
    deepest = int(block.left.max())
    array = suffix_array(packed, home[starts], deepest)
    low, high = np.zeros(len(block.at), np.int64), np.full(len(block.at), len(array), np.int64)
    longest = np.zeros(len(block.at), np.int64)
    found_low, found_high = np.zeros(len(block.at), np.int64), np.zeros(len(block.at), np.int64)
    active = np.arange(len(block.at))
    depth = 0
    while len(active):
        active = active[block.left[active] > depth]
        if not len(active):
            break
        want = block.numbers[block.at[active] + depth]
        a = _narrow(packed, array, low[active], high[active], depth, want, False)
        b = _narrow(packed, array, a, high[active], depth, want, True)
        depth += 1
        active, a, b = active[a < b], a[a < b], b[a < b]
        low[active], high[active], longest[active] = a, b, depth
        whole = block.need[active] == depth
        found_low[active[whole]], found_high[active[whole]] = a[whole], b[whole]
    count = found_high - found_low
    suffix = np.repeat(np.arange(len(block.at)), count)
    at = np.arange(len(suffix)) - np.repeat(np.cumsum(count) - count, count) + found_low[suffix]
    return live[array[at]], suffix, longest[suffix]


def _hits(column: pa.Array, blocks: list[Block]) -> Iterator[tuple]:
    """For each run of rows: first row, end row, the words of each row, and of each place found its row, its first and end word in
    the row, its item's id and the longest match there."""
    for first, end, data, offsets in text_views(column):
        starts, _, row, h = words(data, offsets, ALNUM_WORD)
        cuts = np.searchsorted(row, np.arange(end - first + 1))
        begin = cuts + np.arange(end - first + 1)
        found = []
        for block in blocks:
            # a place of number 0 between documents, so that no match crosses one
            numbers = np.zeros(len(h) + (end - first), np.int64)
            numbers[np.arange(len(h)) + row] = block.number(h)
            place, suffix, longest = matches(numbers, block)
            doc = np.searchsorted(begin, place, side="right") - 1
            at, ids = place - begin[doc], np.array([*block.ids, None], object)[block.item[suffix]]
            found.append((doc, at, at + block.need[suffix], ids, longest))
        yield first, end, np.diff(cuts), *(np.concatenate(x) for x in zip(*found, strict=True))


def _search(blocks: list[Block], key: list[str]):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, n_words, doc, low, high, ids, longest in _hits(batch.column("text"), blocks):
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(end - first + 1))
                spans: list[list[int]] = [[] for _ in range(end - first)]
                items: list[list[str]] = [[] for _ in range(end - first)]
                most = np.zeros(end - first, np.int64)
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[k] : cuts[k + 1]]
                    spans[k], items[k], most[k] = merge(low[own], high[own]), sorted(set(ids[own].tolist()) - {None}), longest[own].max()
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, end - first) for c in key), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(most)],
                    [*key, "n_words", "spans", "items", "longest_match"],
                )

    return run


def _clean(blocks: list[Block]):
    """The rows without a hit, with all their columns."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, _, _, doc, *_ in _hits(batch.column("text"), blocks):
                keep[first + doc] = False
            yield batch.filter(pa.array(keep))

    return run


def merge(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """The union of spans as a flat list: start, end, start, end."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
    return np.column_stack([s[new], e[np.append(new[1:], len(s)) - 1]]).ravel().tolist()


def blocks(benchmark: DataFrame, window: int, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks of ``limit`` bytes, each read, used and dropped in turn."""
    ids: list[str | None] = []
    texts: list[str | None] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        if ids and size + len(r["text"] or "") > limit:
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"] or "")
    yield Block(ids, texts, window)


def passes(benchmark: DataFrame, window: int, limit: int) -> Iterator[list[Block]]:
    """The blocks in the groups that are searched for in one pass."""
    every = blocks(benchmark, window, limit)
    while group := list(islice(every, AT_ONCE)):
        yield group


FOUND = "doc_id long, n_words long, spans array<long>, items array<string>, longest_match long"


def union(spans: Column) -> Column:
    """The union of spans in a flat list, as a flat list."""
    pairs = F.array_sort(F.transform(F.filter(spans, lambda x, i: i % 2 == 0), lambda x, i: F.struct(x.alias("s"), F.get(spans, 2 * i + 1).alias("e"))))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def add(held: Column, x: Column) -> Column:
        last = F.element_at(held, -1)
        longer = F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(F.size(held) == 0, F.array(x)).when(F.element_at(held, F.when(F.size(held) > 0, -1).otherwise(1))["e"] >= x["s"], longer).otherwise(F.concat(held, F.array(x)))

    return F.flatten(F.transform(F.aggregate(pairs, none, add), lambda x: F.array(x["s"], x["e"])))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, spans of hit words, item ids found and the longest verbatim match in words."""
    bound_batches(docs.sparkSession, CHUNK_BYTES)
    first, *more = islice(every := passes(benchmark, window, limit), 2)
    if more:
        rows = materialise(docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id()), "rows")
        # each pass is written before the blocks of the next are read
        parts = [materialise(rows.mapInArrow(_search(b, ["__row", "doc_id"]), "__row long, " + FOUND), "found") for b in chain([first, *more], every)]
        met = reduce(DataFrame.unionByName, parts).groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest_match").alias("longest_match"))
        whole = met.drop("__row").withColumn("spans", union(F.col("spans")))
    else:
        whole = docs.select("doc_id", "text").mapInArrow(_search(first, ["doc_id"]), FOUND)
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return whole.withColumn("n_hit", hit)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows without a hit word, with the columns of ``docs``; each row is judged by its own text, and none is shuffled. A pass
    takes what the pass before has left."""
    bound_batches(docs.sparkSession, CHUNK_BYTES)
    # columns go by their place, as no name may be odd for a function over batches
    rows = docs.toDF(*["text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)])
    for k, group in enumerate(passes(benchmark, window, limit)):
        rows = (materialise(rows, "rows") if k else rows).mapInArrow(_clean(group), rows.schema)
    return rows.toDF(*docs.columns)


def op9_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def words_sql(source: str) -> str:
    return rf"list_filter(regexp_split_to_array(translate(coalesce({source}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


HITS_SQL = f"""
d AS (SELECT doc_id, {words_sql('text')} AS w FROM {{docs}}),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS k FROM (SELECT item_id, {words_sql('text')} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
ks AS (SELECT DISTINCT k FROM b),
p AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks)),
m AS (SELECT doc_id, i, p.k, item FROM p JOIN g ON p.k = g.k AND p.g = g.g),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
"""
ORACLE_SQL = "WITH " + HITS_SQL.replace("{docs}", "documents") + """
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

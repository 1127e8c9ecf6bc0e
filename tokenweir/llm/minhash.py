"""Near-duplicate documents by SuperMinHash, banding, verification and union-find grouping.

A document's set is its distinct 4-word shingles as 64-bit hashes (the whole sequence where it has fewer words). Each
shingle seeds a random permutation of the signature's places; its j-th place is offered j plus a fraction, so the ranks of
one shingle are correlated and signatures vary less than with independent hashes. All shingles of a run of documents take
step j together, and a document leaves as soon as no later step can lower its signature.

Equal sets are one class from the start. Classes of equal bands are candidates: in each bucket the member that shares most
buckets is the pivot and is compared with the rest on their full sets, which joins a large group of copies in one round; a
bucket of SMALL members at most is compared throughout.

Large buckets that still hold several components are settled by shingles instead of by comparing all pairs. Similar texts
share 0.8 of either's shingles, so a text of which fewer are also in a text of another component can have no link to one and
goes. Of what is left, shingles are put in order from rare to frequent, and texts meet by the first fifth of theirs, which
similar texts have one of in common (a prefix filter; how far up a shingle stands bounds what may follow it). Texts outside
of a shingle's largest component are compared with all of the shingle's texts of other components. Where frequent shingles
would need many of these comparisons, all texts first meet a pivot of the largest component, and the steps are repeated with
the components found. No link between texts that share a bucket is lost.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; a null doc_id is linked
with nothing, has no component and is kept; rows of one doc_id are one node, which all its texts link; extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, PLAIN_WORD, bound_batches, int64, materialise, mix, quoted, released, sieved, small, text_views, words
from .components import components

PLACES = 128
#: 32 bands of 4 places: a pair of similarity 0.8 meets in none of them with a probability under 1e-7.
BANDS = 32
SHINGLE = 4
SIMILAR = 80
SMALL = 12
#: Comparisons for each text of a shingle, on average, from which on pivots come first. It chooses a way, not a result.
MANY = 1000
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Shingles that take a step together; their permutations are held, a byte for each place.
_TOGETHER = 1 << 17


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles of each text of a run, sorted by both."""
    _, _, row, h = words(data, offsets, PLAIN_WORD)
    if not len(h):
        return row, h
    n = np.bincount(row, minlength=len(offsets) - 1)
    # each place of a shingle has its own odd factor, and short sequences a seed of their own
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    full = len(h) - size + 1
    parts = []
    if full > 0:
        at = np.flatnonzero(row[:full] == row[size - 1 :])
        total = np.zeros(len(at), np.uint64)
        for k in range(size):
            total += h[at + k] * factors[k]
        parts.append((row[at], mix(total)))
    short = np.flatnonzero((n[row] < size) & np.append(True, row[1:] != row[:-1]))
    total = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        more = k < n[row[short]]
        total[more] += h[short[more] + k] * factors[k]
    parts.append((row[short], mix(total + n[row[short]].astype(np.uint64))))
    row, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))
    return row[new], h[new]


def signatures(row: np.ndarray, h: np.ndarray, rows: int, places: int = PLACES) -> np.ndarray:
    """The SuperMinHash signature of each row's set: per place the least of step + fraction, as step in the top byte and fraction below."""
    out = np.full((rows, places), np.iinfo(np.uint64).max, np.uint64)
    cuts = np.searchsorted(row, np.arange(rows + 1))
    first = 0
    while first < rows:
        last = int(np.searchsorted(cuts, cuts[first] + _TOGETHER, side="right")) - 1
        last = min(max(last, first + 1), rows)
        for at in range(cuts[first], cuts[last], _TOGETHER):  # a set larger than that takes all its steps in turn
            end = min(at + _TOGETHER, cuts[last])
            _offer(out, row[at:end], h[at:end], places)
        first = last
    return out


def _offer(out: np.ndarray, row: np.ndarray, h: np.ndarray, places: int) -> None:
    flat = out.reshape(-1)
    seed, own = mix(h ^ np.uint64(0x2545F4914F6CDD1D)), row.astype(np.int64)
    order = None
    for step in range(places):
        draw = mix(seed + np.uint64((step + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        swap = step + ((draw & np.uint64(0xFFFFFF)) * np.uint64(places - step) >> np.uint64(24)).astype(np.int64)
        if order is None:
            place = swap
        else:
            at = np.arange(len(own))
            place = order[at, swap].astype(np.int64)
            order[at, swap] = order[:, step]
        value = (np.uint64(step) << np.uint64(56)) | (draw >> np.uint64(8))
        np.minimum.at(flat, own * places + place, value)
        # a row is done when every place holds a value of this step or an earlier one
        lo, hi = int(own[0]), int(own[-1]) + 1
        ready = np.zeros(hi - lo, bool)
        ready[:] = (out[lo:hi].max(axis=1) >> np.uint64(56)) <= step
        left = ~ready[own - lo]
        if not left.any():
            return
        if step == 0:
            own, seed, swap = own[left], seed[left], swap[left]
            order = np.tile(np.arange(places, dtype=np.uint8), (len(own), 1))
            order[np.arange(len(own)), swap] = 0
        elif not left.all():
            own, seed, order = own[left], seed[left], order[left]


@released
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_views(batch.column("text")):
            row, h = shingles(data, offsets)
            n = np.bincount(row, minlength=end - first)
            sums = np.zeros((2, len(h) + 1), np.uint64)
            np.cumsum(h, out=sums[0, 1:])
            np.cumsum(mix(h + _STEP), out=sums[1, 1:])
            cuts = np.concatenate([[0], np.cumsum(n)])
            marks = sums[:, cuts[1:]] - sums[:, cuts[:-1]]
            sig = signatures(row, h, end - first).reshape(end - first, BANDS, PLACES // BANDS)
            keys = np.zeros((end - first, BANDS), np.uint64) + mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)
            for k in range(PLACES // BANDS):
                keys = mix(keys * _STEP + sig[:, :, k])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (end - first) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(int64(keys.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(n.astype(np.int64)), pa.array(int64(marks[0])), pa.array(int64(marks[1])), lists], ["doc_id", "n", "f1", "f2", "keys"])


@released
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_views(batch.column("text")):
            row, h = shingles(data, offsets)
            cuts = np.searchsorted(row, np.arange(end - first + 1)) * 8
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(h.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), values.cast(pa.binary())], ["id", "set"])


@released
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])


@released
def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a text."""
    for batch in batches:
        sets = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in batch.column("set")]
        first = 0
        while first < len(sets):
            end, size = first, 0
            while end < len(sets) and size < _TOGETHER:
                size += len(sets[end])
                end += 1
            at = np.repeat(np.arange(first, end), [len(x) for x in sets[first:end]])
            own = batch.select(["id", "part", "n", "component"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(int64(np.concatenate(sets[first:end])))], ["id", "part", "n", "component", "s"])
            first = end


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their full sets."""
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    return with_a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")


def _pairs(of: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) that their sizes allow to be similar enough."""
    fits = 100 * F.least("n", "m") >= SIMILAR * F.greatest("n", "m")
    return of.where(fits & (F.col("id") != F.col("pivot"))).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _star(met: DataFrame) -> DataFrame:
    """Members (key, id, n, c) with the pivot of their bucket and its size: the member of most and largest buckets."""
    degree = met.groupBy("id").agg(F.sum("c").alias("degree"))
    best = met.join(degree, "id").groupBy("key").agg(F.max_by(F.struct("id", "n"), F.struct("degree", (-F.col("id")).alias("low"))).alias("p"))
    # written, so that both sides of the join come straight from an exchange and a hot bucket can be split
    best = materialise(best.select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("m")), "pivots")
    return met.join(small(best), "key")


def _test(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return materialise(_with_sets(materialise(pairs, "pairs"), sets).mapInArrow(_linked, "a long, b long, linked boolean"), "tested")


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _fronts(postings: DataFrame) -> DataFrame:
    """Of postings (id, part, n, component, s), a row (key, id, n, component, after) for each shingle of which a text must share one with any
    text similar to it, and how many of its shingles come after. In their order those that no other component has come first
    of all, and meet nothing; then rare ones before frequent ones. A text that has too few others has no row. ``part`` tells the
    texts of one id apart."""
    shared = postings.groupBy("s").agg(F.count("*").alias("k"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    # written, so that both sides of the join come straight from an exchange and a frequent shingle can be split
    met = postings.join(materialise(shared.select("s", "k"), "shared"), "s")
    texts = met.groupBy("id", "part").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.sort_array(F.collect_list(F.struct("k", "s"))).alias("order"))
    left = F.size("order")
    front = left - F.ceil(F.col("n") * SIMILAR / 100).cast("int") + 1
    rows = texts.where(front > 0).select("id", "n", "component", left.alias("left"), F.posexplode(F.slice("order", F.lit(1), F.greatest(front, F.lit(0)))).alias("p", "e"))
    return rows.select(F.col("e.s").alias("key"), "id", "n", "component", (F.col("left") - 1 - F.col("p")).alias("after"))


def _across(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs (a < b) of rows and others (key, id, n, component, after) of one key that may be similar and are of different
    components. The first shingle that two texts share has all others that they share after it."""
    other = others.select("key", F.col("id").alias("i"), F.col("n").alias("m"), F.col("component").alias("of"), F.col("after").alias("behind"))
    fits = 100 * F.least("n", "m") >= SIMILAR * F.greatest("n", "m")
    room = (100 + SIMILAR) * (1 + F.least("after", "behind")) >= SIMILAR * (F.col("n") + F.col("m"))
    return rows.join(other, "key").where((F.col("component") != F.col("of")) & fits & room).select(F.least("id", "i").alias("a"), F.greatest("id", "i").alias("b")).distinct()


def _rest(opened: DataFrame, sets: DataFrame, tested: DataFrame, same: DataFrame, found: DataFrame) -> DataFrame:
    """The components, once every text of ``opened`` (id) has met those of other components that it can be similar to."""
    for first in (True, False):
        texts = _labelled(opened, found).join(sets, "id").select("id", F.xxhash64("set").alias("part"), (F.octet_length("set") / 8).cast("long").alias("n"), "component", "set")
        fronts = materialise(_fronts(materialise(texts.mapInArrow(_exploded, "id long, part long, n long, component long, s long"), "shingles")), "fronts")
        parts = fronts.groupBy("key", "component").agg(F.count("*").alias("c"), F.min(F.struct("id", "n", "after")).alias("first"))
        of_key = parts.groupBy("key").agg(F.sum("c").alias("c"), F.count("*").alias("parts"), F.max("c").alias("most"), F.max_by(F.struct("component", "first"), F.struct("c", "component")).alias("home"))
        of_key = materialise(of_key.where("parts > 1").select("key", "c", "most", "home.component", "home.first"), "keys")
        # frequent shingles of many texts outside of their largest component: a pivot of it comes first, and all steps once more
        work = of_key.agg(F.sum((F.col("c") - F.col("most")) * F.col("c")).alias("n"), F.sum("c").alias("rows")).first()
        pivots = of_key.select("key", "first.id", "first.n", "component", "first.after")
        if first and (work["n"] or 0) > MANY * (work["rows"] or 1):
            pairs = _across(pivots, fronts)
        else:
            outside = fronts.join(of_key.select("key", F.col("component").alias("home")), "key").where("component <> home").drop("home")
            pairs, first = _across(outside, fronts), False
        more = _test(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), sets)
        tested = tested.unionByName(more)
        found = components(tested.where("linked").select("a", "b").unionByName(same))
        if not first:
            return found
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    bound_batches(docs.sparkSession, CHUNK_BYTES)
    signed = materialise(docs.select("doc_id", "text").mapInArrow(_signed, "doc_id long, n long, f1 long, f2 long, keys array<long>"), "signed")
    full = signed.where("n > 0 and doc_id is not null")
    # classes of equal sets, by two sums over the set; each is known by its smallest doc_id
    classes = materialise(full.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id")), "classes")
    # rows of one doc_id are one node, and those of one set are taken once
    firsts = full.join(classes.select("id").distinct(), full["doc_id"] == F.col("id"), "left_semi").dropDuplicates(["doc_id", "f1", "f2", "n"])
    firsts = materialise(firsts.select("doc_id", "n", "keys"), "firsts")
    members = firsts.select(F.col("doc_id").alias("id"), "n", F.explode("keys").alias("key"))
    full_keys = materialise(members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "keys")
    met = materialise(members.join(small(full_keys), "key"), "members")
    involved = materialise(met.select("id").distinct(), "involved")
    texts = sieved(docs.select("doc_id", "text"), involved.select(F.col("id").alias("d"))).where("__may")
    sets = materialise(texts.join(involved, texts["doc_id"] == involved["id"], "left_semi").select("doc_id", "text").mapInArrow(_sets, "id long, set binary"), "sets", "none")
    # ids of one class that are each a class of another set, as rows of one doc_id differ: tied to the first
    same = full.select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2", "n"]).where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    same = same.join(classes.select(F.col("id").alias("b")).distinct(), "b", "left_semi").select("a", "b")
    star = materialise(_star(met), "star")
    few = met.where(F.col("c") <= SMALL)
    each = few.select("key", F.col("id").alias("pivot"), F.col("n").alias("m")).join(few, "key").where("pivot < id")
    tested = _test(_pairs(star.where(F.col("c") > SMALL)).unionByName(_pairs(each)).distinct(), sets)
    found = components(tested.where("linked").select("a", "b").unionByName(same))

    # the texts of large buckets that hold several components
    marked = _labelled(star.where(F.col("c") > SMALL).select("key", "id", "n"), found)
    split = materialise(marked.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key"), "split")
    opened = materialise(marked.join(split, "key").select("id").distinct(), "opened")
    if not opened.isEmpty():
        found = _rest(opened, sets, tested, same, found)
    of_class = materialise(classes.join(found, "id", "left").select("f1", "f2", "n", F.coalesce("component", "id").alias("component")), "labels")
    empty = signed.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    by_row = full.select("doc_id", "n", "f1", "f2").join(of_class, ["f1", "f2", "n"]).select("doc_id", "n", "component").unionByName(empty)
    return by_row.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op1_minhash_dedup(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of the smallest doc_id of each group, and those without words, with the columns of ``docs``."""
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))

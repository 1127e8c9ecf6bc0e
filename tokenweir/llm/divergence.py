"""How far the sources of a language diverge, term by term, exactly.

Every task counts terms by (lang, source); Spark sums them and keeps each language's terms of at least ``MIN_DOCS`` documents.
A group gives each kept term the smoothed share p, and two shares differ by f = floor((p - q)^2 / (p + q)). The sum of f over
all terms and each pair of sources is made in units of (lang, block of sources, block of sources, chunk of terms), each a task's
bounded work. In a unit the terms that at least a quarter of the language's sources hold are heavy: dense numpy tiles of terms by
sources. The rest are light: what a term adds beyond two absences is a sum over each source's postings (a histogram of counts
against the absent share of every other source) and a correction for each two postings of one term. All are integers, so the
partial sums of heavy and light terms and of all units add up exactly.

Defined cases: null text, lang and source read as ''; a group without terms has share p of count 0 everywhere; a language without
kept terms has value 0 for every pair and no terms; a language of one source has no pairs; repeated rows count as often as they
stand; a null doc_id and extra columns do no harm; an empty table gives no rows; long texts are counted in pieces.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pieces, small

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Counts that a task holds before it gives them away.
_HELD = 400_000
#: Documents of its language that a kept term is in, at least.
MIN_DOCS = 10
SCALE = 1_000_000_000
#: Sources of a block, and postings of a chunk of terms, about.
TILE, CHUNK = 256, 250_000
#: Cells of a tile of terms by sources by sources that are worked on at once.
_CELLS = 1 << 21


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            n, in_docs = len(own), docs[lang, source]
            # a row without a term says that the group is there
            terms = [b"", *own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (n + 1)), pa.array([source] * (n + 1)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *own.values()], pa.int64()), pa.array([0, *map(in_docs.__getitem__, own)], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        counts.clear()
        docs.clear()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("lang", "source")]
        for lang, source, text in zip(*columns, batch.column("text").cast(pa.binary()), strict=True):
            own, seen = counts[lang, source], set()
            for part in pieces(text.as_py(), _BREAK):
                terms = _TERM.findall(part.lower())
                own.update(terms)
                seen.update(terms)
            docs[lang, source].update(seen)
        if sum(map(len, counts.values())) > _HELD:
            yield from given()
    yield from given()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs; each group has a row without a term, too."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = own.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)), exactly at any size."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(11,0)") * wide(n + 2), wide(total + 2 * kept)) + 1


def _share(n: np.ndarray, divisor: np.ndarray) -> np.ndarray:
    """The same on arrays, three digits at a time, so that nothing overflows."""
    rest, out = n.astype(np.int64) + 2, np.zeros(np.broadcast(n, divisor).shape, np.int64)
    out += rest // divisor
    rest = rest % divisor
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // divisor
        rest = rest % divisor
    return out + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _heavy(terms: np.ndarray, a: tuple, b: tuple, absent: np.ndarray) -> np.ndarray:
    """Dense tiles: the sum of f over heavy terms beyond that of absences. a, b: (term, place, p, p of an absence)."""
    out = np.zeros((len(a[3]), len(b[3])), np.int64)
    step = max(1, _CELLS // max(1, out.size))
    for first in range(0, len(terms), step):
        own = terms[first : first + step]
        tiles = []
        for term, place, p, none in (a, b):
            tile = np.repeat(none[None, :], len(own), axis=0)
            at = np.searchsorted(own, term)
            here = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == term)
            tile[at[here], place[here]] = p[here]
            tiles.append(tile)
        out += _gap(tiles[0][:, :, None], tiles[1][:, None, :]).sum(axis=0) - len(own) * absent
    return out


def _light(a: tuple, b: tuple, absent: np.ndarray) -> np.ndarray:
    """Postings against absences, by a histogram of shares, then the pairs of postings of one term."""
    out = np.zeros(absent.shape, np.int64)
    for (_, place, p, _), other, turned in ((a, b[3], False), (b, a[3], True)):
        kinds, times = np.unique(np.stack([place, p]), axis=1, return_counts=True) if len(p) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        none = absent.T if turned else absent
        target = out.T if turned else out
        step = max(1, _CELLS // max(1, len(other)))
        for first in range(0, len(times), step):
            at, own = kinds[0, first : first + step], kinds[1, first : first + step]
            np.add.at(target, at, times[first : first + step, None] * (_gap(own[:, None], other[None, :]) - none[at]))
    order = np.argsort(b[0], kind="stable")
    sorted_terms = b[0][order]
    low, high = np.searchsorted(sorted_terms, a[0], "left"), np.searchsorted(sorted_terms, a[0], "right")
    ends = np.cumsum(high - low)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + _CELLS, "right")))
        n = high[first:last] - low[first:last]
        left = np.repeat(np.arange(first, last), n)
        right = order[np.repeat(low[first:last] - (ends[first:last] - n), n) + np.arange(before, ends[last - 1])]
        i, j, p, q = a[1][left], b[1][right], a[2][left], b[2][right]
        np.add.at(out, (i, j), _gap(p, q) - _gap(p, b[3][j]) - _gap(a[3][i], q) + absent[i, j])
        first = last
    return out


def _in_unit(tile: int) -> Callable:
    return lambda key, postings, groups: _unit(tile, key, postings, groups)


def _unit(tile: int, key: tuple, postings: pa.Table, groups: pa.Table) -> pa.Table:
    lang, a, b, chunk = (k.as_py() for k in key)
    g = {c: groups.column(c).to_numpy() for c in ("place", "total", "kept", "sources")}
    order = np.argsort(g["place"])
    g = {c: x[order] for c, x in g.items()}
    kept, sources = int(g["kept"][0]), int(g["sources"][0])
    sides = [g["place"][g["place"] // tile == k] for k in (a, b)]
    total = np.zeros((len(sides[0]), len(sides[1])), np.int64)
    if kept:
        divisor = {k: g["total"][g["place"] // tile == k] + 2 * kept for k in {a, b}}
        none = [_share(np.zeros(len(divisor[k]), np.int64), divisor[k]) for k in (a, b)]
        absent = _gap(none[0][:, None], none[1][None, :])
        if chunk == 0:
            total += kept * absent
        term = postings.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if postings.num_rows else np.zeros(0, np.int64)
        place, n, held = (postings.column(c).to_numpy() for c in ("place", "n", "held"))
        heavy = held * 4 >= sources
        parts = []
        for k, absence in zip((a, b), none, strict=True):
            own = place // tile == k
            parts.append((own, (term, place - k * tile, _share(n, divisor[k][np.where(own, place - k * tile, 0)]), absence)))
        pick = lambda rows: [(x[0][own & rows], x[1][own & rows], x[2][own & rows], x[3]) for own, x in parts]
        total += _heavy(np.unique(term[heavy]), *pick(heavy), absent) + _light(*pick(~heavy), absent)
    i, j = np.meshgrid(sides[0], sides[1], indexing="ij")
    keep = i != j
    i, j, v = i[keep], j[keep], total[keep]
    if a != b:
        i, j, v = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([v, v])
    return pa.table({"lang": pa.array([lang] * len(v), pa.string()), "place": pa.array(i, pa.int64()), "other": pa.array(j, pa.int64()), "value": pa.array(v, pa.int64())})


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, tile: int = TILE, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(pairs, terms): lang, source, item and value of each two sources of a language, and of each term that a source has more of
    than its language."""
    counts = materialise(term_counts(docs), "counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.count("*").alias("held"), F.min("source").alias("least")).where(F.col("docs") >= min_docs)
    postings = materialise(counts.select("lang", "source", "term", "n").join(kept.select("lang", "term", "all", "held", "least"), ["lang", "term"]), "postings")
    langs = postings.groupBy("lang").agg(F.count(F.when(F.col("source") == F.col("least"), 1)).alias("kept"), F.sum("n").alias("all_total"), F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    places = Window.partitionBy("lang").orderBy("source")  # a row for each source
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "all_total"]).na.fill(1, ["chunks"])
    groups = groups.withColumns({"place": (F.row_number().over(places) - 1).cast("long"), "sources": F.count("*").over(Window.partitionBy("lang"))})
    groups = materialise(groups, "groups")

    placed = postings.join(small(groups.select("lang", "source", "place", "total", "kept", "all_total", "chunks", "sources")), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("all"), F.col("all_total"), F.col("kept"))
    terms = placed.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))

    block = F.floor(F.col("place") / tile)
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / tile))).alias("partner")
    unit = lambda rows, *columns: rows.select("*", block.alias("block"), partner).select("lang", F.least("block", "partner").alias("a"), F.greatest("block", "partner").alias("b"), *columns)
    left = unit(placed, F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"), "term", "place", "n", "held")
    again = groups.select(*[F.col(c).alias(c) for c in groups.columns])  # columns of their own
    right = unit(again, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "place", "total", "kept", "sources")
    key = ["lang", "a", "b", "chunk"]
    made = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_in_unit(tile), "lang string, place long, other long, value long")
    summed = made.groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))
    names = small(groups.select("lang", "place", "source"))
    others = small(groups.select("lang", F.col("place").alias("other"), F.col("source").alias("item")))
    pairs = summed.join(names, ["lang", "place"]).join(others, ["lang", "other"]).select("lang", "source", "item", "value")
    return pairs, terms


#: Terms of a group that are reported.
TOP = 10


def op11_divergence(docs: DataFrame) -> DataFrame:
    """All pairs with their ranks, and the first ``TOP`` terms of each group."""
    pairs, terms = divergences(docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= TOP))


LETTERS = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LETTERS}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS t FROM kept GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY ALL),
g AS (SELECT d.lang, d.source, coalesce(any_value(l.v), 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0)::BIGINT AS t FROM d LEFT JOIN l ON d.lang = l.lang GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, (1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.t + 2 * g.v))::BIGINT AS p FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT kept.lang, kept.term, (1 + ({SCALE}::HUGEINT * (kept.n + 2)) // (l.t + 2 * l.v))::BIGINT AS q FROM kept JOIN l ON kept.lang = l.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y ON x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.lang = a.lang AND y.source = b.source), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value::BIGINT, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms) WHERE rank <= {TOP}
"""

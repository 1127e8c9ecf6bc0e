"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions alone.

A line is compared as its words, lower-cased, with runs of white space as one space. A line that holds a word goes when an
earlier line (by doc_id, text hash, place) is equal to it, however short. A line of NEAR_WORDS words or more (an argument)
also goes when an earlier one is one word edit away: a word replaced, inserted or deleted. What has no white space is one
word, so such a line goes only if it is equal. Edits are whole words: a line has about 200 times as many variants by letters.

Equal lines are grouped by two hashes. Near ones: every variant of a line within the bound is emitted as a hashed key,
its words with one place blanked (replacement) or left out (deletion), and its full form at every place (insertion). A key
holds the place and the number of words, so lines that share one are within the bound of each other and the earliest line
of a key stands for all of it: groups are summed up to their earliest line, never expanded into pairs. Each line found is
then compared with that earliest line word by word.

To keep variants few, only lines that share a part are expanded, and only at its open places. Two lines within the bound agree
in nearly half of the shorter one's words, the first or the last: lines that share such a half with no other line go first.
For the rest, let m be the words of the shorter line of a pair and q = m // PARTS: the edit lies in one of PARTS parts (4 for
short lines) while q words of each other part stay at a fixed distance from the front or the end. This drops no pair.

Defined cases: a null text stays null and has no lines; lines of no words stay; rows of one doc_id and equal text are
judged alike; a null doc_id comes first; extra columns pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, once, quoted, sieved, small

#: Fewest words of a line that goes for a near one.
NEAR_WORDS = 6
#: Words in a block of a prefix hash: variants of a line of n words cost n * STRIDE, not n * n.
STRIDE = 64
_FIRST = -(1 << 63)


#: Parts of a line of at least LONG words that are kept but for one; of a shorter line there are SHORT_PARTS.
PARTS, SHORT_PARTS, LONG = 8, 4, 16


def _flat(line: Column) -> Column:
    """Lower-cased lines with each run of white space as one space and none at the ends. Few lines need more than a look."""
    odd = reduce(Column.__or__, [F.contains(line, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(line))


def _front(line: Column, words: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), words)


def _half(n: Column) -> Column:
    """Nearly half of n words: the next 2**k or 3 * 2**k below, so that lines of n and n - 1 words mostly have the same."""
    q = F.pow(F.lit(2.0), F.floor(F.log2(F.floor(n / 2)) + 1e-9))
    return F.when(F.floor(n / 2) >= 1.5 * q, 1.5 * q).otherwise(q).cast("int")


def _halves(line: Column, f: Column) -> Column:
    return F.array(F.xxhash64(F.lit(0), f, _front(line, f)), F.xxhash64(F.lit(1), f, _front(line, -f)))


def _parts(m: Column) -> Column:
    return F.when(m >= LONG, PARTS).otherwise(SHORT_PARTS)


def _frames(line: Column, m: Column) -> Column:
    """A key for each part t that may differ, as a partner of ``m`` words at least has it: t parts kept at the front, the others at the end."""
    parts, q = _parts(m), F.greatest(F.lit(1), F.floor(m / _parts(m)).cast("int"))
    out = []
    for t in range(PARTS):
        front, back = _front(line, q * t) if t else F.lit(""), _front(line, q * (F.lit(t + 1) - parts))
        out.append(F.when(parts > t, F.xxhash64(F.lit(t), q, parts, front, F.when(parts > t + 1, back).otherwise(F.lit("")))))
    return F.array(*out)


def _size(line: Column) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("int")


def _hashed(docs: DataFrame, near_words: int) -> DataFrame:
    """A light row for each line that may go: its place, hashes, words, halves if it may go for a near one, and a number; no text."""
    at = docs.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("d"), F.xxhash64("text").alias("x"), F.posexplode(F.split(F.lower("text"), "\n")).alias("p", "line"))
    at = at.withColumn("line", once(_flat(F.col("line")))).where("line <> ''").withColumn("n", _size(F.col("line")))
    at = at.withColumn("f", F.when(F.col("n") >= near_words, _half(F.col("n")))).withColumn("f1", _half(F.col("n") - 1))
    own, less = (_halves(F.col("line"), F.col(f)) for f in ("f", "f1"))
    # a line may have another half beside one of a word less
    halves = F.when(F.col("f").isNull(), F.array().cast("array<long>")).when(F.col("f") == F.col("f1"), own).otherwise(F.concat(own, less))
    return at.select("d", "x", "p", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), halves.alias("halves"), F.monotonically_increasing_id().alias("lid"))


def _chain(w: Column, n: Column) -> Column:
    """Hashes of the first 0, 1, ... n words: a chain over blocks, and the words of a block after it."""
    blocks = F.when(n >= STRIDE, F.sequence(F.lit(1), F.floor(n / STRIDE).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.array(F.lit(7).cast("long"))
    heads = F.aggregate(blocks, start, lambda acc, b: F.array_append(acc, F.xxhash64(F.element_at(acc, -1), F.array_join(F.slice(w, (b - 1) * STRIDE + 1, STRIDE), " "))))
    return F.struct(heads.alias("heads"), w.alias("w"))


def _prefix(chain: Column, i: Column) -> Column:
    b = F.floor(i / STRIDE).cast("int")
    return F.xxhash64(F.get(chain["heads"], b), F.array_join(F.slice(chain["w"], b * STRIDE + 1, i - b * STRIDE), " "))


def _variants(lines: DataFrame) -> DataFrame:
    """(id, role, v, i): a row for each variant key of each line (id, w, open: low and high of the places that may differ, and whether lengths may)."""
    rows = lines.withColumn("n", F.size("w")).withColumns({"front": _chain(F.col("w"), F.col("n")), "back": _chain(F.reverse("w"), F.col("n"))})
    n, front, back = F.col("n"), F.col("front"), F.col("back")
    key = lambda role, kind, size, i, rest: F.struct(F.lit(role).alias("role"), F.xxhash64(F.lit(kind), size, i, _prefix(front, i), _prefix(back, rest)).alias("v"), i.alias("i"))
    places = lambda o: F.array_distinct(F.flatten(F.transform(o, lambda x: F.sequence(x["low"], x["high"]))))
    rows = rows.withColumns({"all": places(F.col("open")), "mixed": places(F.filter("open", lambda x: x["mixed"]))})
    keys = F.concat(
        F.transform(F.filter("all", lambda i: i < n), lambda i: key(0, 1, n, i, n - 1 - i)),
        F.transform(F.filter("mixed", lambda i: i < n), lambda i: key(1, 2, n - 1, i, n - 1 - i)),
        F.transform("mixed", lambda i: key(2, 2, n, i, n - i)),
    )
    return rows.select("id", F.explode(keys).alias("e")).select("id", "e.role", "e.v", "e.i")


def _equal(light: DataFrame) -> DataFrame:
    """The lines (d, x, p, lid) that an earlier one is equal to."""
    firsts = light.groupBy("h", "g").agg(F.count("*").alias("c"), F.min("d").alias("d0")).where("c > 1").select("h", "g", "d0")
    # written, so that both sides of the join come straight from an exchange and a line of very many copies can be split
    copies = materialise(light.select("d", "x", "p", "h", "g", "lid").join(small(materialise(firsts, "firsts")), ["h", "g"]), "copies")
    within = copies.where("d = d0").withColumn("k", F.row_number().over(Window.partitionBy("h", "g").orderBy("x", "p"))).where("k > 1")
    return materialise(copies.where("d > d0").select("d", "x", "p", "lid").unionByName(within.select("d", "x", "p", "lid")), "equal")


def _candidates(docs: DataFrame, light: DataFrame, equal: DataFrame) -> DataFrame:
    """The lines (id, d, x, p, line) that share a half with another one, numbered in their order; of equal lines the first alone."""
    halves = light.select("lid", "h", "d", "x", "p", F.explode("halves").alias("k"))
    shared = halves.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("k")
    met = halves.join(small(materialise(shared, "halves")), "k").select("lid", "d", "x", "p").distinct()
    met = met.join(equal.select("lid"), "lid", "left_anti")
    wanted = materialise(met.groupBy("d", "x").agg(F.collect_set("p").alias("asked")), "asked")
    ids = docs.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("doc_id"), "text")
    texts = sieved(ids, wanted.select("d")).where("__may").select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("x"), "text")
    held = texts.join(wanted, ["d", "x"]).dropDuplicates(["d", "x"]).select("d", "x", "asked", once(F.split(F.lower("text"), "\n")).alias("lines"))
    held = held.select("d", "x", F.explode(F.transform("asked", lambda p: F.struct(p.alias("p"), F.get("lines", p).alias("line")))).alias("e"))
    held = held.select("d", "x", "e.p", _flat(F.col("e.line")).alias("line"))
    # numbered in their order, so that the earliest line is the least number
    return materialise(held.repartitionByRange("d", "x", "p").sortWithinPartitions("d", "x", "p").withColumn("id", F.monotonically_increasing_id()), "candidates")


def _opened(lines: DataFrame) -> DataFrame:
    """(id, open) of the lines that share a frame with another one: the places that may differ, and whether lengths may."""
    rows = lines.select("id", "line", F.xxhash64("line").alias("h"), _size(F.col("line")).alias("n"))
    # as the shorter line of a pair, or one of equal lengths, and as the longer one
    frames = F.concat(*[_frames(F.col("line"), F.col("n") - k) for k in (0, 1)])
    framed = rows.select("id", "h", "n", F.posexplode(frames).alias("j", "k")).where("k IS NOT NULL")
    shared = framed.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("n").alias("least"), F.max("n").alias("most")).where("a <> b").select("k", (F.col("least") != F.col("most")).alias("mixed"))
    met = framed.select("k", "id", "n", "j").join(small(materialise(shared, "frames")), "k")
    m, t = F.col("n") - F.floor(F.col("j") / PARTS), F.col("j") % PARTS
    parts, q = _parts(m), F.greatest(F.lit(1), F.floor(m / _parts(m)))
    # places from t parts on, up to the others before the end; the end itself is one for an insertion
    asked = F.struct((t * q).cast("int").alias("low"), (F.col("n") - (parts - 1 - t) * q).cast("int").alias("high"), "mixed")
    return met.groupBy("id").agg(F.collect_set(asked).alias("open"))


def repeated_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(d, x, p): doc_id (the least long for null), text hash and place of every line that goes."""
    light = materialise(_hashed(docs, near_words), "lines")
    equal = _equal(light)
    lines = _candidates(docs, light, equal)
    chosen = materialise(lines.join(_opened(lines), "id"), "chosen")
    variants = materialise(_variants(chosen.select("id", "open", F.split("line", " ").alias("w"))), "variants")
    # a replaced word meets a replaced word; a line with a word left out meets the full line
    role = F.col("role")
    best = variants.groupBy("v").agg(F.count("*").alias("c"), F.min(F.when(role <= 1, F.col("id"))).alias("left"), F.min(F.when(role != 1, F.col("id"))).alias("full")).where("c > 1").select("v", "left", "full")
    mate = F.when(role == 2, F.col("left")).otherwise(F.col("full"))
    near = variants.join(best, "v").withColumn("mate", mate).where("mate < id").groupBy("id").agg(F.min(F.struct("mate", "i", "role")).alias("m")).select("id", "m.mate", "m.i", "m.role")
    mine = chosen.select("id", "d", "x", "p", F.split("line", " ").alias("w"))
    both = near.join(mine, "id").join(chosen.select(F.col("id").alias("mate"), F.split("line", " ").alias("u")), "mate")
    i = F.col("i")
    after_w, after_u = F.when(role == 2, i + 1).otherwise(i + 2), F.when(role == 1, i + 1).otherwise(i + 2)
    same = (F.slice("w", F.lit(1), i) == F.slice("u", F.lit(1), i)) & (F.slice(F.col("w"), after_w, F.size("w")) == F.slice(F.col("u"), after_u, F.size("u")))
    return equal.select("d", "x", "p").unionByName(both.where(same).select("d", "x", "p"))


def dedup_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """The documents with ``text`` rid of repeated lines, and n_lines and n_removed in the place of columns of these names; other
    columns as they are. Texts that lose nothing are not shuffled."""
    gone = materialise(repeated_lines(docs, near_words).groupBy("d", "x").agg(F.collect_set("p").alias("gone")), "gone")
    # other columns go as one, so that none can clash
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("__0"), *[quoted(c) for c in names if c not in ("doc_id", "text")]).alias("__row"))
    marked = sieved(rows, gone.select("d"), F.coalesce("doc_id", F.lit(_FIRST)))
    some, rest = marked.where("__may").withColumn("__x", F.xxhash64("text")), marked.where("not __may").withColumn("gone", F.lit(None).cast("array<int>"))
    kept = some.join(gone, (F.coalesce("doc_id", F.lit(_FIRST)) == F.col("d")) & (F.col("__x") == F.col("x")), "left").select("doc_id", "text", "__row", "gone").unionByName(rest.select("doc_id", "text", "__row", "gone"))
    kept = kept.withColumn("__lines", once(F.when(F.col("gone").isNotNull(), F.split("text", "\n"))))
    lines = F.col("__lines")
    n = F.coalesce(F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    own = {"doc_id": F.col("doc_id"), "text": text}
    return kept.select(*[own.get(c, F.col("__row")[c]).alias(c) for c in names], n.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


def op2_line_dedup(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


#: DuckDB: (doc_id, x, p) of the lines that go, from the documents {docs}; variants are whole strings here.
GONE_SQL = r"""
l0 AS (SELECT doc_id, md5(text) AS x, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM {docs} WHERE text IS NOT NULL),
l1 AS (SELECT *, trim(regexp_replace(lower(raw), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line FROM l0),
l AS (SELECT doc_id, x, p, line, string_split(line, ' ') AS w FROM l1 WHERE line <> ''),
e AS (SELECT line, w, min(row(doc_id, p)) AS first FROM l GROUP BY line, w),
f AS (SELECT * FROM e WHERE len(w) >= 6),
v AS (
  SELECT line, first, 1 AS role, unnest(list_transform(range(1, len(w) + 1), lambda i: 'r' || i || ' ' || array_to_string(list_concat(w[1 : i - 1], [chr(1)], w[i + 1 :]), ' '))) AS v FROM f
  UNION ALL SELECT line, first, 2, unnest(list_transform(range(1, len(w) + 1), lambda i: 'd' || array_to_string(list_concat(w[1 : i - 1], w[i + 1 :]), ' '))) FROM f
  UNION ALL SELECT line, first, 3, 'd' || line FROM f),
k AS (SELECT v, min(first) FILTER (role <> 2) AS full_, min(first) FILTER (role <> 3) AS left_ FROM v GROUP BY v HAVING count(*) > 1),
near AS (SELECT DISTINCT line FROM v JOIN k USING (v) WHERE CASE WHEN role = 3 THEN left_ ELSE full_ END < first),
gone AS (SELECT DISTINCT doc_id, x, p FROM l JOIN e USING (line) WHERE row(l.doc_id, l.p) <> e.first OR line IN (SELECT line FROM near))
"""
TEXT_SQL = r"""
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda s, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
FROM {docs} LEFT JOIN (SELECT doc_id AS gd, x, list(p) AS gone FROM gone GROUP BY ALL) ON doc_id = gd AND md5(text) = x
"""
ORACLE_SQL = "WITH " + GONE_SQL.replace("{docs}", "documents") + TEXT_SQL.replace("{docs}", "documents")

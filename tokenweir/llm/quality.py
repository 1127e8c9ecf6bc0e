"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Defined cases: a null text counts as an empty one; a text without words has 0 words and fails the base rules; a null
doc_id, repeated rows and extra columns pass through unchanged. Ratios over nothing are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, quoted

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its no not of on or she that the their they this to was we were which will with you "
    "aber als am auch auf aus bei das dem den der des die du durch ein eine einen einer er es für hat ich ihr im ist man mit nach nicht nur oder sein sich sie sind so über um und von vor war was wie wir zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qui que sa se ses son sur un une vous "
    "al como con de del el ella en entre es esta este ha la las lo los más me mi muy no o para pero por que se sin sobre su sus un una y ya"
).split()


@dataclass(frozen=True)
class Rule:
    """A document is kept while ``low <= measure <= high``; a missing bound does not bind."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Measures are the columns of ``measures``.
RULES = (
    Rule("length", "n_words", low=50, high=10_000_000),
    Rule("word_length", "mean_word_chars", low=2, high=12),
    Rule("symbols", "symbols_per_word", high=0.1),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("bullet_lines", "bullet_line_ratio", high=0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", high=0.3),
    Rule("repeated_windows", "repeat_word_ratio", high=0.5),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """``n_repeat_words`` from the words ``__w``: windows are sorted beside their places, equal neighbours mark both places, and
    each marked place covers up to the next one, three words at most. Texts without a repeated window skip the sort. Each
    step is a column of its own, as an expression named twice in one would be evaluated twice."""
    w, g, placed, marked = (F.col(f"__{x}") for x in ("w", "g", "placed", "marked"))
    last = F.greatest(F.size(w) - 2, F.lit(0))
    df = df.withColumn("__g", F.transform(F.slice(w, 1, last), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    df = df.withColumn("__placed", F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda a, b: (a["h"] == b["h"]) & (F.slice(w, a["i"] + 1, 3) == F.slice(w, b["i"] + 1, 3))  # noqa: E731  equal hashes are confirmed on the words
    pairs = F.zip_with(placed, F.slice(placed, 2, F.greatest(F.size(placed), F.lit(0))), lambda a, b: F.when(same(a, b), F.array(a["i"], b["i"])))
    df = df.withColumn("__marked", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))))
    gaps = F.zip_with(marked, F.slice(marked, 2, F.greatest(F.size(marked), F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("long")).drop("__g", "__placed", "__marked")


def measures(docs: DataFrame) -> DataFrame:
    """Every measure of every whole text beside the columns of ``docs``; a plan without exchange or user function."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[\x20\x09-\x0D]+", "") != "")
    stops = F.array(*[F.lit(x) for x in STOP_WORDS])
    out = docs.withColumn("__w", F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")).withColumn("__lines", lines)
    w, ln = F.col("__w"), F.col("__lines")
    out = _with_repeat_words(out).withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size(ln).cast("long"),
        "n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        "n_stop_words": F.size(F.array_intersect(F.split(lower_ascii(text), r"[\x20\x09-\x0D.,;:!?]+"), stops)).cast("long"),
        "n_bullet_lines": F.size(F.filter(ln, lambda x: F.ltrim(x).rlike(r"^[-*•‣▪]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(ln, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long"),
    }).drop("__w", "__lines")
    # n_repeat_words hangs on a column that is no pure function of the row: a filter above is not pushed below this point, where
    # the optimizer would write the measures out again inside of it
    out = out.withColumn("__at", F.monotonically_increasing_id()).withColumn("n_repeat_words", F.when(F.col("__at") >= 0, F.col("n_repeat_words"))).drop("__at")
    n = F.col("n_words")
    return out.withColumns({
        "mean_word_chars": _ratio(F.col("word_chars"), n),
        "symbols_per_word": _ratio(F.col("n_symbols"), n),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "bullet_line_ratio": _ratio(F.col("n_bullet_lines"), F.col("n_lines")),
        "ellipsis_line_ratio": _ratio(F.col("n_ellipsis_lines"), F.col("n_lines")),
        "repeat_word_ratio": _ratio(F.col("n_repeat_words"), n),
    })


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    kept = F.lit(True)
    for r in rules:
        for bound, keeps in ((r.low, lambda m, b: m >= b), (r.high, lambda m, b: m <= b)):
            if bound is not None:
                kept = kept & keeps(F.col(r.measure), F.lit(bound))
    return kept


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a document breaks."""
    broken = [F.when((F.lit(r.low is not None) & (F.col(r.measure) < F.lit(r.low if r.low is not None else 0))) | (F.lit(r.high is not None) & (F.col(r.measure) > F.lit(r.high if r.high is not None else 0))), F.lit(r.name)) for r in rules]
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measures of each document, ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    marked = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("text"))
    return apply_rules(marked, rules).where("kept").select("row.*")


def op8_quality_rules(docs: DataFrame) -> DataFrame:
    kept = docs.select("doc_id", "text")
    return apply_rules(kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", failed_rules().alias("failed_rules"))


_SQL_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

#: DuckDB: the same measures by list functions over the whole texts.
MEASURES_SQL = r"""
SELECT d.*, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars_raw,
       length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
       len(ln) AS n_lines, len(ln) - len(list_distinct(ln)) AS n_dup_lines,
       len(list_intersect(list_distinct(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D.,;:!?]+')), [{stops}])) AS n_stop_words,
       len(list_filter(ln, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•‣▪]'))) AS n_bullet_lines,
       len(list_filter(ln, lambda x: ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…'))) AS n_ellipsis_lines
FROM (SELECT *, coalesce(text, '') AS t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ln
      FROM {docs}) d
"""
_SQL = r"""
WITH m AS (SELECT row_number() OVER () AS rid, * FROM ({measures})),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM m)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
a AS (SELECT m.* EXCLUDE (word_chars_raw), coalesce(word_chars_raw, 0)::BIGINT AS word_chars, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  list_filter([
    CASE WHEN n_words < 50 OR n_words > 10000000 THEN 'length' END,
    CASE WHEN n_words = 0 OR word_chars / n_words < 2 OR word_chars / n_words > 12 THEN 'word_length' END,
    CASE WHEN n_words > 0 AND n_symbols / n_words > 0.1 THEN 'symbols' END,
    CASE WHEN n_stop_words < 2 THEN 'stop_words' END,
    CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5 THEN 'duplicate_lines' END,
    CASE WHEN n_lines > 0 AND n_bullet_lines / n_lines > 0.9 THEN 'bullet_lines' END,
    CASE WHEN n_lines > 0 AND n_ellipsis_lines / n_lines > 0.3 THEN 'ellipsis_lines' END,
    CASE WHEN n_words > 0 AND n_repeat_words / n_words > 0.5 THEN 'repeated_windows' END], lambda x: x IS NOT NULL) AS failed_rules
  FROM a)
"""
KEPT_SQL = _SQL.replace("{measures}", MEASURES_SQL.replace("{stops}", _SQL_STOPS).replace("{docs}", "documents")) + "SELECT {columns} FROM b WHERE NOT base_failed AND len(failed_rules) = 0"
ORACLE_SQL = _SQL.replace("{measures}", MEASURES_SQL.replace("{stops}", _SQL_STOPS).replace("{docs}", "documents")) + "SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed_rules) = 0 AS kept, failed_rules FROM b"

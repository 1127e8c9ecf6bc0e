"""Positions in the token stream: prefix sums, shards, chunks and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def prefix_sum(df: DataFrame, order: list[str], value: str, start: str = "start", end: str = "end") -> DataFrame:
    """Adds the sum of ``value`` before each row and up to it, in the order given.

    Two passes: rows are range-partitioned and summed within their part, then the parts' totals, a row for each part, are
    summed and joined back. No task holds all rows. The parts are written first, so that both passes see the same ones."""
    parts = materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "parts")
    inner = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = parts.groupBy("__part").agg(F.sum(value).alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    bases = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    out = parts.withColumn("__end", F.sum(value).over(inner)).join(F.broadcast(bases), "__part")
    return out.withColumns({start: (F.col("__base") + F.col("__end") - F.col(value)).cast("long"), end: (F.col("__base") + F.col("__end")).cast("long")}).drop("__part", "__end", "__base")


def skip_first(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The rows after the first ``n`` in the order given: where a scan goes on that has read so many."""
    ranked = prefix_sum(rows.withColumn("__one", F.lit(1).cast("long")), order, "__one", "__rank", "__to")
    return ranked.where(F.col("__rank") >= n).drop("__one", "__rank", "__to")


def after(rows: DataFrame, key: str, last: object) -> DataFrame:
    """The rows behind the last key that a scan has read: a filter that reaches the files. None is before all; a null key is never
    behind one, as scans read null keys first."""
    return rows if last is None else rows.where(F.col(key) > F.lit(last))


def place(rows: DataFrame, key: str, n: Column) -> DataFrame:
    """Adds n, start and end: each row carries its own place, so that rows of a null or repeated key are neither lost nor multiplied.
    Rows of one key stand in the order of a hash of all that they hold."""
    sized = rows.withColumns({"n": n.cast("long"), "__tie": F.xxhash64(*rows.columns)})
    return prefix_sum(sized, [key, "__tie"], "n").drop("__tie")


def doc_offsets(docs: DataFrame, tokens: Column) -> DataFrame:
    """doc_id, n, start and end of each document in the stream; only counts are shuffled."""
    return prefix_sum(docs.select("doc_id", F.size(tokens).cast("long").alias("n"), F.xxhash64("doc_id", "text").alias("__tie")), ["doc_id", "__tie"], "n").drop("__tie")


def window_count(n: Column, length: int, step: int | None = None) -> Column:
    """Windows of ``length`` + 1 tokens in a shard of ``n``."""
    step = length if step is None else step
    if length <= 0 or step <= 0:
        raise ValueError("window length and step must be greater than zero")
    return F.greatest(F.lit(0), F.floor((n - (length + 1)) / step) + 1).cast("long")


def shard_totals(offsets: DataFrame, size: int, length: int, max_shards: int | None = None) -> DataFrame:
    """Tokens, documents touched, fullness and windows of each shard, from offsets alone."""
    span = offsets.where(F.col("end") > F.col("start")).select("start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("shard"))
    tokens = F.least(F.col("end"), (F.col("shard") + 1) * size) - F.greatest(F.col("start"), F.col("shard") * size)
    out = span.groupBy("shard").agg(F.sum(tokens).alias("tokens"), F.count("*").alias("docs"))
    out = out.withColumn("is_full", F.col("tokens") == size).withColumn("windows", window_count(F.col("tokens"), length))
    return out if max_shards is None else out.where(F.col("shard") < max_shards)


def pieces(docs: DataFrame, tokens: dict[str, Column], size: int) -> DataFrame:
    """(shard, first, and a token array for each of ``tokens``): what each document gives to each shard that it touches, and where
    in the shard it begins. A row for each document and boundary, none for a token. ``docs`` must have start and end."""
    return _cut(docs.withColumns(tokens), size, lambda at, n, ends: [F.slice(F.col(c), at, n).alias(c) for c in tokens])


def byte_pieces(docs: DataFrame, text: str, size: int) -> DataFrame:
    """(shard, first, data, ended): the same of texts of an id for each byte and an end id, which are cut as bytes, a quarter of
    their ids and less: they become ids (``tokenizers.byte_pieces``) when they have been dealt out."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return _cut(docs.withColumn("data", data), size, lambda at, n, ends: [F.substring(F.col("data"), at, n).alias("data"), ends.alias("ended")])


def _cut(docs: DataFrame, size: int, of: Callable[[Column, Column, Column], list[Column]]) -> DataFrame:
    """shard, first, and what ``of`` makes of a piece's place in its document (from 1), its ids and whether it ends the document."""
    span = docs.where(F.col("end") > F.col("start")).withColumn("shard", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))))
    low = F.greatest(F.col("start"), F.col("shard") * size)
    high = F.least(F.col("end"), (F.col("shard") + 1) * size)
    return span.select("shard", (low - F.col("shard") * size).alias("first"), *of((low - F.col("start") + 1).cast("int"), (high - low).cast("int"), high == F.col("end")))


def by_shard(parts: DataFrame) -> DataFrame:
    """Pieces dealt out for the ``token_shards`` writer: those of a shard in one task, in order. No shard is ever one row."""
    return parts.repartition("shard").sortWithinPartitions("shard", "first")


def chunks(docs: DataFrame, tokens: dict[str, Column], size: int) -> DataFrame:
    """The token arrays of each shard, in lock-step for several columns, for shards that fit in a row; ``pieces`` is for larger ones."""
    return chunk_pieces(pieces(docs, tokens, size), list(tokens))


def chunk_pieces(cut: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each shard of its pieces (shard, first, and token arrays)."""
    return met_pieces(cut, columns).select("shard", *[F.flatten(F.col(f"parts.{c}")).alias(c) for c in columns])


def met_pieces(cut: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each shard with its pieces in order, as ``parts``; nothing is moved if the pieces of a shard are together already."""
    return cut.select("shard", F.struct("first", *columns).alias("part")).groupBy("shard").agg(F.array_sort(F.collect_list("part")).alias("parts"))


def tail(offsets: DataFrame, size: int, max_shards: int | None = None) -> DataFrame:
    """What a run commits and what it carries over."""
    total = offsets.agg(F.coalesce(F.max("end"), F.lit(0)).alias("total"), F.count("*").alias("source_documents_consumed"))
    shards = F.floor(F.col("total") / size)
    shards = shards if max_shards is None else F.least(shards, F.lit(max_shards))
    out = total.withColumn("next_shard", shards.cast("long"))
    return out.select("next_shard", (F.col("next_shard") * size).alias("committed_tokens"), (F.col("total") - F.col("next_shard") * size).alias("pending_tokens"), "source_documents_consumed")


def windows(shards: DataFrame, column: str, length: int, step: int | None = None, target: str | None = None) -> DataFrame:
    """(shard, window, x, y): each window and the same shifted by one; ``target`` is the column that y comes from."""
    step = length if step is None else step
    n = window_count(F.size(column), length, step)
    at = shards.where(n > 0).withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    first = (F.col("window") * step + 1).cast("int")
    return at.select("shard", "window", F.slice(column, first, length).alias("x"), F.slice(target or column, first + 1, length).alias("y"))


def window_offsets(shards: DataFrame, windows_column: str = "windows") -> DataFrame:
    """First and end of each shard's windows in the whole. The input has a row for each shard."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(windows_column).over(order)
    return shards.withColumn("end_window", end).withColumn("first_window", F.col("end_window") - F.col(windows_column))


def locate(indices: DataFrame, offsets: DataFrame) -> DataFrame:
    """Window indices with their (shard, local), beside what else their rows hold; negative ones count from the end, shards without windows are never met.

    The offsets, a row for each shard, are cut into steps of the least power of two that holds the mean, so that the range
    join becomes an equi-join on the step with a check of the range; nothing is broadcast by hand."""
    total = offsets.agg(F.max("end_window").alias("total"), F.greatest(F.lit(1), (F.max("end_window") / F.count("*")).cast("long")).alias("stride"))
    real = indices.crossJoin(F.broadcast(total)).withColumn("real", F.when(F.col("idx") < 0, F.col("idx") + F.col("total")).otherwise(F.col("idx")))
    real = real.withColumn("real", F.when((F.col("real") < 0) | (F.col("real") >= F.col("total")), F.raise_error(F.lit("window index out of range")).cast("long")).otherwise(F.col("real")))
    real = real.withColumn("bucket", F.floor(F.col("real") / F.col("stride")))
    spans = offsets.where("end_window > first_window").crossJoin(F.broadcast(total)).select("shard", "first_window", "end_window", F.explode(F.sequence(F.floor(F.col("first_window") / F.col("stride")), F.floor((F.col("end_window") - 1) / F.col("stride")))).alias("bucket"))
    met = real.join(spans, "bucket").where((F.col("real") >= F.col("first_window")) & (F.col("real") < F.col("end_window")))
    return met.select(*indices.columns, "shard", (F.col("real") - F.col("first_window")).alias("local"))

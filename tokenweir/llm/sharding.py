"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**14 places. A document's key is a hash of its doc_id (of its text where the id is null); the shard of the
next virtual node clockwise is its home. A shard takes what its capacity allows; keys beyond it continue clockwise to
the next shard with room. Loads are summed for each place (a table bounded by the ring), the walk runs over those sums
on the driver, and every document finds its shard by its rank or its cumulated bytes within its place, so no text moves.

Defined cases: a null text has size 1 and the checksum of an empty one; a null doc_id is kept; repeated rows are placed
one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 1 << 14
VIRTUAL_NODES = 64
SHARDS = 16


@dataclass(frozen=True)
class Stretch:
    """The keys of ``place`` whose load before them lies in [low, high) go to ``shard``; ``base`` rows stand there before."""

    place: int
    low: int
    high: int
    shard: int
    base: int


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, places: int = PLACES) -> list[int]:
    """The home shard of each place."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            at = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") % places
            nodes.setdefault(at, shard)
    owner, home = [0] * places, nodes[min(nodes)]
    for at in range(places - 1, -1, -1):
        home = nodes.get(at, home)
        owner[at] = home
    return owner


def walk(loads: dict[int, int], capacity: list[int], owner: list[int]) -> list[tuple[int, int, int, int]]:
    """(place, low, high, shard) for each stretch of load, keys at home first and what is left clockwise on."""
    room, cuts = list(capacity), []
    nodes: list[tuple[int, int]] = []  # runs of one owner, clockwise: first place, owner
    for at, shard in enumerate(owner):
        if not nodes or nodes[-1][1] != shard:
            nodes.append((at, shard))
    run_of, k = [0] * len(owner), -1
    for at in range(len(owner)):
        k += k + 1 < len(nodes) and nodes[k + 1][0] == at
        run_of[at] = k
    for place in sorted(loads):
        low, left, run = 0, loads[place], run_of[place]
        for step in range(len(nodes)):
            shard = nodes[(run + step) % len(nodes)][1]
            if take := min(left, room[shard]):
                cuts.append((place, low, low + take, shard))
                room[shard] -= take
                low, left = low + take, left - take
            if not left:
                break
        if left:  # rounding only: the last shard named takes it
            cuts.append((place, low, low + left, shard))
    return cuts


def plan(rows: dict[int, int], sizes: dict[int, int], shards: int, law: str, slack: float) -> list[tuple[int, int, int, int]]:
    owner = ring(shards)
    if law == "rows":
        total = sum(rows.values())
        return walk(rows, [total // shards + (s < total % shards) for s in range(shards)], owner)
    total = sum(sizes.values())
    return walk(sizes, [int(-(-total * (1 + slack) // shards))] * shards, owner)


def place_of(key: Column, text: Column) -> Column:
    return F.pmod(F.coalesce(F.when(key.isNotNull(), F.xxhash64(key)), F.xxhash64(text)), F.lit(PLACES)).cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "rows", slack: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document.

    ``law`` "rows": counts differ by one at most. "bytes": a key goes to the shard in whose stretch its first byte falls, so
    a shard exceeds (1 + slack) of the mean by one document at most for each stretch that ends in it."""
    if shards < 1 or law not in ("rows", "bytes"):
        raise ValueError("shards must be positive and law rows or bytes")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), place_of(F.col("doc_id"), F.col("text")).alias("place"))
    sums = keyed.groupBy("place").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()  # PLACES rows at most
    cuts = plan({r["place"]: r["n"] for r in sums}, {r["place"]: r["b"] for r in sums}, shards, law, slack)
    spark = docs.sparkSession
    schema = "place int, low long, high long, to int"
    # one row for each place and one for each time a shard fills up: bounded by the ring, whatever the input
    stretches = F.broadcast(spark.createDataFrame(cuts, schema))
    order = Window.partitionBy("place").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "text_crc32", "size")
    # the k-th document of a place, and the bytes before it
    load = F.row_number().over(order) - 1 if law == "rows" else F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = keyed.withColumn("load", load.cast("long")).withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    # law bytes: a key belongs to the stretch that holds its first byte
    met = placed.alias("k").join(stretches.alias("s"), (F.col("k.place") == F.col("s.place")) & (F.col("load") >= F.col("low")) & (F.col("load") < F.col("high")))
    met = met.select("doc_id", "size", "text_crc32", F.col("k.place").alias("place"), "rank", "low", F.col("to").alias("shard"))
    if law == "rows":
        bases, seen = [], [0] * shards
        for place, low, high, shard in cuts:
            bases.append((place, low, seen[shard]))
            seen[shard] += high - low
        first = F.col("low")
    else:
        counts = {(r["place"], r["low"]): (r["n"], r["first"], r["shard"]) for r in met.groupBy("place", "low", "shard").agg(F.count("*").alias("n"), F.min("rank").alias("first")).collect()}
        bases, seen = [], [0] * shards
        for place, low, _, _ in cuts:
            if (place, low) in counts:
                n, at, shard = counts[place, low]
                bases.append((place, low, seen[shard] - at))
                seen[shard] += n
        first = F.lit(0)
    base = F.broadcast(spark.createDataFrame(bases, "place int, low long, base long"))
    return met.join(base, ["place", "low"]).select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("base") + F.col("rank") - first).alias("slot"))


def op5_sharding(docs: DataFrame) -> DataFrame:
    return shard_documents(docs, SHARDS, "rows").withColumn("grown_shard", F.lit(None).cast("int"))

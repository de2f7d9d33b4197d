"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A key hashes to one of RING_SLOTS places of a ring on which every shard has several virtual nodes. It belongs to the next node
clockwise; if that node's shard is full it goes on clockwise to the next shard that is not. Capacities are floor(n / shards), one
more for the first n mod shards shards, so counts differ by one at most (the law ``rows``) and only the keys above a bound move.

What is global is small: a count per place of the ring comes to the driver (RING_SLOTS rows at most), which turns it into
quotas; every row then finds its shard and its slot from its rank within its place, so rows are exchanged once, by place, and no
task holds more than a place. Order is total but for rows equal in every column, which are interchangeable.

The key is doc_id with the text's size and crc32, so a doc_id that many rows share spreads. Null doc_id and null text are keys
like others (size 1, crc32 0); repeated rows get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING_SLOTS = 1 << 14


def ring(shards: int, virtual: int = 64, slots: int = RING_SLOTS) -> list[int]:
    """The shard that owns each place: the next virtual node clockwise, itself included."""
    nodes: dict[int, int] = {}
    for v in range(virtual):
        for s in range(shards):
            place = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % slots
            while place in nodes:
                place = (place + 1) % slots
            nodes[place] = s
    owner, out = nodes[min(nodes)], [0] * slots
    for place in range(slots - 1, -1, -1):
        owner = nodes.get(place, owner)
        out[place] = owner
    return out


def capacities(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def quotas(counts: dict[int, int], owners: list[int], limits: list[int]) -> dict[int, list[tuple[int, int, int]]]:
    """For each place, pieces (end, shard, shift): the key of rank r < end gets slot r + shift of the shard. Every place first
    fills its own shard; then, one step clockwise after another, what is over goes to the next shard with room."""
    slots, room = len(owners), list(limits)
    following: list[list[int]] = [[] for _ in range(slots)]  # distinct shards clockwise from each place
    order: list[int] = []
    for place in [*range(slots - 1, -1, -1), *range(slots - 1, -1, -1)]:
        s = owners[place]
        if not order or order[0] != s:
            order = [s, *[x for x in order if x != s]]
        following[place] = order
    left = dict(sorted(counts.items()))
    pieces: dict[int, list[tuple[int, int, int]]] = {p: [] for p in left}
    for step in range(len(limits)):
        for place, rest in left.items():
            if rest and step < len(following[place]):
                shard = following[place][step]
                take = min(rest, room[shard])
                if take:
                    done = counts[place] - rest
                    pieces[place].append((done + take, shard, limits[shard] - room[shard] - done))
                    room[shard] -= take
                    left[place] = rest - take
    return pieces


def assign(docs: DataFrame, shards: int = 8, virtual: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("at", F.xxhash64("doc_id", "size", "text_crc32")).withColumn("place", F.pmod("at", F.lit(RING_SLOTS)).cast("int"))
    counts = {r["place"]: r["n"] for r in rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}  # RING_SLOTS rows at most
    table = quotas(counts, ring(shards, virtual), capacities(sum(counts.values()), shards))
    schema = "place int, pieces array<struct<end: long, shard: int, shift: long>>"
    quota = spark.createDataFrame([(p, x) for p, x in table.items()], schema)
    rank = (F.row_number().over(Window.partitionBy("place").orderBy("at", "doc_id", "size", "text_crc32")) - 1).cast("long")
    ranked = rows.withColumn("r", rank).join(F.broadcast(quota), "place")
    hit = F.filter("pieces", lambda p: F.col("r") < p["end"])[0]
    return ranked.withColumn("hit", hit).select("doc_id", "size", "text_crc32", F.col("hit.shard").alias("shard"), (F.col("r") + F.col("hit.shift")).alias("slot"))

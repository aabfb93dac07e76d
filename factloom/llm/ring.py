"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has ``2**ring_bits`` positions; ``vnodes`` virtual nodes of each shard lie on it. A key belongs to
the position given by the top bits of ``xxhash64(key)`` and walks clockwise to the first virtual node whose
shard has room. All keys of one position meet the virtual nodes in the same order, so the walk is decided on
the counts of the positions: a histogram whose size is a parameter (``2**ring_bits`` rows at most), never on
the keys. Rows then find their place by their rank within their position.

Capacities are counts of rows, floor(n / shards) or one more, and sum to n: when every key is placed, every
shard is full, so counts differ by at most one whatever the keys are. Only keys beyond a shard's capacity
leave their ring shard, which keeps movement small when shards are added.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import no_clash


def _vnodes(shards: int, vnodes: int, ring_bits: int) -> list[tuple[int, int]]:
    def place(s: int, v: int) -> int:
        return int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") >> (64 - ring_bits)

    return sorted((place(s, v), s) for s in range(shards) for v in range(vnodes))


def ring_plan(counts: dict[int, int], shards: int, vnodes: int, ring_bits: int) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(position, rank from, rank to, shard, first slot)`` covering every key of every position.

    Positions arrive clockwise from 0. A shard that is full drops out of the ring, at most ``shards`` times,
    and the successor of each position among the rest is found again.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    ring = _vnodes(shards, vnodes, ring_bits)

    def open_ring() -> tuple[list[int], list[int]]:
        left = [(p, s) for p, s in ring if used[s] < room[s]]
        return [p for p, _ in left], [s for _, s in left]

    places, owners = open_ring()
    runs = []
    for pos in sorted(counts):
        lo, n = 0, counts[pos]
        while lo < n:
            i = bisect.bisect_left(places, pos)
            s = owners[i if i < len(owners) else 0]
            take = min(n - lo, room[s] - used[s])
            runs.append((pos, lo, lo + take, s, used[s]))
            used[s] += take
            lo += take
            if used[s] == room[s]:
                places, owners = open_ring()
    return runs


def _runs_frame(df: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The runs as a frame, from one literal: no RDD and no Python worker. At most positions + shards rows."""
    text = ";".join(",".join(map(str, r)) for r in runs)
    cell = F.split(F.col("run"), ",")
    names = ("_pos", "_from", "_to", "shard", "_slot")
    one = df.sparkSession.range(1).select(F.explode(F.split(F.lit(text), ";")).alias("run")).where(F.col("run") != "")
    return one.select(*(cell[i].cast("int" if n in ("_pos", "shard") else "bigint").alias(n) for i, n in enumerate(names)))


def shard_by_ring(
    df: DataFrame, key: str, columns: dict[str, Column], shards: int = 16, vnodes: int = 64, ring_bits: int = 14
) -> DataFrame:
    """``key``, the given ``columns``, and each row's ``shard`` and gapless ``slot`` there.

    Every input row gives one output row. Rows without a key go by their columns, so that a table of many of them
    fills all positions; repeated rows (same key and columns) are counted before the shuffle and get neighbouring
    slots; an empty input gives an empty result. Only ``key`` and ``columns`` are read; a column must not be called
    ``shard``, ``slot`` or like the key.
    """
    no_clash((key, "shard", "slot"), tuple(columns))
    names = [f"_c{i}" for i in range(len(columns))]
    top = lambda h: F.shiftrightunsigned(h, 64 - ring_bits).cast("int")
    pos = F.when(F.col("_key").isNull(), top(F.xxhash64(*names)) if names else F.lit(0)).otherwise(top(F.xxhash64("_key")))
    rows = df.select(F.col(key).alias("_key"), *(c.alias(n) for c, n in zip(columns.values(), names, strict=True)))
    # The histogram reads keys only; the other columns just for rows without one.
    with_key = df.select(F.col(key).alias("_key")).where("_key IS NOT NULL").select(top(F.xxhash64("_key")).alias("_pos"))
    histogram = with_key.union(rows.where("_key IS NULL").select(pos.alias("_pos"))).groupBy("_pos").count()
    found = histogram.collect()  # 2**ring_bits rows at most
    runs = _runs_frame(df, ring_plan({r["_pos"]: r["count"] for r in found}, shards, vnodes, ring_bits))
    rows = rows.groupBy("_key", *names).agg(F.count(F.lit(1)).alias("_n")).withColumn("_pos", pos)
    order = Window.partitionBy("_pos").orderBy(F.xxhash64("_key"), "_key", *names)
    rows = rows.withColumn("_end", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_rank", F.explode(F.sequence(F.col("_end") - F.col("_n"), F.col("_end") - 1)))
    there = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = rows.join(F.broadcast(runs), "_pos").where(there)  # runs are bounded by the ring's parameters
    return placed.select(
        F.col("_key").alias(key),
        *(F.col(n).alias(c) for c, n in zip(columns, names, strict=True)),
        "shard",
        (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"),
    )

"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

Every shard owns `vnodes` points of a ring. A document belongs to the first point clockwise of its own
hash; the documents between two points form an arc and are ranked inside it, by blocks of the ring whose number
grows with the rows. Capacities are the row
counts floor or ceil of n / shards, so their sum is n: where a shard is full, what remains of an arc's
ranks goes on clockwise. The walk needs only the number of documents per arc, so the driver sees
shards x vnodes counts whatever the input, and sends back ranges of ranks.

Law `rows`: counts of any two shards differ by one at most. Slots are gapless and need no further
sort: a range of ranks occupies a range of slots. Where an order of the rows is given, slots follow it.
Movement is limited but not least: exact row counts leave no slack, so documents near a full shard's
end go on to the next one when others come.

Defined cases: null text is empty; null doc_ids are hashed by text; rows equal in doc_id and text tie
and share out neighbouring ranks; texts are measured whole, however long; an empty table gives an empty
result; other columns pass through, and one named like an added column gets `_` behind its name.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized_join, staged

#: The ring has 2**63 places; an arc is looked up in one of 2**13 equal cells of it.
RING_BITS, CELL_BITS = 63, 13

#: Rows that are ranked together in one block of the ring, about.
BLOCK_ROWS = 50_000


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted (place, shard) of all virtual nodes; they depend on nothing but shard and replica number."""
    point = lambda s, v: int.from_bytes(hashlib.sha256(f"shard {s} node {v}".encode()).digest()[:8], "big") >> 1
    return sorted((point(s, v), s) for s in range(shards) for v in range(vnodes))


def fill_clockwise(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Ranges (arc, first rank, end rank, shard, first slot, hops): each arc's keys go to the first owner with room."""
    room, used = list(capacity), [0] * len(capacity)
    waiting = [deque([(arc, 0, n, 0)] if n else []) for arc, n in enumerate(counts)]
    ranges, busy = [], any(counts)
    while busy:
        busy, moving = False, []
        for at, shard in enumerate(owners):
            while waiting[at] and room[shard]:
                arc, lo, hi, hops = waiting[at].popleft()
                take = min(hi - lo, room[shard])
                ranges.append((arc, lo, lo + take, shard, used[shard], hops))
                room[shard] -= take
                used[shard] += take
                if lo + take < hi:
                    waiting[at].appendleft((arc, lo + take, hi, hops))
            moving += [(at, x) for x in waiting[at]]
            waiting[at].clear()
        for at, (arc, lo, hi, hops) in moving:
            waiting[(at + 1) % len(owners)].append((arc, lo, hi, hops + 1))
            busy = True
    return ranges


def arc_blocks(rows: int, arcs: int) -> int:
    """Bits of a number of equal blocks of the ring, so that a block holds some BLOCK_ROWS rows whatever the input; no fewer blocks than arcs."""
    bits = max(arcs - 1, 1).bit_length()
    while rows > BLOCK_ROWS << bits:
        bits += 1
    return bits


def ranked_on_ring(rows: DataFrame, n: int, points: list[tuple[int, int]], shards: int) -> DataFrame:
    """rows with place (on the ring), size and crc: adds shard, ring_slot (gapless in its shard) and hops."""
    spark, places, owners = rows.sparkSession, [p for p, _ in points], [s for _, s in points]
    width, bits = 1 << (RING_BITS - CELL_BITS), arc_blocks(n, len(points))
    cells = []
    for cell in range(1 << CELL_BITS):
        a, b = bisect_left(places, cell * width), bisect_left(places, (cell + 1) * width)
        cells.append((cell, [(places[k], k) for k in range(a, b)], b % len(points)))
    cell_table = spark.createDataFrame(cells, "cell int, nodes array<struct<place: long, arc: int>>, next int")

    def with_arc(df: DataFrame) -> DataFrame:
        node = F.filter("nodes", lambda x: x["place"] >= F.col("place"))
        dealt = df.withColumn("cell", F.shiftright("place", RING_BITS - CELL_BITS).cast("int")).join(F.broadcast(cell_table), "cell")  # 2 ** CELL_BITS rows
        return dealt.withColumns({"arc": F.coalesce(F.get(node, F.lit(0))["arc"], F.col("next")), "block": F.shiftright("place", RING_BITS - bits)}).drop("nodes", "next", "cell")

    # A row's rank in its arc: the rows of the arc's blocks before its own, and its rank in the block.
    blocks = staged(with_arc(rows.select("place")).groupBy("arc", "block").agg(F.count(F.lit(1)).alias("n")), "arc-blocks")
    before = Window.partitionBy("arc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("arc", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    counts = [0] * len(points)
    for r in blocks.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # at most shards x vnodes rows
        counts[r["arc"]] = r["n"]
    total = sum(counts)
    ranges = fill_clockwise(counts, owners, [total // shards + (s < total % shards) for s in range(shards)])
    range_table = spark.createDataFrame(ranges, "arc int, lo long, hi long, shard int, first long, hops int")

    in_block = F.row_number().over(Window.partitionBy("arc", "block").orderBy("place", "doc_id", "crc", "size")) - 1
    ranked = sized_join(with_arc(rows).withColumn("rank", in_block.cast("long")), starts, ["arc", "block"], "inner").withColumn("rank", F.col("rank") + F.col("start"))
    # Ranges are as many as arcs, and one more for each shard boundary inside an arc.
    out = ranked.join(F.broadcast(range_table), (ranked["arc"] == range_table["arc"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.withColumn("ring_slot", F.col("first") + F.col("rank") - F.col("lo")).drop("arc", "block", "rank", "start", "lo", "hi", "first")


def in_given_order(ranked: DataFrame) -> DataFrame:
    """Slots of each shard by the given order instead of by the ring: totals of a shard's blocks first, then ranks inside a block."""
    ranked, block = staged(ranked, "assigned"), ["order_block", "order_name"]
    counts = ranked.groupBy("shard", *block).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(counts.select("shard", "order_name", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "slot-starts")
    inside = F.row_number().over(Window.partitionBy("shard", "order_name").orderBy("order_at")) - 1
    placed = sized_join(ranked.withColumn("inside", inside.cast("long")), starts, ["shard", "order_name"], "inner")
    return placed.withColumn("ring_slot", F.col("start") + F.col("inside")).drop("start", "inside")


def assign_shards(docs: DataFrame, shards: int = 24, vnodes: int = 128, order: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """All columns of docs, with size, text_crc32, law, shard, slot, grown_shard and hops.

    order: number and name of the block of rows that a row stands in, and its place in the block. Name and place tell
    rows apart, and slots follow number, name and place inside each shard. Without an order they follow the ring.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "hops"]
    names, given = [], {c.lower() for c in docs.columns}
    for c in docs.columns:  # a column of the input whose name is added here stays, with _ behind its name
        name = c
        while name.lower() in added or (name != c and name.lower() in given | {x.lower() for x in names}):
            name += "_"
        names.append(name)
    # Plain names inside, so that nothing clashes with what is computed.
    mine = [f"c{k}" for k in range(len(names))]
    plain = docs.select(*docs.columns, *(() if order is None else (order[0].cast("long").alias("order_block"), order[1].alias("order_name"), order[2].cast("long").alias("order_at"))))
    plain = plain.toDF(*mine, *plain.columns[len(mine) :])
    doc_id, text = (F.col(mine[docs.columns.index(c)]) for c in ("doc_id", "text"))
    whole = F.coalesce(text, F.lit(""))
    place = F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.xxhash64(text))), 1)
    facts = [doc_id.alias("doc_id"), (F.octet_length(whole).cast("long") + 8).alias("size"), F.crc32(whole.cast("binary")).alias("crc"), place.alias("place")]
    points, n = ring_points(shards, vnodes), docs.count()
    if order is None:
        out = ranked_on_ring(plain.select(*mine, *facts), n, points, shards)
    else:
        # Ids alone are ranked; the rows are joined once, by where they stand.
        narrow = in_given_order(ranked_on_ring(plain.select("order_block", "order_name", "order_at", *facts), n, points, shards))
        out = plain.drop("order_block").join(narrow.hint("shuffle_hash"), ["order_name", "order_at"])
    made = [F.col("size"), F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard"), F.col("ring_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("hops")]
    return out.select(*[F.col(a).alias(b) for a, b in zip(mine, names, strict=True)], *made)

"""The trie of conversation prefixes, with totals of each node's subtree.

Turns are sorted by conversation and turn over all tasks, so that a conversation of any length spreads over several of them.
A prefix is named by a polynomial of its turns' digests modulo a prime of 127 bits; such sums of a conversation's stretches are
put together afterwards, and the name of a rebuilt conversation's prefix follows from those of the two that it is made of.

Subtrees are totalled by time-forward processing. A node beneath which more than SHARD turns stand is heavy; a node under a heavy
one that is not heavy is the root of a shard, and shards are dealt to tasks. There Spark sorts nodes by depth, deepest first,
spilling if need be, and a queue that spills too carries each node's totals forward to its parent. The totals of the
shards' roots are then added up per parent, and the heavy nodes, few of which exist as each has more than SHARD turns
beneath it, go through the same step.

Defined cases: null role and text count as empty; a null turn comes first, and turns of one number follow each other by role and text;
rows that repeat are turns each; rows without conv_id belong to no conversation and are left out; texts are read whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_raw_words, sized_join, spread_join, staged

#: Names of prefixes: sums of digest(turn i) * BASE**i modulo a Mersenne prime. BASE is a digest of a fixed text.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"conversation prefixes").digest()[:15], "big")
UNBASE = pow(BASE, -1, PRIME)
ROOT = bytes(16)

#: Turns beneath a node from which on it does not go to one shard.
SHARD = 4096

#: Messages that a queue holds in memory.
QUEUE_ROWS = 500_000

#: Conversations share the first turns of the one at the head of their twenty.
FAMILY, HEADS = 20, 4


def number(name: bytes) -> int:
    return int.from_bytes(name, "big")


def name(x: int) -> bytes:
    return (x % PRIME).to_bytes(16, "big")


def turn_number(role: str, text: str) -> int:
    data = role.encode()
    return number(hashlib.sha256(struct.pack(">q", len(data)) + data + text.encode()).digest()[:15])


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with their place and the prefix sums up to and before them, inside the task; the task is `part`."""
    part, conv, at, power, total = TaskContext.get().partitionId(), None, 0, 1, 0
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if c != conv:
                conv, at, power, total = c, 0, 1, 0
            at, power, before = at + 1, power * BASE % PRIME, total
            total = (total + turn_number(role, text) * power) % PRIME
            for column, x in zip(out, (part, at, name(total), name(before)), strict=True):
                column.append(x)
        arrays = [batch.column(0), *(pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)), batch.column(3)]
        yield pa.RecordBatch.from_arrays(arrays, ["conv", "part", "at", "upto", "before", "words"])


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def joined_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, part, n, sum) of stretches sorted by conv and part: turns and sum of those before each, where there are some."""
    conv, n, total = None, 0, 0
    for batch in batches:
        out = []
        for c, part, more, upto in rows_of(batch):
            if c != conv:
                conv, n, total = c, 0, 0
            if n:
                out.append((c, part, n, name(total)))
            total = (total + number(upto) * pow(BASE, n, PRIME)) % PRIME
            n += more
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["conv", "part", "n_before", "sum_before"])


def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of prefixes that follow others: `upto` and `before` moved by `by` places behind what sums up to `sum_before`, less `less`."""
    for batch in batches:
        at = {n: k for k, n in enumerate(batch.schema.names)}
        upto, before, by, head, less = (batch.column(at[c]).to_pylist() for c in ("upto", "before", "by", "sum_before", "less"))
        move = lambda x, k: name(number(head[k]) + (number(x) - number(less[k])) * pow(BASE if by[k] >= 0 else UNBASE, abs(by[k]), PRIME))  # noqa: B023, E731
        new = {"upto": pa.array([move(x, k) if by[k] is not None else x for k, x in enumerate(upto)], pa.binary()), "before": pa.array([move(x, k) if by[k] is not None else x for k, x in enumerate(before)], pa.binary())}
        yield pa.RecordBatch.from_arrays([new.get(n, batch.column(at[n])) for n in batch.schema.names], batch.schema.names)


def shift(df: DataFrame) -> DataFrame:
    """upto and before by the columns by, sum_before and less, which go; a null `by` leaves them."""
    return df.mapInArrow(shifted, df.schema).drop("by", "sum_before", "less")


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, key, parent, words, ahead): each prefix of each rebuilt conversation, with the number of turns after it; and (conv, length, end), the name of each."""
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), n_raw_words().alias("words")
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", "words")
    local = staged(dealt.mapInArrow(stretches, "conv long, part int, at long, upto binary, before binary, words long"), "turns")

    # A conversation's stretches are as many as the tasks that it spreads over.
    pieces = local.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.max_by("upto", "at").alias("upto"))
    whole = pieces.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(joined_stretches, "conv long, part int, n_before long, sum_before binary")
    behind = staged(whole, "stretches")
    zero, nothing = F.lit(ROOT), F.lit(None).cast("long")
    joined = sized_join(local, behind, ["conv", "part"], "left")
    own = shift(joined.select("conv", (F.col("at") + F.coalesce("n_before", F.lit(0))).alias("at"), "upto", "before", "words", F.col("n_before").alias("by"), F.coalesce("sum_before", zero).alias("sum_before"), zero.alias("less")))
    own = staged(own, "prefix-sums")

    # Of each conversation: its turns, how many it takes from the head of its family, and the sums up to its cut.
    hs = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    heads = own.filter(F.col("at") < HEADS).groupBy("conv").agg(F.max("at").alias("n_first"), *[F.max(F.when(F.col("at") == k, F.struct("upto", "before", "words"))).alias(f"t{k}") for k in range(1, HEADS)])
    facts = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.max_by("upto", "at").alias("all")).withColumn("h", hs).withColumn("head", F.col("conv") - F.col("conv") % FAMILY)
    t = lambda prefix: [F.col(f"t{k}").alias(f"{prefix}{k}") for k in range(1, HEADS)]
    facts = facts.join(heads.select("conv", *t("own")).hint("merge"), "conv").join(heads.select(F.col("conv").alias("head"), F.col("n_first").alias("head_n"), *t("head")).hint("merge"), "head", "left")
    upto = lambda side, n: F.coalesce(*[F.when(n == k, F.col(f"{side}{k}.upto")) for k in range(1, HEADS)], zero)
    taken = F.least("h", F.coalesce("head_n", F.lit(0)))
    facts = facts.withColumn("taken", F.when(F.col("head") == F.col("conv"), F.lit(0)).otherwise(taken)).withColumn("cut", F.when(F.col("head") == F.col("conv"), F.lit(0)).otherwise(F.least("h", F.col("n"))))
    facts = facts.withColumn("length", F.col("taken") + F.col("n") - F.col("cut"))
    facts = staged(facts.select("conv", "n", "taken", "cut", "length", upto("head", F.col("taken")).alias("sum_before"), upto("own", F.col("cut")).alias("less"), *[f"head{k}" for k in range(1, HEADS)]), "conversations")

    # A conversation can have a large part of all turns: they are dealt by place.
    after = spread_join(own, facts.select("conv", "n", "taken", "cut", "length", "sum_before", "less"), "conv", "n", "at").filter(F.col("at") > F.col("cut"))
    by = F.when(F.col("cut") > 0, (F.col("taken") - F.col("cut")).cast("long")).otherwise(nothing)
    later = shift(after.select("conv", (F.col("at") - F.col("cut") + F.col("taken")).alias("depth"), "upto", "before", "words", "length", by.alias("by"), "sum_before", "less"))
    borrowed = facts.filter("taken > 0").select("conv", "length", "taken", F.posexplode(F.array(*[f"head{k}" for k in range(1, HEADS)])).alias("k", "t")).filter("k < taken")
    first = borrowed.select("conv", (F.col("k") + 1).cast("long").alias("depth"), "t.upto", "t.before", "t.words", "length")
    top = facts.select("conv", F.lit(0).cast("long").alias("depth"), zero.alias("upto"), F.lit(None).cast("binary").alias("before"), F.lit(0).cast("long").alias("words"), "length")
    out = later.unionByName(first).unionByName(top)
    out = staged(out.select("conv", "depth", F.col("upto").alias("key"), F.col("before").alias("parent"), "words", (F.col("length") - F.col("depth")).alias("ahead")), "prefixes")
    return out, out.filter("ahead = 0").select("conv", "depth", "key")


class Forward:
    """Messages to nodes, taken out in order of their receivers; beyond `most` they are written out as sorted runs, in files that vanish with the task."""

    ROW = struct.Struct(">q16sqqq")

    def __init__(self, most: int = QUEUE_ROWS):
        self.most, self.heap, self.runs, self.files = most, [], [], []

    def push(self, message: tuple) -> None:
        """message: receiver (minus depth, key), children, leaves, saved tokens."""
        heapq.heappush(self.heap, message)
        if len(self.heap) >= self.most:
            file = tempfile.TemporaryFile()
            self.heap.sort()
            for at in range(0, len(self.heap), 4096):
                file.write(b"".join(self.ROW.pack(*m) for m in self.heap[at : at + 4096]))
            file.seek(0)
            self.heap = []
            run = self._read(file)
            self.runs.append((next(run), len(self.files), run))
            heapq.heapify(self.runs)
            self.files.append(file)

    def _read(self, file) -> Iterator[tuple]:
        while data := file.read(self.ROW.size * 4096):
            yield from self.ROW.iter_unpack(data)
        file.close()

    def take(self, receiver: tuple[int, bytes]) -> tuple[int, int, int]:
        """Sums of all messages to a receiver; none to one before it may be left."""
        children = leaves = saved = 0
        while True:
            from_run = self.runs and (not self.heap or self.runs[0][0] < self.heap[0])
            if not (from_run or self.heap):
                break
            m = self.runs[0][0] if from_run else self.heap[0]
            if m[:2] != receiver:
                break
            children, leaves, saved = children + m[2], leaves + m[3], saved + m[4]
            if from_run:
                _, k, run = self.runs[0]
                following = next(run, None)
                if following is None:
                    heapq.heappop(self.runs)
                else:
                    heapq.heapreplace(self.runs, (following, k, run))
            else:
                heapq.heappop(self.heap)
        return children, leaves, saved


NODE = "depth long, key binary, parent binary, conv_id long, n_convs long, cost long"
TOTALS = "children long, leaves long, saved long"


def forward(most: int, top: bool):
    """Nodes deepest first with what comes from other shards; adds the totals of their subtrees. Inside a shard (top: of all heavy nodes) they reach the parent by the queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = Forward(most)
        for batch in batches:
            out = []
            for depth, key, parent, conv, n, cost, children, leaves, saved, is_root in rows_of(batch):
                got = queue.take((-depth, key))
                children, leaves, saved = children + got[0], leaves + got[1], saved + got[2] + cost
                leaves = leaves if children else 1
                if not is_root:
                    queue.push((1 - depth, parent, 1, leaves, saved))
                out.append((depth, key, parent, conv, n, children, leaves, saved, is_root))
            columns = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = (pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["depth", "key", "parent", "conv_id", "n_convs", "children", "leaves", "saved", "is_root"])

    return run


def in_reverse_levels(nodes: DataFrame, queue_rows: int, top: bool = False) -> DataFrame:
    columns = [*(c.split()[0] for c in NODE.split(", ")), *(c.split()[0] for c in TOTALS.split(", ")), "is_root"]
    return nodes.sortWithinPartitions(F.desc("depth"), "key").select(*columns).mapInArrow(forward(queue_rows, top), f"depth long, key binary, parent binary, conv_id long, n_convs long, {TOTALS}, is_root boolean")


def subtree_totals(rows: DataFrame, shard: int = SHARD, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """Each node of the prefixes with children, leaves and saved, the totals of its subtree."""
    weight = rows.groupBy("key", "depth").agg(F.sum("ahead").alias("weight")).filter(F.col("weight") > shard).select("key", "depth", F.lit(True).alias("heavy"))
    heavy = staged(weight, "heavy-nodes")
    marked = staged(sized_join(rows, heavy, ["key", "depth"], "left").na.fill(False, ["heavy"]), "marked")
    # Heavy nodes are closed upwards, so a conversation enters its shard at its first node that is not heavy.
    entry = marked.filter("NOT heavy").groupBy("conv").agg(F.min(F.struct("depth", "key")).alias("shard"), F.count(F.lit(1)).alias("rows"))
    light = spread_join(marked.filter("NOT heavy").drop("heavy"), staged(entry, "shards"), "conv", "rows", "depth")
    node = [F.max("parent").alias("parent"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), ((F.count(F.lit(1)) - 1) * F.max("words")).alias("cost")]
    none = [F.lit(0).cast("long").alias(c.split()[0]) for c in TOTALS.split(", ")]
    below = light.groupBy("key", "depth").agg(*node, F.max("shard").alias("shard")).select("*", *none, (F.col("shard.key") == F.col("key")).alias("is_root"))
    below = staged(in_reverse_levels(below.repartition("shard.key", "shard.depth"), queue_rows), "light-totals")
    sent = below.filter("is_root AND parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = marked.filter("heavy").groupBy("key", "depth").agg(*node).join(sent.hint("merge"), "key", "left").na.fill(0, ["children", "leaves", "saved"])
    above = in_reverse_levels(above.withColumn("is_root", F.col("depth") == 0).repartition(1), queue_rows, True)
    return below.unionByName(above).drop("is_root")


def conversation_trie(turns: DataFrame, shard: int = SHARD, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, ends = prefixes(turns)
    nodes = staged(subtree_totals(rows, shard, queue_rows), "nodes")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """SHA-256 of the conversations of each key, which come in order; a list of any length is read once."""
        key, h = None, None
        for batch in batches:
            out = []
            for k, _, conv in rows_of(batch):
                if k != key:
                    if h is not None:
                        out.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(str(conv).encode())
                else:
                    h.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in ((0, pa.binary()), (1, pa.string()))], ["key", "digest"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["key", "digest"])

    ended = ends.select("key", "depth", "conv").repartition("key").sortWithinPartitions("key", "conv").mapInArrow(digests, "key binary, digest string")
    full = nodes.join(ended.hint("merge"), "key", "left")
    parents = nodes.filter("children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "children")
    full = spread_join(full.withColumnRenamed("children", "n_children"), parents, "parent", "children", "key", how="left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))

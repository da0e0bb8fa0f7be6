import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from maskloom.llm import common, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key int"


def brute(rows):
    """Every prefix of every rebuilt conversation, and for each node all nodes that begin with it."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(set), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].add(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for n in nodes:
        if n:
            children[n[:-1]].append(n)
    out = []
    for n in nodes:
        under, todo = [], [n]
        while todo:
            under.append(todo.pop())
            todo += children[under[-1]]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].split()) for x in under if x)
        leaves = sum(not children[x] for x in under)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
        out.append((min(nodes[n]), len(n), min(nodes[n[:-1]]) if n else None, len(nodes[n]), len(children[n]), leaves, saved, sha))
    return sorted(out, key=repr)


def made(seed, convs, alphabet, longest):
    r = random.Random(seed)
    return [(c, k if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice([*alphabet, None])) for c in range(convs) for k in range(r.randint(1, longest))]


#: Missing heads, one conversation of 300 turns, rows without a conversation, repeated rows and turns.
CASES = [(41, 0, "user", "a b"), (41, 0, "user", "a b"), (47, 3, None, None), (None, 0, "user", "lost"), (60, None, "x", ""), (60, 0, "x", "y z"), (61, 5, "x", "q")]
CASES += [(80, k, "user", f"t {k}") for k in range(300)] + [(81, k, "user", f"t {k}") for k in range(150)]


@pytest.fixture(scope="module")
def rows():
    return CASES + made(1, 120, ["hi there", "yes", "no  way", ""], 6)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "other", 1) for r in rows], SCHEMA).repartition(4)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def test_against_brute_force(spark, rows):
    assert got(trie.conversation_trie(frame(spark, rows))) == brute(rows)
    assert trie.conversation_trie(frame(spark, rows).limit(0)).count() == 0


def test_shards_spilling_queues_and_hot_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(common, "HOT_IDS", 3)
    assert got(trie.conversation_trie(frame(spark, rows), shard=20, queue_rows=3)) == brute(rows)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert got(trie.conversation_trie(frame(spark, rows), shard=0, queue_rows=2)) == brute(rows)


def test_a_long_conversation_is_read_by_several_tasks(spark, monkeypatch):
    """Its stretches are put together: no task has more than a part of it."""
    monkeypatch.setattr(common, "HOT_IDS", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        long_conversation(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def long_conversation(spark):
    long = [(80, k, "user", f"t {k}") for k in range(400)]
    df = frame(spark, long + made(2, 40, ["a", "b"], 4))
    assert got(trie.conversation_trie(df)) == brute(long + made(2, 40, ["a", "b"], 4))
    dealt = df.repartitionByRange("conv_id", "turn", "role", "text").select("conv_id").rdd.glom().map(lambda x: sum(r.conv_id == 80 for r in x)).collect()
    assert max(dealt) < 300


def test_queue_in_order(monkeypatch):
    r, queue, want = random.Random(2), trie.Forward(5), defaultdict(list)
    for _ in range(300):
        message = (-r.randint(0, 9), bytes([r.randint(0, 3)] * 16), 1, r.randint(0, 9), r.randint(0, 9))
        want[message[:2]].append(message[2:])
        queue.push(message)
    for receiver in sorted(want):
        assert queue.take(receiver) == tuple(map(sum, zip(*want[receiver], strict=True)))
    assert queue.take((0, bytes(16))) == (0, 0, 0)

"""The corpus pipeline, stage by stage, against what each stage promises."""

import re

import corpus_pipeline
from maskloom.llm import mixing, sharding
from maskloom.llm.common import staged
from pyspark.sql import functions as F

from . import brute
from .test_operators import SCHEMA, decontaminated, sentences


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, sf), name)
        kept[name] = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if name != "sharding":
            assert docs.columns == columns
        given = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        assert set(kept[name]) <= set(given)
        if name == "near_dedup":
            sets = {d: shingles(t) for d, t in kept[name]}
            pairs = [(x, y) for x in sets for y in sets if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
            assert not pairs
            gone = [shingles(t) for d, t in given if d not in sets]
            assert all(any(100 * len(g & s) >= 50 * len(g | s) for s in sets.values()) for g in gone)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            clean = {r[0] for r in decontaminated(given, items) if not r[5]}
            assert sorted(kept[name]) == sorted((d, t) for (d, t) in given if d in clean)
        if name == "mixing":
            words = sum(len(re.findall(r"\S+", t)) for _, t in given)
            assert abs(sum(len(re.findall(r"\S+", t)) for _, t in kept[name]) - 1.5 * words) < 0.2 * words
    out = docs.collect()
    counts = [sum(r["shard"] == s for r in out) for s in range(24)]
    assert sum(counts) == len(kept["mixing"]) and max(counts) - min(counts) <= 1


def components_of(texts, percent=80):
    """Smallest doc_id of each document's group, by comparing all pairs."""
    sets = {d: shingles(t) for d, t in texts}
    least = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for x in sets:
            for y in sets:
                if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]) and least[x] != least[y]:
                    least[x] = least[y] = min(least[x], least[y])
                    changed = True
    return least


def test_near_dedup_equals_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    least = components_of([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert {r.doc_id for r in got.select("doc_id").collect()} == {d for d, m in least.items() if d == m}


def cases(spark):
    a, b = sentences(1, 120), sentences(2, 90)
    texts = [(1, a), (1, a), (2, a), (3, b), (4, None), (5, ""), (None, b), (None, None), (6, "one two"), (7, sentences(3, 20_000)), (8, a.upper())]
    return spark.createDataFrame([(d, t, "en", None if d == 3 else f"s{(d or 0) % 3}", "k", 1, 2, "x", "y") for d, t in texts], SCHEMA).repartition(3)


def test_cases_go_through_all_stages(spark, sf):
    """Nulls, empty and long texts, repeated rows and columns that clash with added ones."""
    docs, counts = cases(spark), []
    kept = sorted((r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()), key=repr)
    assert kept == [1, 1, 3, 4, 5, 6, 7, None, None]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != "sharding":
            assert docs.columns == before.columns
    assert 11 >= counts[0] >= counts[1] >= counts[2] and counts[3] == counts[4] > 0
    assert set(docs.columns) >= {"size_", "shard_", "key", "kept", "row", "shard", "slot", "size"}
    assert {(r["size_"], r["shard_"]) for r in docs.collect()} == {(1, 2)}


def test_empty_table(spark, sf):
    docs = cases(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf), name)
        assert docs.isEmpty()


def test_slots_follow_the_mixed_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = staged(corpus_pipeline.mixing(spark, docs, sf), "mixed")
    place = mixed.select("doc_id", F.regexp_extract("_metadata.file_path", r"part-([0-9]+)", 1).cast("int").alias("part"), F.col("_metadata.row_index").alias("at"))
    order = [r.doc_id for r in place.orderBy("part", "at").collect()]
    # The order is that of the training positions.
    positions = sorted((p, r.doc_id, e) for r in mixing.mix(docs).collect() for e, p in enumerate(r.positions))
    assert order == [d for _, d, _ in positions]
    out = corpus_pipeline.sharding(spark, mixed, sf).collect()
    for s in range(24):
        mine = [r.doc_id for r in sorted((r for r in out if r["shard"] == s), key=lambda r: r.slot)]
        assert sorted(r.slot for r in out if r["shard"] == s) == list(range(len(mine)))
        rest = iter(order)
        assert all(d in rest for d in mine)


def test_sharding_keys_one_by_one(spark):
    """Every document walks clockwise from its own place to the first shard with room; capacities fill in the order of the ring's turns."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    places = {r.doc_id: r.p for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("p")).collect()}
    got = {r.doc_id: r["shard"] for r in sharding.assign_shards(docs, 5, 4).collect()}
    assert got == brute.ring_shards(places, sharding.ring_points(5, 4), 5)

"""The paths that large tables take: merged joins instead of broadcasts, hot keys dealt, long buckets; and what banding recalls."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from maskloom.llm import common, debruijn, decontaminate, exact, minhash, mixing, pii, quality, sharding, suffixes

from . import brute
from .test_operators import SCHEMA, rows, sentences


@pytest.fixture(scope="module")
def docs(spark):
    base, other = sentences(21, 150), sentences(22, 60)
    texts = [(k, base.rsplit(" ", 1 + k % 9)[0] if k % 3 else base) for k in range(40)]
    texts += [(100 + k, f"{other} {sentences(400 + k, 8)}") for k in range(30)] + [(200, None), (201, ""), (202, "one two")]
    return spark.createDataFrame([(d, t, "en", f"s{d % 3}", "k", 1, 2, "x", "y") for d, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, sentences(22, 60)), (2, "one two"), (3, None)], "item_id long, text string")


OPERATORS = {
    "suffixes": lambda docs, bench: suffixes.remove_repeats(docs).drop("kept"), "debruijn": lambda docs, bench: debruijn.remove_repeats(docs), "minhash": lambda docs, bench: minhash.near_duplicates(docs),
    "exact": lambda docs, bench: exact.exact_groups(docs), "decontaminate": lambda docs, bench: decontaminate.contamination(docs, bench), "sharding": lambda docs, bench: sharding.assign_shards(docs.select("doc_id", "text"), 4, 8),
    "proximity": lambda docs, bench: decontaminate.proximity(docs, bench), "quality": lambda docs, bench: quality.importance_sample(docs, docs.selectExpr("doc_id", "1 AS quality", "int(doc_id % 2) AS toxic"), k=20).drop("key"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_merged_joins_and_hot_keys(docs, bench, monkeypatch, name):
    want = rows(OPERATORS[name](docs, bench))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert rows(OPERATORS[name](docs, bench)) == want
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(common, "HOT_IDS", 2)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 1)
    assert rows(OPERATORS[name](docs, bench)) == want


def test_small_blocks_of_large_buckets(docs, monkeypatch):
    """Cells of one row a side, and the second family of bands, find the same components."""
    want = rows(minhash.near_duplicates(docs))
    monkeypatch.setattr(minhash, "BLOCK", 1)
    assert rows(minhash.near_duplicates(docs)) == want
    monkeypatch.setattr(minhash, "DIRECT", 1)
    assert rows(minhash.near_duplicates(docs)) == want


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs from 0.80 to 0.84: all of some hundreds are linked."""
    r, texts, pairs = random.Random(11), [], 0
    for k in range(300):
        words = [f"w{k}x{i}" for i in range(r.randint(90, 130))]
        other = list(words)
        while True:
            changed = list(other)
            changed[r.randrange(len(words))] += "z"
            a, b = ({tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (words, changed))
            if 100 * len(a & b) < 80 * len(a | b):
                break
            other = changed
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        pairs += 1
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(300)) == pairs


def test_long_bands_miss_next_to_nothing():
    assert (1 - 0.8**minhash.LONG_ROWS) ** minhash.LONG_BANDS < 2e-6


def test_what_filters_keep(spark, docs, bench):
    """Filters of whole rows: all columns, and nothing from empty tables."""
    none, labels = docs.limit(0), docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    for keep in (exact.drop_exact_copies, minhash.drop_near_copies, lambda d: decontaminate.drop_contaminated(d, bench), lambda d: quality.keep_good(d, labels), mixing.curriculum):
        assert keep(none).columns == docs.columns and keep(none).isEmpty()
        assert keep(docs).columns == docs.columns
    kept = {r.doc_id for r in exact.drop_exact_copies(docs).collect()}
    assert 0 in kept and 3 not in kept and {200, 202} <= kept and 201 not in kept


def test_equal_rows_at_the_last_place_share_the_verdict(spark):
    df = spark.createDataFrame([(k % 5, float(k % 5)) for k in range(10)], "doc_id long, x double")
    assert sorted(r.doc_id for r in quality.top_k(df, "x", 3).filter("selected").collect()) == [3, 3, 4, 4]
    assert quality.top_k(df, "x", 0).filter("selected").isEmpty() and quality.top_k(df, "x", 10).filter("selected").count() == 10


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a", "keep", 7, 8)], "doc_id long, text string, __key string, size int, size_ int")
    assert quality.keep_good(df, df.selectExpr("doc_id", "1 AS quality", "0 AS toxic")).first()["__key"] == "keep"
    assert decontaminate.drop_contaminated(df, spark.createDataFrame([(1, "zz")], "item_id long, text string")).first()["__key"] == "keep"
    out = sharding.assign_shards(df, 2, 4).first()
    assert (out["size__"], out["size_"], out["size"]) == (7, 8, 9)


def test_exact_copies_without_ids_stay(spark):
    """Rows that the groups keep stay: one text under no id alone, and rows that share id and text."""
    data = [(None, "only  null"), (1, "a"), (2, "a"), (None, "a"), (3, "b"), (3, "b"), (4, None), (None, ""), (3, "c"), (5, "c")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in data], "doc_id long, text string, digest string, __sha int").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in exact.drop_exact_copies(df).collect()), key=repr)
    assert kept == sorted([(None, "only  null"), (1, "a"), (3, "b"), (3, "b"), (4, None), (3, "c")], key=repr)
    groups = sorted(((r.doc_id, r.text_sha256) for r in exact.exact_groups(df).filter("kept").collect()), key=repr)
    assert len(groups) == len(kept) and exact.drop_exact_copies(df).columns == df.columns


def test_texts_of_one_id_meet_with_their_own_signatures(spark):
    """doc_id 5 has two texts; 9 is near the one that sorts last, and no leader joins them."""
    other, near = sentences(31, 120), sentences(32, 120)
    docs = spark.createDataFrame([(5, "Aa " + other), (5, "zz " + near), (9, "zz " + near + " end"), (1, sentences(33, 120))], "doc_id long, text string")
    texts = docs.selectExpr("doc_id", "text")
    signed = texts.mapInArrow(minhash._signatures(4), "doc_id long, n_shingles long, set_id binary, sig binary")
    named = {"min(doc_id)": "node", "first(sig)": "sig"}
    classes = signed.groupBy("set_id").agg({"doc_id": "min", "sig": "first"}).withColumnsRenamed(named)
    buckets = classes.select("node", "sig").mapInArrow(minhash._bands, "bucket long, node long").distinct()
    rows_ = buckets.withColumns({"comp": buckets["node"]})
    links = minhash.links_across(minhash.mixed_rows(rows_), classes, texts, 80, 4, True)
    assert {(r.u, r.v) for r in links.collect()} == {(9, 5)}


def crowded(n_pairs, singles):
    """Pairs from 0.80 to 0.84, and texts that are near nothing."""
    r, texts = random.Random(12), []
    for k in range(n_pairs):
        words = [f"w{k}x{i}" for i in range(r.randint(90, 130))]
        while True:
            changed = list(words)
            for at in r.sample(range(len(words)), r.randint(1, 4)):
                changed[at] = f"c{k}y{at}"
            a, b = ({tuple(x[i : i + 4]) for i in range(len(x) - 3)} for x in (words, changed))
            if 0.80 <= len(a & b) / len(a | b) <= 0.84:
                break
        texts += [" ".join(words), " ".join(changed)]
    return texts + [" ".join(f"s{k}z{i}" for i in range(60)) for k in range(singles)]


def test_recall_in_a_large_mixed_bucket(spark):
    """300 pairs that meet in one bucket of 1,400 rows alone, all outside its largest component: long bands find all; so do whole comparisons."""
    texts = crowded(300, 800)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    signed = docs.mapInArrow(minhash._signatures(4), "doc_id long, n_shingles long, set_id binary, sig binary")
    classes = signed.withColumnRenamed("doc_id", "node").select("node", "set_id", "sig")
    bucket = docs.selectExpr("1L AS bucket", "doc_id AS node", "doc_id AS comp")
    want = {(2 * k + 1, 2 * k) for k in range(300)}
    none = spark.createDataFrame([], "u long, v long")
    open_ = minhash.mixed_rows(bucket)
    assert open_.filter(f"rest > {minhash.DIRECT}").count() == len(texts)
    stars = minhash.with_long_bands(open_, none, classes, docs, 80, 4)
    assert {(r.u, r.v) for r in stars.collect()} == want
    assert {(r.u, r.v) for r in minhash.links_across(open_, classes, docs, 80, 4, False).collect()} == want


def test_a_text_full_of_matches(spark):
    """More matches than a block of the fold: positions go on from block to block."""
    text = "".join(f"mail a{k}@b.org now, " for k in range(300))
    df = spark.createDataFrame([(1, text), (2, "a@b.org"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in pii.find_pii(df).collect()}
    assert [text[a:b] for a, b in got[1]] == [f"a{k}@b.org" for k in range(300)] and got[2] == [(0, 7)] and got[3] == []


def tasks_used(df, *keys):
    """Rows by task after a join or shuffle."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def test_hot_words_and_rows_without_ids_are_dealt(spark, monkeypatch):
    """A word of every document, and one source's rows without id, reach at least half of the tasks."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame([(k, "the cat") for k in range(400)], "doc_id long, text string").repartition(4)
        items = spark.createDataFrame([(1, ["the", "dog"])], "item long, terms array<string>")
        posted = decontaminate.postings_of(decontaminate.keyed(docs), items)
        assert posted.filter("term = 'the'").count() == 400 and posted.filter("term = ''").count() == 400
        files = posted.filter("term = 'the'").groupBy(F.input_file_name()).count().collect()
        assert len(files) >= 2 and max(r["count"] for r in files) < 300
        lost = spark.createDataFrame([(None, "s", f"text number {k}") for k in range(800)], "doc_id long, source string, text string").repartition(4)
        assert mixing.mix(lost, prefix=2).groupBy("source").count().first()["count"] == 800
        places = lost.select(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\0"), "text"), F.lit("")).cast("binary")).substr(1, 2).alias("b"))
        used = tasks_used(places.withColumn("key", F.lit("ss")).repartition(4, "key", "b"))
        assert len(used) == 4 and max(used) < 400
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def moved(spark):
    """Bytes shuffled so far, and bytes in the shared folder."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    executors = sc.statusStore().executorList(True)
    shuffled = sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))
    return shuffled + sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("*.parquet"))


def test_suffixes_move_little(spark, monkeypatch):
    """With many parts and no key sent round, what is shuffled and staged is under four times the texts: 2.4, and 8.0 with texts shuffled thrice and documents named at each entry."""
    r = random.Random(41)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 9))) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=700)) for _ in range(400)]
    texts = [t if k % 4 else f"{t[:2000]} {texts[k // 2][1000:3000]}" for k, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        before = moved(spark)
        got = rows(suffixes.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        spent = moved(spark) - before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sorted(brute.suffix_dedup(list(enumerate(texts))), key=repr)
    assert spent < 4 * sum(map(len, texts))

"""Edge cases of the numbered operators, each against its definition."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from maskloom.llm import debruijn, decontaminate, exact, language, minhash, mixing, pii, quality, sharding, suffixes

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, key string, size int, shard int, kept string, row string"


def sentences(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    a, b, shared = sentences(1, 120), sentences(2, 90), sentences(3, 40)
    return [
        (1, a), (2, a), (3, f"{b} {shared}"), (4, f"{shared} {sentences(4, 60)}"), (5, None), (6, ""), (7, "  \n\t "), (8, "one two"),
        (9, "ab " * 400), (10, "ab " * 390 + "end"), (None, a), (11, a.replace(" ", "  ")), (2, a), (12, sentences(5, 3000) + " " + shared), (13, a[:-20]), (14, "Éa " + a), (15, shared),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Columns beside the needed ones clash with what operators add."""
    return spark.createDataFrame([(d, t, "en", None if d == 4 else f"s{(d or 0) % 3}", "k", 1, 2, "x", "y") for d, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_suffixes(docs, none, texts):
    got = rows(suffixes.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.suffix_dedup(texts), key=repr)
    assert suffixes.remove_repeats(none).count() == 0


def test_suffixes_bucket_pointers():
    import numpy as np

    r = random.Random(7)
    data = bytes(r.choice(b"ab") for _ in range(400)) * 2 + b"x" * 120
    number = suffixes.bucket_pointers(np.frombuffer(data, np.uint8))
    seen = {}
    for p in range(len(data) - suffixes.WINDOW + 1):
        assert seen.setdefault(int(number[p]), data[p : p + suffixes.WINDOW]) == data[p : p + suffixes.WINDOW]
    assert len(seen) == len({data[p : p + suffixes.WINDOW] for p in range(len(data) - suffixes.WINDOW + 1)})


def test_debruijn(docs, none, texts):
    # Rows of one doc_id and text are one place: both keep what the first keeps.
    got = rows(debruijn.remove_repeats(docs))
    assert got == sorted(brute.substring_dedup(texts), key=repr)
    assert debruijn.remove_repeats(none).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()


def test_minhash(docs, none, texts):
    sets = {}
    for d, t in texts:
        sets.setdefault(d, []).append(shingles(t))
    ids = [d for d in sets if d is not None]
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in ids:
        for y in ids:
            if any(a and 100 * len(a & b) >= 80 * len(a | b) for a in sets[x] for b in sets[y]):
                p, q = sorted((root(x), root(y)))
                parent[q] = p
    want = sorted(((d, len(shingles(t)), d and root(d), d is None or root(d) == d) for d, t in texts), key=repr)
    assert rows(minhash.near_duplicates(docs)) == want
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.drop_near_copies(docs.filter("doc_id IS NOT NULL")).columns == docs.columns


def test_minhash_family_without_a_common_leader(spark):
    """Members that link in a chain only: neighbours are near, the ends are not."""
    words = sentences(9, 600).split()
    family = [(k, " ".join(words[k * 12 : k * 12 + 200])) for k in range(30)]
    df = spark.createDataFrame(family, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert set(got.values()) == {0}


def test_exact(docs, none, texts):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in texts]
    want = []
    for d, t in norm:
        group = [x for x, u in norm if u == t]
        keep = min((x for x in group if x is not None), default=None)
        want.append((d, keep, len(group), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert rows(exact.exact_groups(docs)) == sorted(want, key=repr)
    # A digest that clashes everywhere: the content alone tells texts apart.
    assert rows(exact.exact_groups(docs, 4, lambda t: F.lit("same"))) == sorted(want, key=repr)
    assert exact.exact_groups(none).count() == 0


def decontaminated(texts, items, k=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in texts:
        w, hit, found = low(t), set(), set()
        for i, b in items:
            v = low(b)
            n = min(k, len(v))
            for s in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(i)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs, none, texts):
    shared = dict((d, t) for d, t in texts)[15]
    items = [(1, shared), (2, "one two"), (3, None), (4, "..."), (5, " ".join(shared.split()[5:20]).upper()), (6, "never seen anywhere"), (10, "ab " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate.contamination(docs, bench)) == decontaminated(texts, items)
    assert decontaminate.contamination(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert rows(clean, "doc_id") == sorted(((r[0],) for r in decontaminated(texts, items) if not r[5]), key=repr)


def test_proximity_match(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = spark.createDataFrame([(1, item.replace("delta", "delta extra")), (2, item), (3, "alpha only")], "doc_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in decontaminate.find_matches(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: ([], [7]), 2: ([7], [7]), 3: ([], [])}


PII = [
    (1, "mail me: a.b@c-d.org, x@y.z@q.rs or nobody@nowhere"), (2, "ip 10.0.0.1 and 999.1.1.1, 1.2.3.4.5 v001.2.3.4"), (3, "visa 4111 1111 1111 1111 bad 4111 1111 1111 1112"),
    (4, "tel +49 (30) 123-4567 or +1 2"), (5, "IBAN DE89 3704 0044 0532 0130 00. GB82 WEST 1234 5698 7654 31"), (6, None), (7, ""), (8, "9" * 5000 + " a" * 9000 + "@"), (8, "é😀 a@b.co"),
]


def test_pii(spark, none):
    got = {(r.doc_id, r.spans) for r in pii.pii_digest(pii.find_pii(spark.createDataFrame(PII, "doc_id long, text string"))).collect()}
    plain = {"email": pii.PLAIN["email"], "ip": pii.PLAIN["ip"], "card": pii.PLAIN["card"], "phone": pii.PLAIN["phone"]}
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    valid = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    for d, t in PII:
        base = sorted((m.start(), list(plain).index(k), f"{k}:{m.start()}:{m.end()}") for k, p in plain.items() for m in re.finditer(p, t or "") if valid[k](m[0]))
        extra = ["iban:5:32"] if d == 5 else []
        assert (d, ",".join(extra + [x[2] for x in base])) in got, (d, base, got)
    assert pii.find_pii(none).count() == 0


def test_sharding(spark, docs, none, texts):
    out = sharding.assign_shards(docs, shards=4, vnodes=8).collect()
    assert len(out) == len(texts)
    counts = [sum(r["shard"] == s for r in out) for s in range(4)]
    assert max(counts) - min(counts) <= 1
    for s in range(4):
        assert sorted(r.slot for r in out if r["shard"] == s) == list(range(counts[s]))
    assert sharding.assign_shards(none, 4, 8).count() == 0
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before = {r.doc_id: r["shard"] for r in sharding.assign_shards(many.limit(4900)).collect()}
    after = {r.doc_id: r["shard"] for r in sharding.assign_shards(many).collect()}
    assert sum(before[d] != after[d] for d in before) < 0.2 * len(before)


def test_fill_clockwise_against_single_keys():
    r = random.Random(5)
    for _ in range(50):
        arcs, shards = r.randint(3, 12), r.randint(1, 3)
        owners = [k % shards for k in range(arcs)]
        counts = [r.randint(0, 9) for _ in range(arcs)]
        n = sum(counts)
        cap = [n // shards + (s < n % shards) for s in range(shards)]
        got = sharding.fill_clockwise(counts, owners, cap)
        assert sum(hi - lo for _, lo, hi, *_ in got) == n
        for s in range(shards):
            spans = sorted((slot, slot + hi - lo) for _, lo, hi, x, slot, _ in got if x == s)
            assert sum(b - a for a, b in spans) == cap[s] and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_mixing(docs, none, texts):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for d, t in texts:
        s = None if d == 4 else f"s{(d or 0) % 3}"
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ones = {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_ones:
        level = left / sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if weight[s] * level > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_ones}
            break
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ones -= full
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r["size"]
        assert len(r.positions) == r.copies and all(0 <= p < 1 for p in r.positions)
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= max(words(t) for _, t in texts)
    assert mixing.mix(none).count() == 0
    mixed = mixing.curriculum(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_schedule_inverse(spark):
    """The share of the integral up to the position is the demand."""
    for k, knots in enumerate(mixing.SCHEDULES):
        df = spark.range(101).select((F.col("id") / 100).alias("d"), F.lit(k).alias("o"))
        for r in df.withColumn("p", mixing.position_of(F.col("d"), F.col("o"))).collect():
            done = total = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
                slope = (w1 - w0) / (t1 - t0)
                u = min(max(r.p - t0, 0), t1 - t0)
                done, total = done + w0 * u + slope * u * u / 2, total + (t1 - t0) * (w0 + w1) / 2
            assert done / total == pytest.approx(r.d, abs=1e-9)


def test_language(spark, none):
    r = random.Random(3)
    alphabets = {"aa": "abcde ", "bb": "vwxyz "}
    data = [(k, "".join(r.choice(alphabets[lang]) for _ in range(200)), lang) for k, lang in enumerate(["aa", "bb"] * 60)]
    data += [(900, None, "aa"), (901, "12 34", "bb"), (902, "", None), (None, "vwxyz vwx", "bb"), (903, "é" * 300, None)]
    got = {d: (p, s) for d, _, p, s in language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert all(got[k][0] == lang for k, _, lang in data[:120])
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[None][0] == "bb" and 0 <= got[903][1] <= 1
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def test_context_tree_probabilities():
    """The code lengths of all bytes after a context make a distribution, or less where an unseen byte escapes without exclusion."""
    import numpy as np

    text = b"abracadabra abracadabra"
    keys, counts = np.unique(language.byte_keys(np.frombuffer(text, np.uint8)), return_counts=True)
    tree = language.ContextTree(keys, counts.astype(float))
    for context in (b"bra", b"zzz", b"cad"):
        all_keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint32)
        assert 0.5 < np.exp2(-tree.bits(all_keys)).sum() <= 1 + 1e-9


def test_quality(spark, docs, none):
    good = [(k, sentences(k, 80)) for k in range(60)]
    bad = [(100 + k, "BUY!! NOW!! " * 40) for k in range(20)] + [(130, None), (131, "")]
    df = spark.createDataFrame(good + bad, "doc_id long, text string").withColumn("key", F.lit("x"))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 60, 2)] + [(100 + k, 0, 0) for k in range(0, 20, 2)] + [(100, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.importance_sample(df, labels, margin=0.0).collect()}
    assert all(got[k].selected for k, _ in good) and sum(got[100 + k].selected for k in range(20)) <= 3
    assert got[130].log_weight == got[131].log_weight == 0.0
    assert all(r.selected for r in quality.importance_sample(df, labels.limit(0)).collect())
    assert quality.importance_sample(none, labels).count() == 0
    kept = quality.keep_good(df, labels, margin=0.0)
    assert kept.columns == df.columns and kept.count() == sum(r.selected for r in got.values())


def test_top_k_is_exact(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(997)) * 1.0).alias("x"))
    want = {r.doc_id for r in df.orderBy(F.desc("x"), "doc_id").limit(1234).collect()}
    assert {r.doc_id for r in quality.top_k(df, "x", 1234).filter("selected").collect()} == want


def test_crowded_buckets(spark, monkeypatch):
    """What is done where thousands of windows share a bucket gives the same rows."""
    common = sentences(77, 16)
    texts = [(k, f"{sentences(100 + k % 30, 25)} {common} {sentences(200 + k, 25)} {sentences(300 + k % 5, 30)}") for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(debruijn, "CROWD", 1)
    monkeypatch.setattr(suffixes, "CROWD", 1)
    assert len(debruijn.crowded_grams(suffixes.keyed(docs))) > 0
    assert rows(debruijn.remove_repeats(docs)) == sorted(brute.substring_dedup(texts), key=repr)
    assert rows(suffixes.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix_dedup(texts), key=repr)

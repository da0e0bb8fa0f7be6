import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from maskloom.llm import common, divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, least=3, most=200):
    """Every term of every group, by the definition."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        words = TERM.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in df[lang].items() if n >= least]
        total = lambda c: sum(c[t] for t in kept) + len(kept)  # noqa: B023, E731
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // total(c) for t in kept}  # noqa: B023, E731
        mine = {s: share(c) for (x, s), c in counts.items() if x == lang}
        whole = Counter()
        for (x, _), c in counts.items():
            if x == lang:
                whole.update(c)
        q = share(whole)
        f = lambda p, q: (p - q) * (p - q) // q
        for s, p in mine.items():
            pairs = [(o, sum(f(p[t], r[t]) for t in kept)) for o, r in mine.items() if o != s]
            own = [(t, f(p[t], q[t])) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for part, rows in (("pair", pairs), ("term", own)):
                rows.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(rows) if part == "pair" or k < most]
    return sorted(out)


def made(seed, n, sources, vocabulary):
    r = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}é" for k in range(vocabulary)]
    return [(" ".join(r.choice(words[: 1 + len(words) // (1 + k % 5)]) for _ in range(r.randint(0, 60))), r.choice(["en", "de"]), f"s{r.randint(0, sources) if k % 3 else 0}") for k in range(n)]


CASES = [(None, "en", "a"), ("", "en", "empty"), ("The THE the. x9y É é", "en", None), ("the", "en", ""), ("the x", "en", "b"), ("alone", "xx", "only"), ("rare", "yy", "p"), (None, "yy", "q"), ("dup dup", None, "z"), ("dup dup", None, "z"), ("dup", None, "y"), ("dup", "", "y")]


@pytest.fixture(scope="module")
def docs():
    return CASES + made(1, 300, 11, 200)


def frame(spark, docs):
    return spark.createDataFrame([(k, t, a, s, "other", 1.0) for k, (t, a, s) in enumerate(docs)], "doc_id long, text string, lang string, source string, term string, n double").repartition(5)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_brute_force(spark, docs):
    assert got(divergence.source_divergence(frame(spark, docs))) == brute(docs)
    assert divergence.source_divergence(frame(spark, docs).limit(0)).count() == 0


def test_blocks_tiles_and_merged_joins(spark, docs, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 100)
    monkeypatch.setattr(divergence, "TILE", 2)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert got(divergence.source_divergence(frame(spark, docs), most_terms=5)) == brute(docs, most=5)


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "HELD", 3)
    text = "Alpha beta,ALPHA  gammagammagamma ééé1é " * 9
    seen = divergence.occurrences(np.frombuffer(text.encode(), np.uint8))
    assert {k.decode(): v for k, v in seen.items()} == {"alpha": 18, "beta": 9, "gammagammagamma": 9, "ééé": 9, "é": 9}


def test_galloping_finds_what_a_set_finds():
    r = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, m, n)) for m, n in ((r.integers(1, 5000), r.integers(0, 300)), (r.integers(1, 5000), r.integers(0, 4000))))
        i, k = divergence.galloped(a, b)
        assert np.array_equal(a[i], np.intersect1d(a, b)) and np.array_equal(b[k], a[i])


def test_shares_are_exact():
    r = random.Random(4)
    for _ in range(2000):
        total = r.randint(1, 10 ** r.randint(1, 14))
        n = r.randint(0, total - 1)
        assert int(divergence.share(np.array([n]), total)[0]) == 1 + 10**9 * (n + 1) // total

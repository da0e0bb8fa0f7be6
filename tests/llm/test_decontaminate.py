"""Decontamination where benchmark rows repeat, share an item_id or have none, and where passages are edited."""

from maskloom.llm import decontaminate

from .test_operators import decontaminated, rows, sentences


def test_items_that_repeat_share_an_id_or_have_none(spark):
    twice, one, other, nameless = (sentences(k, 25) for k in (31, 32, 33, 34))
    texts = [(k, f"{sentences(40 + k, 15)} {t} {sentences(60 + k, 15)}") for k, t in enumerate((twice, one, other, nameless, sentences(35, 25)))]
    items = [(1, twice), (1, twice), (2, one), (2, other), (None, nameless)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontaminated(texts, [x for x in items if x[0] is not None])
    got = rows(decontaminate.contamination(df, bench))
    assert [r for r in got if r[0] != 3] == [r for r in want if r[0] != 3]
    # As in the SQL twin: a hit, but no item to name.
    assert [r[1:4] + r[5:] for r in got if r[0] == 3] == [(55, 25, 0, True)]
    assert rows(decontaminate.drop_contaminated(df, bench), "doc_id") == [(4,)]


def near(words, item, n, slop):
    """Whether some window of the item stands in the words, each term within slop of its place."""
    at = lambda p, t: any(0 <= q < len(words) and words[q] == t for q in range(p - slop, p + slop + 1))
    return any(all(at(shift + i, item[i]) for i in range(s, s + n)) for s in range(len(item) - n + 1) for shift in range(-len(item), len(words) + 1))


def test_proximity_with_an_edit_at_every_place(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [item[:k] + ["extra"] * n + item[k:] for k in range(11) for n in (1, 2, 4, 5)]
    texts += [["x"] * 3 + item[:k] + item[k + 1 :] + ["y"] * 3 for k in range(10)]
    texts += [["pad"] * n + item[:5] + ["extra"] * 3 + item[5:] + item[::-1] for n in range(12)]
    long = item * 2 + ["last"]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(long)), (9, "kappa")], "item_id long, text string")
    got = {r.doc_id: r.near_items for r in decontaminate.proximity(df, bench).collect()}
    want = {k: [str(i) for i, v in ((7, item), (8, long), (9, ["kappa"])) if near(t, v, min(10, len(v)), 2)] for k, t in enumerate(texts)}
    assert got == want and sum("7" in x for x in got.values()) > 30

"""Language identification where a text is alone in its chunk, or larger than the training sample."""

from maskloom.llm import language

from .test_operators import sentences

SCHEMA = "doc_id long, text string, lang string"


def test_empty_text_alone_in_a_chunk(spark):
    train = spark.createDataFrame([(k, sentences(k, 40), "aa") for k in range(20)], SCHEMA).repartition(2)
    alone = spark.createDataFrame([(100, None, None)], SCHEMA).coalesce(1)
    after = spark.createDataFrame([(101, "abc " * 300_000, None), (102, "", None)], SCHEMA).coalesce(1)
    got = {d: (p, s) for d, _, p, s in language.identify(train.union(alone).union(after)).collect()}
    assert got[100] == got[102] == ("und", 0.0) and got[101] == ("aa", 1.0) and len(got) == 23


def test_one_long_text_does_not_lose_its_language(spark):
    data = [(k, sentences(k, 40), "aa") for k in range(30)] + [(1000 + k, "vwx yz " * 2000, "bb") for k in range(12)]
    data += [(2000 + k, "" if k % 2 else "klmn op " * 3000 if k == 4 else "klmn op " * 10, "cc") for k in range(40)]
    df = spark.createDataFrame(data, SCHEMA)
    counts = language.training_counts(df, 2000, 8192).groupBy("lang").sum("n").collect()
    got = {r["lang"]: r["sum(n)"] for r in counts}
    assert set(got) == {"aa", "bb", "cc"} and all(n <= 8192 for n in got.values()) and got["bb"] >= 3 * 512
    pred = {d: p for d, _, p, _ in language.identify(df, sample_bytes=8192).collect()}
    assert all(pred[d] == lang for d, t, lang in data if t)

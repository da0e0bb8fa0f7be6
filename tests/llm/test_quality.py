"""How many documents the quality sample keeps."""

from maskloom.llm import quality

from .test_operators import sentences


def test_share_kept_does_not_depend_on_the_number_of_labels(spark):
    data = [(k, sentences(k, 60) if k % 4 else "BUY!! NOW!! " * 30) for k in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for n in (20, 120):
        labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(n)], "doc_id long, quality int, toxic int")
        assert {r.doc_id for r in quality.importance_sample(df, labels).collect() if r.selected} == {k for k in range(120) if k % 4}

"""Samples that operators learn from."""

from pyspark.sql import functions as F

from terrastat.llm.quality import learn_quality


def test_a_long_labelled_text_does_not_end_the_sample(spark):
    rows = [(i, ("good words here " if i % 2 else "@@## !! ") * 4, i % 2) for i in range(40)] + [(i, "z" * 9000, 1) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = learn_quality(docs, docs.select("doc_id", "quality"), F.lit(True), size=8000, epochs=1)
    assert model is not None

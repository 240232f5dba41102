"""What the line classifier learns from."""

import zlib

from pyspark.sql import functions as F

from quayside.llm import line_crf
from quayside.llm._shared import table


def test_labels_of_absent_documents_take_no_place(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    absent = spark.range(10_000).select((F.col("id") + 1_000_000).alias("doc_id"), F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    one, other = (line_crf.learn(docs, x, 100) for x in (labels, labels.unionByName(absent, allowMissingColumns=True)))
    assert one.prior is None and (one.weights == other.weights).all() and one.scale == other.scale


def test_long_texts_are_learned_from_and_lines_bounded(spark):
    good = lambda n: "\n".join("The quiet river runs past the old stone mill." for _ in range(n))
    bad = lambda n: "\n".join("!!! BUY $$$ NOW ### 111 %%% &&&" for _ in range(n))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, good(1000) if i % 2 else bad(1000)) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    seen = []
    original = line_crf.fit
    try:
        line_crf.fit = lambda x, length, cut, label, **k: seen.append((len(x), len(label))) or original(x, length, cut, label, rounds=5)
        model = line_crf.learn(docs, labels, max_lines=10_500)
        line_crf.learn(docs, labels, max_lines=500)
    finally:
        line_crf.fit = original
    assert seen == [(10_000, 10), (0, 0)] and model.prior is None
    assert len({round(r.score, 6) for r in line_crf.score(docs, model).collect()}) == 2

import random
import zlib

import numpy as np

from gridloom.llm import toxicity as tx
from gridloom.llm.common import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = tx.toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    judged = got.where("held_out").join(labels, "doc_id").select("doc_id", "predicted", "toxic").collect()
    assert len(judged) > 500
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in judged)
    assert np.mean([r.predicted == r.toxic for r in judged]) >= 0.97
    assert sum(r.predicted and not r.toxic for r in judged) <= 0.01 * len(judged)


def test_held_out_labels_are_not_learned(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(tx.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in tx.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_interactions_are_learned():
    rng = random.Random(1)
    docs, y = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        docs.append(np.array([*[0] * insult, *[1] * group, 2 + rng.randrange(6)]))
        y.append(float(insult and group))
    m = tx.fit(docs, np.array(y), np.arange(8), epochs=40)
    at = np.array([0, 1, 2, 4])
    score = tx.sigmoid(m.margins(np.array([0, 1, 0, 1]), at))
    assert score[2] > 0.5 > max(score[0], score[1])


def test_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (11, 0), (12, 1), (13, 0), (None, 1), (20, None)], "doc_id long, toxic int")
    got = tx.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert tx.toxicity(no_docs, labels).count() == 0
    assert all(abs(r.score - 0.25) < 1e-9 for r in tx.toxicity(docs, labels.limit(0)).collect())

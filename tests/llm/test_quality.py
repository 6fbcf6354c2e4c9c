from gridloom.llm import quality as q
from gridloom.llm.common import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    odd = q.quality(docs, labels.where("doc_id % 2 = 1"))
    judged = [(r[0], r[1]) for r in odd.join(labels.where("doc_id % 2 = 0").withColumnRenamed("quality", "label"), "doc_id").select("predicted", "label").collect()]
    assert len(judged) > 100
    assert sum(a == b for a, b in judged) >= 0.97 * len(judged)


def test_good_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    kept = {r.doc_id for r in q.accepted(docs, labels).select("doc_id").collect()}
    good = [r.doc_id for r in labels.where("quality = 1").collect()]
    bad = [r.doc_id for r in labels.where("quality = 0").collect()]
    assert sum(i in kept for i in good) >= 0.99 * len(good)
    assert sum(i in kept for i in bad) <= 0.05 * len(bad)


def test_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (11, 0), (None, 1), (20, None)], "doc_id long, quality int")
    assert q.quality(docs, labels).count() == docs.count()
    assert q.quality(no_docs, labels).count() == 0
    none = q.quality(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and all(abs(r.evidence) < 1e-9 for r in none)


def test_sparse_sites_shrink(spark):
    rows = [("a", "x", 3.0)] * 200 + [("b", "x", -3.0)] * 200 + [("c", "x", -3.0)] * 2
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, lang string, evidence double")
    both, rate, k_host, k_path = q.site_posteriors(df, "source", "lang")
    got = {r["__h"]: (r.host_good + k_host * rate) / (r.host_n + k_host) for r in both.collect()}
    assert got["a"] > 0.9 and got["b"] < 0.1 and got["b"] < got["c"] < rate

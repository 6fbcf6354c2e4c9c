import corpus_pipeline as cp
from gridloom.llm import chosen_path
from gridloom.llm.common import table
from tests.llm.test_chosen_path import plain as plain_classes
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_substring_dedup import plain as plain_cut

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = table(spark, SF, "documents")
    after = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF).cache()
        after[name] = out
        if name != cp.STAGES[-1][0]:
            assert out.schema.simpleString() == docs.schema.simpleString()
        docs = out
    good, one, cut, clean, ids = (after[n].collect() for n, _ in cp.STAGES)
    # near duplicates: the first document of each class
    firsts = {c[1] for c in plain_classes(good)}
    assert sorted(r.doc_id for r in one) == sorted(firsts)
    # repeated strings: the bytes that a plain search leaves, whole characters only
    want = {w[0]: w[4].decode("utf-8", "ignore") for w in plain_cut([(r.doc_id, r.text) for r in one])}
    assert {r.doc_id: r.text for r in cut} == want and all(r.n_chars == len(r.text) for r in cut)
    # leaks
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    leaks = {k[0] for k in plain_leaks([(r.doc_id, r.text) for r in cut], items)}
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in cut if r.doc_id not in leaks)
    assert sorted(r.doc_id for r in ids) == sorted(r.doc_id for r in clean) and all(r.n_tokens == len(r.ids) for r in ids)


def test_run_equals_its_stages(spark):
    got = sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, SF).collect())
    docs = table(spark, SF, "documents")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert got == sorted((r.doc_id, r.n_tokens) for r in docs.collect())


def test_edges(spark, docs, no_docs):
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0, name
        assert stage(spark, no_docs, SF).count() == 0, name


def test_no_single_class_holds_all(spark):
    got = chosen_path.similarity_classes(table(spark, SF, "documents")).collect()
    assert len({r.class_id for r in got}) > 0.8 * len(got)

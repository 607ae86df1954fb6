import corpus_pipeline
from shopfloor.llm import common, exact_dedup, near_dup
from tests.llm.helpers import SF, documents


def test_stages_follow_each_other(spark):
    docs = common.table(spark, SF, "documents")
    columns, seen = docs.columns, [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert seen[-1] <= seen[-2]
    assert all(r.kept for r in exact_dedup.exact_dedup(docs).collect())
    assert all(r.kept for r in near_dup.near_duplicates(docs).collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in out.collect()} == seen[-1] and out.where("not exact").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == seen[-1]


def test_stages_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id at all here"), (3, "same text"), (4, "same text"), (4, "same text")]
    texts = lambda out: sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    whole = sorted((i or 0, t or "") for i, t in rows)
    want = {"toxicity": whole, "exact_dedup": [(0, "no id at all here"), (2, ""), (4, "same text")],
            "near_dedup": [(0, "no id at all here"), (1, ""), (2, ""), (3, "same text")], "decontamination": whole}
    for name, stage in corpus_pipeline.STAGES:
        df = documents(spark, rows, clashing=True)
        out = stage(spark, df, SF)
        if name != "pieces":
            assert out.columns == df.columns
            assert texts(out) == want[name]
        else:
            assert sorted(r.doc_id or 0 for r in out.where("rank = 1").collect()) == [i for i, _ in whole]
        assert stage(spark, documents(spark, []), SF).count() == 0

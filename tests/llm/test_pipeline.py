import corpus_pipeline
from tapeglass.llm import langid, quality, setjoin
from tapeglass.llm.common import cut


def test_stages(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, data_dir), f"test-{name}")
        if name == "language_id":
            ids = {r.doc_id for r in langid.predict(docs, langid.train(docs)).collect() if r.lang_pred != "und" and r.score >= 0.4}
            assert {r.doc_id for r in out.collect()} == ids
        if name == "quality_rules":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in quality.rate_documents(docs).collect() if r.kept}
        if name == "jaccard_join":
            roots = {r.doc_id: r.component_id for r in setjoin.join_documents(docs).collect()}
            assert {r.doc_id for r in out.collect()} == {d for d, c in roots.items() if d == c}
        if name != "packing":
            assert out.columns == columns and out.count() > 0.5 * docs.count()
            docs = out
    assert sum(r.length for r in out.collect()) == sum(r.doc_tokens for r in out.where("start = 0").collect())
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}

import corpus_pipeline
from tidemark.llm import decontaminate, pii, simhash
from tidemark.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near-duplicates", "decontamination", "surrogates", "packing"]
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert 0 < after.count() <= before.count()
        before = after
    rows = before.collect()
    assert all(not {f for _, _, _, f, _ in pii.detect(r.text)} & {f for _, _, _, f, _ in pii.detect(o.text)} for r in rows for o in [docs.where(f"doc_id = {r.doc_id}").first()] if r.doc_id % 20 == 0)
    index = decontaminate.Index.of([(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()])
    assert not any(index.find(r.text) for r in rows)
    assert simhash.near_duplicates(docs.join(before.select("doc_id"), "doc_id", "left_semi")).groupBy("component_id").count().where("count > 1").count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and {"doc_id", "sequence_id", "offset"} <= set(out[0].asDict())


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    """Null, empty and repeated rows, and columns named as the stages' own."""
    docs = table(spark, sf_dir, "documents")
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0"), "doc_id").select(docs.columns).limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9, "", "en", "s", 0)], docs.schema)
    names = ["__tm_key", "__tm_id", "__k", "__i", "__l", "text_key", "id", "kept", "component_id", "start", "__tm_i", "__tm_k"]
    clash = good.unionByName(odd).selectExpr("*", *(f"'own' as {c}" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, clash, sf_dir)
        assert after.columns == clash.columns, name
        rows = after.collect()
        assert rows and all(r[c] == "own" for r in rows for c in names), name
        assert {r.doc_id for r in rows} <= {r.doc_id for r in clash.collect()}, name
    assert corpus_pipeline.STAGES[-1][1](spark, clash, sf_dir).count() >= 30
    empty = clash.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0

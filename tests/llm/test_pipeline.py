import corpus_pipeline as cp


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.where("doc_id < 3").selectExpr("doc_id + 100000 doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(200000, None, "en", "src0", 0), (200001, "", None, None, None), (None, "the of and that is in", "en", None, 3)], docs.schema)
    docs = docs.unionByName(extra).unionByName(odd).cache()
    before = docs
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.schema.names == before.schema.names, name
        assert after.count() <= before.count() and after.count() >= 0.5 * before.count(), name
        before = after
    assert before.where("doc_id >= 100000").count() == 0
    out = cp.STAGES[-1][1](spark, before, sf_dir)
    assert out.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    sizes = {r.sequence_id: r.n for r in out.groupBy("sequence_id").agg({"length": "sum"}).toDF("sequence_id", "n").collect()}
    assert all(n == 2048 for s, n in sizes.items() if s < max(sizes)) and 0 < sizes[max(sizes)] <= 2048


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name

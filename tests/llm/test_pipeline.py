import corpus_pipeline

from graphloom.llm import neardup


def test_stages_keep_their_contracts(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == columns, name
        if name in ("toxicity", "near_duplicates"):
            assert out.exceptAll(docs).count() == 0 and 0 < out.count() < docs.count()
        if name == "near_duplicates":
            again = neardup.near_duplicates(out, size=5).where("n_shingles > 0")
            assert again.groupBy("component_id").count().where("count > 1").count() == 0
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "bpe"]
    assert docs.where("n_tokens <> size(token_ids)").count() == 0


def test_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_run_is_its_stages_one_after_another(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        docs = spark.createDataFrame(out.collect(), out.schema)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == docs.columns and got.count() > 0
    assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect()))


def test_clean_documents_stay(spark):
    """Documents that no label calls toxic, and that share no long passage with another, are kept whole."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, sf)
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in docs.join(clean, "doc_id", "left_anti").collect()}
    known = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(gone & known - toxic) <= 0.02 * len(known - toxic)

import corpus_pipeline
from coverscope.llm import bpe, decontamination, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = corpus_pipeline.reject_toxic(spark, docs, SF).cache()
    scores = toxicity.toxicity_scores(docs, toxicity.trained(docs, labels))
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in scores.where("predicted = 0").collect()}
    two = corpus_pipeline.near_dedup(spark, one, SF).cache()
    groups = simhash.near_duplicates(one)
    assert {r["doc_id"] for r in two.collect()} == {r["component_id"] for r in groups.collect()} and two.count() == groups.select("component_id").distinct().count()
    three = corpus_pipeline.decontaminate(spark, two, SF).cache()
    assert {r["doc_id"] for r in two.collect()} - {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in decontamination.contaminated(two, bench).collect()}
    four = corpus_pipeline.redact_secrets(spark, three, SF)
    assert four.columns == docs.columns and all(not secrets.scan(r["text"]) for r in four.collect())
    assert four.dtypes == docs.dtypes
    five = corpus_pipeline.tokenize(spark, four, SF)
    assert five.count() == four.count()
    assert {r["doc_id"]: r["text"] for r in bpe.decoded(five, corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).collect()} == {r["doc_id"]: r["text"] for r in four.collect()}
    assert corpus_pipeline.run(spark, SF).count() == five.count()


def test_stages_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 40_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd.columns
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert rows == []

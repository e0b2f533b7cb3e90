"""The pipeline over the sample tables: stages take effect, keep columns, and follow one another."""

import corpus_pipeline
from runlens.llm import decontaminate, quality, simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.collect()}
        out = stage(spark, docs, FOLDER)
        rows = out.collect()
        after = {r.doc_id for r in rows}
        assert after <= before and len(rows) == len(after), name
        assert (out.columns if number < 4 else out.columns[:5]) == columns
        assert all(r.n_chars == len(r.text) for r in rows)
        kept.append(len(rows))
        docs = spark.createDataFrame(rows, out.schema)
    assert kept[3] == kept[4] and kept[0] > kept[-1] > 0
    assert [r[0] for r in docs.select("position").orderBy("position").collect()] == list(range(kept[-1]))


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = out.select("doc_id", "text")
    assert decontaminate.overlaps(texts, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).count() == 0
    ratings = quality.ratings_of(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = quality.grade_documents(docs, ratings).filter("kept")
    assert out.join(good, "doc_id", "left_anti").count() == 0
    groups = simhash.near_duplicates(texts).select("component").distinct().count()
    assert groups == out.count()

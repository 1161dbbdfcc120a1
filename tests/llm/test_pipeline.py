"""The pipeline: its stages keep the columns, take effect, and stand odd rows."""

import corpus_pipeline
import __spark_entry__
from stepscope.llm.common import stored


def labels(spark, docs):
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return known.where("doc_id < 200")


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    truth = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
            counts.append(docs.count())
            assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    clean = truth.where("quality = 1 and toxic = 0").count()
    kept = docs.where("piece = 0").join(truth.where("quality = 1 and toxic = 0"), "doc_id").count()
    assert kept > 0.8 * clean
    assert docs.select("doc_id").distinct().count() == counts[4]


def test_odd_and_empty_tables(spark, folder, odd, none):
    known = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for docs in (odd, none):
        path = folder(docs, known)
        rows = corpus_pipeline.run(spark, path).collect()
        assert all(r["offset"] + r["length"] <= 1024 for r in rows)


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1

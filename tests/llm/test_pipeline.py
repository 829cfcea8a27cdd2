"""Stages over small tables, and the registered queries."""

import pytest

import __spark_entry__

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir, documents, tmp_path):
    docs, counts = documents, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.where("not round_trip").count() == 0
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))


def test_stages_on_edges(spark, sf_dir, edge_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge_docs, sf_dir).count() > 0, name
        assert stage(spark, no_docs, sf_dir).count() == 0, name


def test_ten_queries_and_the_pipeline_are_registered():
    known = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([x for x in known if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in known


@pytest.mark.parametrize("name", ["op2_simhash_dedup", "op9_mincut_html"])
def test_registered_query_runs(spark, sf_dir, name):
    assert __spark_entry__.queries()[name](spark, sf_dir).count() > 0

import numpy as np
from pyspark.sql import functions as F

from panelloom.llm import quality


def test_held_out_accuracy(spark, sf_dir, space_of):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_quality(docs, labels, space_of("q")).join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in rows]
    assert len(rows) > 40 and np.mean(right) >= 0.93
    clean = [r.predicted for r in rows if r.quality == 1]
    assert np.mean(clean) >= 0.95
    assert all((r.score >= 0.3) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)


def test_pairs_order_the_classes():
    dice = np.random.default_rng(0)
    good = np.array([1] * 80 + [0] * 20)
    x = dice.normal(size=(100, 4)) + good[:, None] * np.array([3, 0, -3, 0])
    model = quality.fit(x, good)
    s = model.score(x)
    assert s[good == 1].mean() > 0.7 and s[good == 0].mean() < 0.3
    assert ((s >= 0.3) == (good == 1)).mean() > 0.95


def test_one_class_or_no_labels():
    x = np.ones((5, 3))
    assert (quality.fit(x, np.ones(5)).score(x) >= 0.3).all()
    assert (quality.fit(x, np.zeros(5)).score(x) < 0.3).all()
    assert (quality.fit(np.zeros((0, 3)), np.zeros(0)).score(x) >= 0.3).all()


def test_features_of_odd_texts():
    assert not quality.text_features(None).any() and not quality.text_features("").any()
    for t in (" ", "\n", "a", "ß" * 100_000, "\x00"):
        assert np.isfinite(quality.text_features(t)).all()


def test_edges(spark, edge_docs, no_docs, space_of):
    labels = spark.createDataFrame([(3, 1, 0, "x"), (3, 0, 0, "x"), (4, 1, 0, "y"), (None, 1, 0, "z"), (5, None, 0, "z"), (7, 0, 1, "q"), (99, 7, 0, "w")], "doc_id long, quality int, toxic int, text string")
    rows = quality.score_quality(edge_docs, labels, space_of("q")).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert quality.score_quality(no_docs, labels, space_of("q")).count() == 0
    assert quality.score_quality(edge_docs, labels.limit(0), space_of("q")).where("predicted = 0").count() == 0


def test_labels_of_the_held_out_fold_change_nothing(spark, documents, sf_dir, space_of):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.score_quality(documents, x, space_of("q")).collect())) for x in (labels, turned))
    assert a == b


def test_threshold_is_of_all_labelled_rows(spark, documents, sf_dir, space_of):
    """A fit on few rows of each class leaves about as many labelled rows under the cutoff as are bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.score_quality(documents, labels, space_of("q"), each=8).join(labels, "doc_id").where("not held_out").collect()
    bad = sum(r.quality == 0 for r in rows)
    assert bad and abs(sum(r.predicted == 0 for r in rows) - bad) <= 1

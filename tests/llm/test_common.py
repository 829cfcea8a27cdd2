import time

from pyspark.sql import functions as F

from panelloom.llm.common import CLEANUP


def shuffled(spark):
    return [f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if f.rsplit("/", 1)[-1].startswith("shuffle_")]


def test_a_written_table_leaves_no_shuffle_files(spark, space_of):
    space = space_of("common")
    before, setting = set(shuffled(spark)), spark.conf.get(CLEANUP, None)
    rows = spark.range(10_000).withColumn("k", F.col("id") % 7)
    found = space.write(rows.repartition(3, "k").join(rows.groupBy("k").count(), "k"), "t")
    space.write(rows.repartition(3, "k"), "u")
    assert spark.conf.get(CLEANUP, None) == setting
    until = time.time() + 10  # the files go soon after
    while set(shuffled(spark)) - before and time.time() < until:
        time.sleep(0.2)
    assert not set(shuffled(spark)) - before
    assert len(found.collect()) == 10_000


def test_inner_folders_go_alone(spark, space_of):
    space = space_of("outer")
    space.write(spark.range(3), "kept")
    inner = space.within("inner")
    inner.write(spark.range(4), "t")
    assert inner.root.startswith(space.root + "/") and inner.read("t").count() == 4
    inner.drop()
    assert space.read("kept").count() == 3

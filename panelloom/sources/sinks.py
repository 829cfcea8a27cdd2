"""Sinks: partitioned tables in place of one file for each date, and their checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace just the partitions that df has; a rerun leaves nothing stale in them."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_years(df: DataFrame, path: str, years: Iterable[int], date: str = "date") -> list[int]:
    """Factor rows by year, a partition for each of the years asked for: one without rows gets a file that
    has the columns only. Returns those years."""
    write_partitions(df.withColumn("year", F.year(date)), path, ["year"])
    wanted = df.sparkSession.createDataFrame([(int(y),) for y in years], "year int")
    have = df.select(F.year(date).alias("year")).distinct()
    empty = sorted(r[0] for r in wanted.join(have, "year", "left_anti").collect())
    nothing = df.sparkSession.createDataFrame([], df.schema).repartition(1)
    for y in empty:
        nothing.write.mode("overwrite").parquet(f"{path}/year={y}")
    return empty


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove_partitions(spark: SparkSession, path: str, column: str, keep: Iterable[str]) -> int:
    """Delete partitions of one table that are not to be kept; returns how many. Other tables are untouched."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    wanted, gone = {f"{column}={k}" for k in keep}, 0
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{column}=") and name not in wanted:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone


def panel_complete(panel: DataFrame, expected: DataFrame, per_index: int) -> DataFrame:
    """(selection_date, complete): every expected index has per_index rows and none after the selection date."""
    have = panel.groupBy("selection_date", "index_code").agg(F.count("*").alias("n"), F.max("return_date").alias("last"))
    joined = expected.join(have, ["selection_date", "index_code"], "left")
    return joined.groupBy("selection_date").agg(F.min(F.coalesce((F.col("n") == per_index) & (F.col("last") <= F.col("selection_date")), F.lit(False))).alias("complete"))


def pending(expected: DataFrame, complete: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected outputs that are not complete."""
    return expected.join(complete, list(keys), "left_anti")

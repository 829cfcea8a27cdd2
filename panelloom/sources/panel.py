"""Daily bars from trades, and scans of panel files.

An instrument is a part, the index it tracks its brand, its category its type.
Facts are aggregated before anything else, so every later step works on the
panel (instruments by days), whatever the number of trades.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions.scalars import clean_text, finite, parse_date

#: Columns of a bar file: header, name here, kind (fixed values of the format).
BAR_COLUMNS = (
    ("日期", "date", "date"),
    ("代码", "etf_code", "text"),
    ("名称", "etf_name", "text"),
    ("上市日期", "listing_date", "date"),
    ("对标指数", "index_name", "text"),
    ("benchmark", "benchmark_desc", "text"),
    ("管理人", "manager", "text"),
    ("托管人", "custodian", "text"),
    ("类别大类", "category", "text"),
    ("类别细类", "subcategory", "text"),
    ("对标指数代码", "index_code", "text"),
    ("规模", "scale", "number"),
    ("成交量", "volume", "number"),
    ("成交额", "amount", "number"),
    ("收盘价", "close", "number"),
    ("VWAP", "vwap", "number"),
    ("溢价率", "premium_pct", "number"),
)
#: Headers of the index return and price files; the selection date has two.
PANEL_COLUMNS = (("月末交易日", "selection_date", "date"), ("筛选日期", "selection_date", "date"), ("收益日期", "return_date", "date"), ("对标指数代码", "index_code", "text"), ("对标指数", "index_name", "text"), ("收盘价", "close", "number"), ("日收益率", "daily_return", "number"))
PRICE_OUTPUT = ("selection_date", "return_date", "index_code", "index_name", "close", "daily_return")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _renamed(raw: DataFrame, columns: tuple) -> DataFrame:
    """Typed columns under their names here. Of headers with one name, the first non-null holds; absent ones are null."""
    made: dict[str, list] = {}
    for header, name, kind in columns:
        c = F.col(f"`{header}`") if header in raw.columns else F.lit(None).cast("string")
        made.setdefault(name, []).append({"date": parse_date, "text": clean_text, "number": finite}[kind](c))
    return raw.select(*[F.coalesce(*cs).alias(n) if len(cs) > 1 else cs[0].alias(n) for n, cs in made.items()])


def scan_csv(spark: SparkSession, folder: str, columns: tuple = BAR_COLUMNS) -> DataFrame:
    """All csv files of one folder (no subfolders, no other files), with a header and maybe a byte-order mark."""
    raw = spark.read.option("header", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", False).csv(folder)
    return _renamed(raw.withColumnsRenamed({c: c.lstrip("﻿") for c in raw.columns}), columns)


#: Trades that one task aggregates, about.
TASK_TRADES = 400_000


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades dealt out by instrument, so many parts that one has TASK_TRADES on average, however large the table is.

    Few trades share an instrument and a day, so there is nothing to gain (and a table of
    groups of each file split to hold) by adding them up before they are dealt out."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    parts = max(spark.sparkContext.defaultParallelism, -(-line.count() // TASK_TRADES))
    return line.repartition(parts, "l_partkey")


def etf_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, etf_code, index_code, category, volume, amount, vwap, close) of each instrument and day."""
    line = trades(spark, sf_dir).select(F.to_date("l_shipdate").alias("date"), F.col("l_partkey").alias("etf_code"), "l_quantity", "l_extendedprice")
    daily = line.groupBy("date", "etf_code").agg(
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("etf_code"), F.col("p_brand").alias("index_code"), F.col("p_type").alias("category"))
    return daily.join(part, "etf_code").select("date", "etf_code", "index_code", "category", "volume", "amount", (F.col("amount") / F.col("volume")).alias("vwap"), "close")


def index_bars(spark: SparkSession, sf_dir: str, by: str = "day") -> DataFrame:
    """(date, index_code, volume, amount, vwap, close) of each index and day, or month."""
    date = F.to_date("l_shipdate")
    line = trades(spark, sf_dir).select((date if by == "day" else F.trunc(date, "month")).alias("date"), "l_partkey", "l_quantity", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("index_code"))
    # Indexes are few, so their days are added up within tasks first.
    joined = line.join(part, line.l_partkey == part.p_partkey)
    total = joined.groupBy("date", "index_code").agg(F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"), (F.sum(F.col("l_extendedprice") / F.col("l_quantity")) / F.count("*")).alias("close"))
    return total.select("date", "index_code", "volume", "amount", (F.col("amount") / F.col("volume")).alias("vwap"), "close")


def calendar(bars: DataFrame) -> DataFrame:
    """(date, pos) of the trading days, pos from 1. A few thousand rows, so one window over them is fine."""
    return bars.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))

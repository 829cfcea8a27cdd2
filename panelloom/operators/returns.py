"""Return panels over dates that all indexes share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.config import PANEL_CLOSES
from panelloom.functions.scalars import ratio


def daily_returns(bars: DataFrame) -> DataFrame:
    """(date, index_code, close, daily_return): close over the close before, less one; null on the first day."""
    before = F.lag("close").over(Window.partitionBy("index_code").orderBy("date"))
    return bars.select("date", "index_code", "close", (ratio(F.col("close"), before) - 1).alias("daily_return"))


def common_dates(bars: DataFrame) -> DataFrame:
    """Dates on which every index of the panel has a close (a relational division)."""
    total = bars.agg(F.countDistinct("index_code").alias("total"))
    each = bars.where("close is not null").groupBy("date").agg(F.countDistinct("index_code").alias("n"))
    return each.join(F.broadcast(total), F.col("n") == F.col("total")).select("date")  # one row


def return_panel(bars: DataFrame, selection_date: str | None = None, closes: int = PANEL_CLOSES) -> DataFrame:
    """(index_code, return_date, close, daily_return): the last returns on common dates up to the selection date, nothing after it."""
    past = bars if selection_date is None else bars.where(F.col("date") <= F.lit(selection_date).cast("date"))
    dates = common_dates(past).withColumn("k", F.row_number().over(Window.orderBy(F.desc("date")))).where(F.col("k") <= closes)
    inside = past.join(dates, "date")
    before = F.lag("close").over(Window.partitionBy("index_code").orderBy("date"))
    return inside.select("index_code", F.col("date").alias("return_date"), "close", (ratio(F.col("close"), before) - 1).alias("daily_return")).where("daily_return is not null")


def insufficient(bars: DataFrame, closes: int = PANEL_CLOSES) -> DataFrame:
    """Indexes with too few closes for a panel."""
    return bars.where("close is not null").groupBy("index_code").agg(F.count("*").alias("n_closes")).where(F.col("n_closes") < closes)

"""Selection calendar, turnover windows and the initial screen."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.config import TURNOVER_DATES, validate


def selection_plans(calendar: DataFrame, frequency: str, start: str, dates: int = TURNOVER_DATES) -> DataFrame:
    """(selection_date, pos): every day from the start on, or the last day of each month. Days without a full turnover window are left out."""
    validate(update_frequency=frequency)
    able = calendar.where((F.col("date") >= F.lit(start).cast("date")) & (F.col("pos") >= dates))
    if frequency == "daily":
        return able.select(F.col("date").alias("selection_date"), "pos")
    return able.groupBy(F.trunc("date", "month")).agg(F.max("date").alias("selection_date"), F.max("pos").alias("pos")).select("selection_date", "pos")


def turnover_windows(plans: DataFrame, calendar: DataFrame, dates: int = TURNOVER_DATES) -> DataFrame:
    """(selection_date, date): the trading days that end on the selection date, by an equi-join on calendar positions."""
    wanted = plans.select("selection_date", F.explode(F.sequence(F.col("pos") - (dates - 1), F.col("pos"))).alias("pos"))
    return wanted.join(calendar, "pos").select("selection_date", "date")


def average_turnover(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """(selection_date, etf_code, index_code, category, avg_turnover_20d): mean amount over the window's days; null amounts and days without a bar do not count."""
    return windows.join(bars, "date").groupBy("selection_date", "etf_code", "index_code", "category").agg(F.avg("amount").alias("avg_turnover_20d"))


def largest_by(df: DataFrame, keys: list[str], order: list, *columns: str) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").select(*columns)


def listing_dates(bars: DataFrame) -> DataFrame:
    return bars.groupBy("etf_code").agg(F.min("date").alias("listing_date"))


def initial_screen(turnover: DataFrame, bars: DataFrame, excluded: tuple[str, ...] = ("ECONOMY",), min_age: int = 365, min_turnover: float = 0.0) -> DataFrame:
    """One instrument for each selection date and index: of the right category, listed long enough and traded enough, the one with the largest turnover, ties to the smallest code."""
    aged = turnover.join(listing_dates(bars), "etf_code")
    able = aged.where(~F.col("category").isin(*excluded) & (F.datediff("selection_date", "listing_date") >= min_age) & (F.col("avg_turnover_20d") >= min_turnover))
    key = F.round("avg_turnover_20d", 6)
    return largest_by(able, ["selection_date", "index_code"], [key.desc(), F.col("etf_code")], "selection_date", "index_code", "etf_code", "category", "listing_date", "avg_turnover_20d")

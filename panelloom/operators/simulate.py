"""Staggered portfolios with trading costs under two fill models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.config import COST_RATE, validate
from panelloom.operators import accounts


def stagger_schedule(calendar: DataFrame, days: int, mode: str) -> DataFrame:
    """(account_id, date, signal_date): account k of d acts first on position k - 1 (close) or k (next_day_vwap, on the signal of the day before), then every d days."""
    validate(stagger_days=days, execution_mode=mode)
    shift = 0 if mode == "close" else 1
    signal = F.lag("date", shift).over(Window.orderBy("date")) if shift else F.col("date")
    at = calendar.withColumn("signal_date", signal).withColumn("slot", F.col("pos") - 1 - shift).where("slot >= 0")
    return at.select((F.pmod("slot", F.lit(days)) + 1).cast("int").alias("account_id"), "date", "signal_date")


def run_accounts(calendar: DataFrame, targets: DataFrame, prices: DataFrame, days: int, mode: str, rate: float = COST_RATE) -> DataFrame:
    """Account-day rows of the d accounts of one staggered portfolio.

    targets: (signal_date, etf_code, weight); prices: (date, etf_code, close, vwap). For many
    portfolios at once, and for trades, see ``accounts.run_portfolios``."""
    validate(stagger_days=days, execution_mode=mode)
    case = calendar.sparkSession.createDataFrame([("", days, mode)], "case_id string, stagger_days int, execution_mode string")
    rows = accounts.run_portfolios(calendar, case, targets.withColumn("case_id", F.lit("")), prices, trades=False, rate=rate)
    return accounts.account_days(rows).drop("case_id")


def portfolio_nav(days: DataFrame) -> DataFrame:
    """(date, nav, turnover, cost, n_holdings): sums over the accounts."""
    return days.groupBy("date").agg(F.sum("account_nav").alias("nav"), F.sum("turnover").alias("turnover"), F.sum("cost").alias("cost"), F.sum("n_holdings").alias("n_holdings"))


def top_one_nav(choice: DataFrame, prices: DataFrame, mode: str, rate: float = COST_RATE) -> DataFrame:
    """(date, index_code, log_nav, nav) of one account that always holds the chosen index, in closed form.

    choice: one (date, index_code) a day; prices: (date, index_code, close, vwap).
    Keeping the index costs nothing; a change costs (1 - c) / (1 + c), the first
    purchase 1 / (1 + c). With next_day_vwap the change falls between the old
    index's way to the day's vwap and the new one's from it to the close. The
    product over days is the exponential of a running sum of logarithms."""
    validate(execution_mode=mode)
    by = Window.orderBy("date")  # one row a day
    if mode == "close":
        plan = choice.select("date", F.col("index_code").alias("now")).withColumn("old", F.lag("now").over(by))
    else:
        plan = choice.select("date", "index_code").withColumn("now", F.lag("index_code").over(by)).withColumn("old", F.lag("index_code", 2).over(by)).drop("index_code")
    plan = plan.withColumn("before", F.lag("date").over(by))
    side = lambda p, code, day: prices.select(F.col("date").alias(day), F.col("index_code").alias(code), F.col("close").alias(f"{p}_close"), F.col("vwap").alias(f"{p}_vwap"))
    rows = plan.join(side("old", "old", "date"), ["date", "old"], "left").join(side("was", "old", "before"), ["before", "old"], "left").join(side("new", "now", "date"), ["date", "now"], "left")
    fee = F.when(F.col("old").isNull(), F.lit(1 / (1 + rate))).when(F.col("old") == F.col("now"), F.lit(1.0)).otherwise(F.lit((1 - rate) / (1 + rate)))
    if mode == "close":
        step = F.coalesce(F.col("old_close") / F.col("was_close"), F.lit(1.0)) * fee
    else:
        step = F.when(F.col("now").isNull(), F.lit(1.0)).otherwise(F.coalesce(F.col("old_vwap") / F.col("was_close"), F.lit(1.0)) * fee * F.col("new_close") / F.col("new_vwap"))
    return rows.withColumn("log_nav", F.sum(F.log(step)).over(by)).select("date", F.col("now").alias("index_code"), "log_nav", F.exp("log_nav").alias("nav"))

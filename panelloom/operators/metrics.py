"""Performance of NAV series: no risk-free rate, downside against zero; 252 rows a year unless the series is of longer periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.config import DAYS_A_YEAR
from panelloom.functions.scalars import ratio


def _windows(keys: Sequence[str]) -> tuple:
    by = Window.partitionBy(*keys).orderBy("date")
    return by, by.rowsBetween(Window.unboundedPreceding, 0)


def drawdowns(nav: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """nav with daily_return, the running peak, the date of its first day and the drawdown from it (0 or less)."""
    by, so_far = _windows(keys)
    before = F.lag("nav").over(by)
    peaked = nav.withColumn("daily_return", ratio(F.col("nav"), before) - 1).withColumn("peak", F.max("nav").over(so_far)).withColumn("drawdown", ratio(F.col("nav"), F.col("peak")) - 1)
    top = F.lag("peak").over(by)
    return peaked.withColumn("peak_date", F.when(top.isNull() | (F.col("peak") > top), F.col("date"))).withColumn("peak_date", F.last("peak_date", ignorenulls=True).over(so_far))


def _trading(periods: int) -> list:
    """Of days with turnover, cost, n_holdings and n_rebalanced: one-way turnover a day and a year, costs over value, holdings, rebalances."""
    daily = F.avg(ratio(F.col("turnover"), 2 * F.col("nav")))
    return [daily.alias("mean_daily_turnover"), (daily * periods).alias("annual_turnover"), F.sum(ratio(F.col("cost"), F.col("nav"))).alias("total_cost_rate"), F.avg("n_holdings").alias("mean_holdings"), F.sum("n_rebalanced").alias("n_rebalances")]


def performance(nav: DataFrame, keys: Sequence[str] = (), periods: int = DAYS_A_YEAR, trading: bool = False) -> DataFrame:
    """One row for each series; with ``trading`` also what its trading was, from days of ``accounts.portfolio_days``.

    Ratios are null where their denominator is zero or there is one day only."""
    d = drawdowns(nav, keys)
    years = (F.count("*") - 1) / F.lit(float(periods))
    first, last = F.min_by("nav", "date"), F.max_by("nav", "date")
    r = d.groupBy(*keys).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("n_days"), first.alias("initial_nav"), last.alias("final_nav"),
        (ratio(last, first) - 1).alias("total_return"), F.when(years > 0, F.pow(ratio(last, first), 1 / F.nullif(years, F.lit(0.0))) - 1).alias("annual_return"),
        (F.stddev_samp("daily_return") * F.sqrt(F.lit(float(periods)))).alias("annual_volatility"),
        (ratio(F.avg("daily_return"), F.stddev_samp("daily_return")) * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        (ratio(F.avg("daily_return"), F.sqrt(F.avg(F.pow(F.least("daily_return", F.lit(0.0)), 2.0)))) * F.sqrt(F.lit(float(periods)))).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"), F.min_by("date", F.struct(F.round("drawdown", 10), "date")).alias("max_drawdown_date"),
        F.min_by("peak_date", F.struct(F.round("drawdown", 10), "date")).alias("max_drawdown_start"),
        *(_trading(periods) if trading else ()),
    )
    return r.withColumn("calmar", ratio(F.col("annual_return"), -F.col("max_drawdown")))


def annual_metrics(nav: DataFrame, keys: Sequence[str] = (), periods: int = DAYS_A_YEAR) -> DataFrame:
    """(year, n_days, year_return, year_volatility, year_max_drawdown); a year's return starts from the last value of the year before."""
    by, _ = _windows(keys)
    rows = drawdowns(nav, keys).withColumn("year", F.year("date")).withColumn("before", F.lag("nav").over(by))
    inside = Window.partitionBy(*keys, "year").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("year_drawdown", ratio(F.col("nav"), F.max("nav").over(inside)) - 1)
    base = F.coalesce(F.min_by("before", "date"), F.min_by("nav", "date"))
    return rows.groupBy(*keys, "year").agg(F.count("*").alias("n_days"), (ratio(F.max_by("nav", "date"), base) - 1).alias("year_return"), (F.stddev_samp("daily_return") * F.sqrt(F.lit(float(periods)))).alias("year_volatility"), F.min("year_drawdown").alias("year_max_drawdown"))


def benchmark_nav(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, benchmark_nav): closes on the strategy's dates over the first of them."""
    joined = dates.select("date").join(bars.select("date", "close"), "date")
    first = F.first("close").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))  # one row a day
    return joined.select("date", ratio(F.col("close"), first).alias("benchmark_nav"))


def relative_performance(nav: DataFrame, benchmark: DataFrame, periods: int = DAYS_A_YEAR) -> DataFrame:
    """Annual returns, tracking error, information ratio and the drawdown of the excess curve."""
    by = Window.orderBy("date")
    both = nav.select("date", "nav").join(benchmark, "date")
    r = both.withColumn("x", ratio(F.col("nav"), F.lag("nav").over(by)) - ratio(F.col("benchmark_nav"), F.lag("benchmark_nav").over(by))).withColumn("rel", ratio(F.col("nav"), F.col("benchmark_nav")))
    r = r.withColumn("down", ratio(F.col("rel"), F.max("rel").over(by.rowsBetween(Window.unboundedPreceding, 0))) - 1)
    years = F.nullif((F.count("*") - 1) / F.lit(float(periods)), F.lit(0.0))
    grown = lambda c: F.pow(ratio(F.max_by(c, "date"), F.min_by(c, "date")), 1 / years) - 1
    root = F.sqrt(F.lit(float(periods)))
    return r.agg(grown("benchmark_nav").alias("benchmark_annual_return"), (grown("nav") - grown("benchmark_nav")).alias("excess_annual_return"), (F.stddev_samp("x") * root).alias("tracking_error"), (ratio(F.avg("x"), F.stddev_samp("x")) * root).alias("information_ratio"), F.min("down").alias("excess_max_drawdown"), (ratio(F.max_by("rel", "date"), F.min_by("rel", "date")) - 1).alias("excess_cumulative"))


def turnover_cost(accounts: DataFrame) -> DataFrame:
    """(date, one_way_turnover, cost_rate, n_holdings, capacity share): traded over twice the value, cost over the value."""
    day = accounts.groupBy("date").agg(F.sum("account_nav").alias("nav"), F.sum("turnover").alias("traded"), F.sum("cost").alias("paid"), F.sum("n_holdings").alias("n_holdings"), F.count_if("rebalanced").alias("n_rebalanced"))
    return day.select("date", ratio(F.col("traded"), 2 * F.col("nav")).alias("one_way_turnover"), ratio(F.col("paid"), F.col("nav")).alias("cost_rate"), "n_holdings", "n_rebalanced")


def capacity(targets: DataFrame, share: float = 0.1) -> DataFrame:
    """(signal_date, capacity): the largest portfolio whose every order stays under a share of the day's amount."""
    return targets.groupBy("signal_date").agg(F.min(F.lit(share) * F.col("selection_amount") / F.col("target_weight")).alias("capacity"))

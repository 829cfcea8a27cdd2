"""Trend factors over rolling windows, and the pool that is active on a date."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.config import TREND_WINDOWS
from panelloom.functions.scalars import ratio

#: Columns of the factor table, in order.
FACTOR_COLUMNS = ("date", "pool_date", "etf_code", "etf_name", "index_code", "index_name", "trend_window", "window_start", "window_end", "window_start_close", "window_end_close", "log_price_slope", "window_return", "window_volatility", "r_squared", "return_r2", "return_vol", "factor_rank", "rank_pct")


def trend_windows(bars: DataFrame, windows: Sequence[int] = TREND_WINDOWS) -> DataFrame:
    """Trend of every index, date and window of n closes ending on the date.

    log_price_slope and r_squared are of the regression of the log close on time;
    window_volatility is the sample deviation of the n - 1 returns times the root
    of n - 1; return_r2 = return x R², return_vol = return / volatility. Rows with
    fewer than n closes are left out. All windows share one sort of the panel.
    """
    by = Window.partitionBy("index_code").orderBy("date")
    base = bars.select("index_code", "date", "close").where("close > 0")
    base = base.withColumn("t", F.row_number().over(by).cast("double")).withColumn("y", F.log("close")).withColumn("ret", ratio(F.col("close"), F.lag("close").over(by)) - 1)
    parts = []
    for n in windows:
        w, inner = by.rowsBetween(-(n - 1), 0), by.rowsBetween(-(n - 2), 0)
        parts.append(
            F.struct(
                F.lit(n).alias("trend_window"),
                F.count("close").over(w).alias("n"),
                F.first("date").over(w).alias("window_start"),
                F.first("close").over(w).alias("window_start_close"),
                F.regr_slope("y", "t").over(w).alias("log_price_slope"),
                F.regr_r2("y", "t").over(w).alias("r_squared"),
                (F.stddev_samp("ret").over(inner) * F.sqrt(F.lit(float(n - 1)))).alias("window_volatility"),
            )
        )
    flat = base.select("index_code", "date", "close", F.array(*parts).alias("w")).select("index_code", "date", F.col("close").alias("window_end_close"), F.inline("w"))
    whole = flat.where(F.col("n") == F.col("trend_window")).withColumn("window_return", ratio(F.col("window_end_close"), F.col("window_start_close")) - 1)
    return whole.select(
        "date", "index_code", "trend_window", "window_start", F.col("date").alias("window_end"), "window_start_close", "window_end_close", "log_price_slope", "window_return", "window_volatility", "r_squared",
        (F.col("window_return") * F.col("r_squared")).alias("return_r2"), ratio(F.col("window_return"), F.col("window_volatility")).alias("return_vol"),
    )


def rank_factor(trends: DataFrame, score: str, keys: Sequence[str] = ("date", "trend_window")) -> DataFrame:
    """factor_rank (1 is best, ties to the smaller code) and rank_pct = rank / number of the date. Null scores come last."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.round(score, 10).desc_nulls_last(), "index_code"))
    return trends.withColumn("factor_rank", rank).withColumn("rank_pct", F.col("factor_rank") / F.count("*").over(w))


def stacked_scores(trends: DataFrame) -> DataFrame:
    """One row for each factor: (…, method, score), from one scan of the factor table."""
    keep = [c for c in trends.columns if c not in ("return_r2", "return_vol")]
    return trends.unpivot(keep, ["return_r2", "return_vol"], "method", "score")


def pool_ranges(snapshots: DataFrame) -> DataFrame:
    """(selection_date, next_date): a pool is active after its date up to the next one's; the last stays."""
    dates = snapshots.select("selection_date").distinct()  # dates, not members: a short table
    return dates.withColumn("next_date", F.lead("selection_date").over(Window.orderBy("selection_date")))


def active_pool(dates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(date, selection_date): the latest snapshot strictly before the date; null where there is none.

    An as-of join as a merge: both sides in one column, the last snapshot seen so far."""
    both = dates.select("date", F.lit(1).alias("side"), F.lit(None).cast("date").alias("s")).unionByName(snapshots.select(F.col("selection_date").alias("date"), F.lit(2).alias("side"), F.col("selection_date").alias("s")).distinct())
    seen = F.last("s", ignorenulls=True).over(Window.orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("selection_date", seen).where("side = 1").select("date", "selection_date")


def price_intervals(snapshots: DataFrame, bars: DataFrame, before: int = 60) -> DataFrame:
    """(selection_date, end_date, index_code, date, close): the closes of each pool's indexes from ``before`` closes ahead of the pool to the next pool's date (the last pool: its own)."""
    ends = pool_ranges(snapshots).select("selection_date", F.coalesce("next_date", "selection_date").alias("end_date"))
    numbered = bars.select("index_code", "date", "close").withColumn("k", F.row_number().over(Window.partitionBy("index_code").orderBy("date")))
    pool = snapshots.select("selection_date", "index_code").distinct().join(ends, "selection_date")
    # As of a pool's two dates: dates and closes in one column of an index, the last close seen so far.
    asked = pool.select("index_code", "selection_date", "end_date", F.inline(F.array(F.struct(F.col("selection_date").alias("date"), F.lit("last").alias("what")), F.struct(F.col("end_date").alias("date"), F.lit("stop").alias("what")))))
    none = {"k": F.lit(None).cast("int"), "side": F.lit(2)}
    closes = numbered.select("index_code", F.lit(None).cast("date").alias("selection_date"), F.lit(None).cast("date").alias("end_date"), "date", F.lit(None).cast("string").alias("what"), "k", F.lit(1).alias("side"))
    seen = F.last("k", ignorenulls=True).over(Window.partitionBy("index_code").orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0))
    found = asked.withColumns(none).unionByName(closes).withColumn("seen", seen).where("side = 2")
    span = found.groupBy("selection_date", "end_date", "index_code").agg(F.max(F.when(F.col("what") == "last", F.col("seen"))).alias("last"), F.max(F.when(F.col("what") == "stop", F.col("seen"))).alias("stop"))
    wanted = span.where("last is not null").select("selection_date", "end_date", "index_code", F.explode(F.sequence(F.greatest(F.col("last") - before, F.lit(1)), F.col("stop"))).alias("k"))
    return wanted.join(numbered, ["index_code", "k"]).select("selection_date", "end_date", "index_code", "date", "close")


def daily_factor_rows(pool: DataFrame, members: DataFrame, trends: DataFrame) -> DataFrame:
    """Both factor values of every member of the pool that is active on a date."""
    active = pool.where("selection_date is not null").join(members, "selection_date").select("date", F.col("selection_date").alias("pool_date"), "index_code", "etf_code")
    return active.join(trends, ["date", "index_code"])


def union_checked(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Tables of several files as one, a row for each key. Files overlap, and what they repeat counts once;
    where they disagree in any value, null or not, the query fails and names the key."""
    every = reduce(DataFrame.unionByName, parts)
    values = [c for c in every.columns if c not in keys]
    same = [F.min(F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v"))).eqNullSafe(F.max(F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")))) for c in values]
    found = every.groupBy(*keys).agg(*[F.first(c).alias(c) for c in values], reduce(lambda a, b: a & b, same, F.lit(True)).alias("_same"))
    what = F.concat(F.lit("files disagree at "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    checked = F.when(F.col("_same"), F.lit(True)).otherwise(F.raise_error(what).cast("boolean"))
    return found.where(checked).select(*every.columns)


def union_trends(parts: Sequence[DataFrame]) -> DataFrame:
    """Factor tables of several files as one, see union_checked."""
    return union_checked(parts, ("date", "index_code", "trend_window"))

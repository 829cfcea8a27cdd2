"""Bias and volatility filters, top selection and targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.config import BIAS_UPPER, BIAS_WINDOW, FILTER_PROFILES, STALE_DAYS, TOLERANCE, TOP_FRACTION, VOL_KEEP, VOL_WINDOW, validate
from panelloom.functions.scalars import keep_count, ratio
from panelloom.operators.universe import largest_by


def filter_metrics(bars: DataFrame, bias_windows: Sequence[int] = (BIAS_WINDOW,), vol_windows: Sequence[int] = (VOL_WINDOW,)) -> DataFrame:
    """(index_code, date, close, bias_n…, vol_n…), all windows over one sort.

    bias: close over the mean of the last n closes, the day's included, less one.
    vol: sample deviation of the last n daily returns. Null without enough history.

    A window is the difference of two running sums, its end's and that of n rows before, so
    each costs two look-ups whatever its length. The sums are exact decimals (18 places of
    closes, 24 of returns): their differences lose nothing to the length of the history."""
    by = Window.partitionBy("index_code").orderBy("date")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    exact = lambda c, places: F.coalesce(F.sum(c.cast(f"decimal(38,{places})")).over(so_far), F.lit(0).cast(f"decimal(38,{places})"))
    base = bars.select("index_code", "date", "close").withColumn("ret", ratio(F.col("close"), F.lag("close").over(by)) - 1)
    sums = {"_n": F.count("close").over(so_far), "_s": exact(F.col("close"), 18)}
    if vol_windows:
        sums |= {"_k": F.count("ret").over(so_far), "_r": exact(F.col("ret"), 24), "_q": exact(F.col("ret") * F.col("ret"), 24)}
    base = base.withColumns(sums)

    def inside(name: str, n: int) -> Column:
        before = F.lag(name, n).over(by)
        return F.col(name) - F.coalesce(before, F.lit(0).cast(base.schema[name].dataType))

    made: list[Column] = []
    for n in bias_windows:
        mean = inside("_s", n).cast("double") / n
        made.append(F.when(inside("_n", n) == n, ratio(F.col("close"), mean) - 1).alias(f"bias_{n}"))
    for n in vol_windows:
        squares, total = inside("_q", n).cast("double"), inside("_r", n).cast("double")
        rest = squares - total * total / n
        # what is left of equal returns by rounding is no deviation
        made.append(F.when(inside("_k", n) == n, F.sqrt(F.when(rest > 1e-14 * squares, rest).otherwise(0.0) / (n - 1))).alias(f"vol_{n}"))
    return base.select("index_code", "date", "close", *made)


def missing_history(bars: DataFrame, window: int) -> DataFrame:
    """Indexes with fewer than window + 1 closes, for an error before the run."""
    return bars.where("close is not null").groupBy("index_code").agg(F.count("*").alias("n_closes")).where(F.col("n_closes") < window + 1)


def require_history(bars: DataFrame, window: int) -> None:
    """Raise ValueError, naming some of them, where indexes have fewer than window + 1 closes."""
    short = [r.index_code for r in missing_history(bars, window).orderBy("index_code").limit(20).collect()]
    if short:
        raise ValueError(f"fewer than {window + 1} closes: {', '.join(map(str, short))}")


def fresh(signal: Column, last: Column, days: int = STALE_DAYS) -> Column:
    """Is the latest price recent enough?"""
    return F.datediff(signal, last) <= days


def asof_prices(signals: DataFrame, bars: DataFrame, days: int = STALE_DAYS) -> DataFrame:
    """(date, index_code, price_date, close, is_fresh) of every signal: the last close up to its date, and
    whether it is of the last ``days`` days; null and not fresh where there is none.

    A merge: closes and signals of an index in one order, the last close seen so far."""
    by = Window.partitionBy("index_code").orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0)
    kind = bars.schema["close"].dataType
    closes = bars.where("close is not null").select("index_code", "date", F.lit(0).alias("side"), F.struct(F.col("date").alias("price_date"), "close").alias("p"))
    asked = signals.select("index_code", "date", F.lit(1).alias("side"), F.lit(None).cast(closes.schema["p"].dataType).alias("p"))
    found = closes.unionByName(asked).withColumn("p", F.last("p", ignorenulls=True).over(by)).where("side = 1")
    is_fresh = F.coalesce(fresh(F.col("date"), F.col("p.price_date"), days), F.lit(False))
    return found.select("date", "index_code", "p.price_date", F.col("p.close").cast(kind).alias("close"), is_fresh.alias("is_fresh"))


def passes_bias(bias: Column, upper: float = BIAS_UPPER) -> Column:
    return F.coalesce(bias <= upper + TOLERANCE, F.lit(False))


def passes_volatility(vol: Column, keys: Sequence[str], share: float = VOL_KEEP, code: str = "index_code") -> Column:
    """Is the volatility among the highest share of the whole candidate set? Ties go to the smaller code, null never passes."""
    w = Window.partitionBy(*keys)
    order = F.row_number().over(w.orderBy(F.round(vol, 10).desc_nulls_last(), code))
    return vol.isNotNull() & (order <= keep_count(F.count("*").over(w), share))


def filter_candidates(candidates: DataFrame, metrics: DataFrame | None, profile: str, keys: Sequence[str] = ("date",), bias: str = f"bias_{BIAS_WINDOW}", vol: str = f"vol_{VOL_WINDOW}", upper: float = BIAS_UPPER, share: float = VOL_KEEP) -> DataFrame:
    """Candidates with the flag ``eligible``: both filters look at the whole set, their results meet, nobody moves up.

    The base profile reads no prices: ``metrics`` is not touched."""
    validate(filter_profile=profile)
    mode, use_vol = FILTER_PROFILES[profile]
    if mode == "none" and not use_vol:
        return candidates.withColumn("eligible", F.lit(True))
    wanted = [c for c, used in ((bias, mode == "upper"), (vol, use_vol)) if used]
    joined = candidates.join(metrics.select("date", "index_code", *wanted), ["date", "index_code"], "left")
    flag = F.lit(True)
    if mode == "upper":
        flag = flag & passes_bias(F.col(bias), upper)
    if use_vol:
        flag = flag & passes_volatility(F.col(vol), keys, share)
    return joined.withColumn("eligible", flag)


def top_fraction(flagged: DataFrame, score: str, keys: Sequence[str] = ("date",), fraction: float = TOP_FRACTION) -> DataFrame:
    """The best share of the eligible candidates of each date, one at least; ties to the smaller code."""
    able = flagged.where("eligible")
    w = Window.partitionBy(*keys)
    ranked = able.withColumn("factor_rank", F.row_number().over(w.orderBy(F.round(score, 10).desc_nulls_last(), "index_code"))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("factor_rank") <= keep_count(F.col("_n"), fraction)).drop("_n", "eligible")


def filter_counts(flagged: DataFrame, keys: Sequence[str] = ("date",)) -> DataFrame:
    """planned, eligible and filtered candidates of each date."""
    n, ok = F.count("*"), F.count_if("eligible")
    return flagged.groupBy(*keys).agg(n.alias("planned_index_count"), ok.alias("eligible_count"), (n - ok).alias("filtered_index_count"))


def tracking_etf(bars: DataFrame) -> DataFrame:
    """(date, index_code, etf_code, volume, amount): the instrument with the largest volume, ties to the smaller code."""
    return largest_by(bars, ["date", "index_code"], [F.col("volume").desc_nulls_last(), F.col("etf_code")], "date", "index_code", "etf_code", "volume", "amount")


def daily_targets(selected: DataFrame, tracking: DataFrame) -> DataFrame:
    """Selected indexes with their instrument and equal weights; an index without an instrument that day drops out."""
    joined = selected.join(tracking, ["date", "index_code"])
    n = F.count("*").over(Window.partitionBy("date"))
    return joined.select(F.col("date").alias("signal_date"), "index_code", "etf_code", (1 / n).alias("target_weight"), "factor_rank", F.col("volume").alias("selection_volume"), F.col("amount").alias("selection_amount"))


def aggregate_weights(targets: DataFrame) -> DataFrame:
    """Weights by instrument: those of indexes that map to one instrument add up."""
    return targets.groupBy("signal_date", "etf_code").agg(F.sum("target_weight").alias("weight"), F.count("*").alias("n_indexes"))


def execution_schedule(targets: DataFrame, calendar: DataFrame, mode: str) -> DataFrame:
    """Targets with the day they are executed: the signal day (close) or the next trading day (next_day_vwap)."""
    validate(execution_mode=mode)
    days = calendar.select(F.col("date").alias("signal_date"), (F.col("date") if mode == "close" else F.lead("date").over(Window.orderBy("date"))).alias("execution_date"))
    return targets.join(days, "signal_date").where("execution_date is not null")

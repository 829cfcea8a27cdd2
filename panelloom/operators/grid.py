"""Experiment matrices and parameter grids, as rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom import config
from panelloom.functions.scalars import keep_count
from panelloom.operators.select import passes_bias, passes_volatility


def experiment_matrix(spark: SparkSession) -> DataFrame:
    """The 2,400 cases, crossed from their dimensions."""
    axes = {"update_frequency": config.UPDATE_FREQUENCIES, "filter_profile": tuple(config.FILTER_PROFILES), "correlation_threshold": config.CORRELATION_THRESHOLDS, "trend_factor": config.TREND_FACTORS, "trend_window": config.TREND_WINDOWS, "stagger_days": config.STAGGER_DAYS}
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def tuning_matrix(spark: SparkSession) -> DataFrame:
    """The 1,200 compatible cases with their number of simulations."""
    rows = [asdict(c) | {"simulations": config.grid_cells(c.tuning_type) * len(config.TREND_FACTORS) * len(config.EXECUTION_MODES)} for c in config.tuning_cases()]
    return spark.createDataFrame(rows, "tuning_type string, update_frequency string, filter_profile string, correlation_threshold double, trend_window int, stagger_days int, simulations long")


def preparation_plan(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([asdict(t) | {"position": i} for i, t in enumerate(config.preparation_tasks(), 1)], "position int, stage string, update_frequency string, correlation_threshold double, trend_window int")


def input_keys(cases: DataFrame) -> DataFrame:
    """Inputs that cases share: factor tables and price tables, each once."""
    factor = cases.select(F.lit("factor").alias("kind"), "update_frequency", "correlation_threshold", "trend_window").distinct()
    price = cases.select(F.lit("price").alias("kind"), "update_frequency", "correlation_threshold", F.lit(None).cast("int").alias("trend_window")).distinct()
    return factor.unionByName(price)


def total_returns(choices: DataFrame, prices: DataFrame, cells: Sequence[str], rate: float = config.COST_RATE, mode: str = "close") -> DataFrame:
    """log_return and total_return of every cell that holds its one chosen index.

    Orders are filled at the close of the choice's day, or at the average price of the
    day after it. All cells run side by side: the product of the steps of a cell is a
    sum of logarithms, so nothing is recursive. A day without a choice keeps the holding."""
    config.validate(execution_mode=mode)
    by = Window.partitionBy(*cells).orderBy("date")
    later = mode != "close"
    now = F.lag("index_code").over(by) if later else F.col("index_code")
    plan = choices.withColumn("now", now).withColumn("old", F.lag("index_code", 1 + later).over(by)).withColumn("before", F.lag("date").over(by))
    fill = F.col("vwap" if later else "close")
    sold = prices.select("date", F.col("index_code").alias("old"), fill.alias("x1"))
    was = prices.select(F.col("date").alias("before"), F.col("index_code").alias("old"), F.col("close").alias("x0"))
    rows = plan.join(sold, ["date", "old"], "left").join(was, ["before", "old"], "left")
    fee = F.when(F.col("old").isNull(), F.lit(1 / (1 + rate))).when(F.col("old") == F.col("now"), F.lit(1.0)).otherwise(F.lit((1 - rate) / (1 + rate)))
    step = F.coalesce(F.col("x1") / F.col("x0"), F.lit(1.0)) * fee
    if later:  # what was bought at the average price is worth the close
        rows = rows.join(prices.select("date", F.col("index_code").alias("now"), (F.col("close") / F.col("vwap")).alias("rest")), ["date", "now"], "left")
        step = F.when(F.col("now").isNull(), F.lit(1.0)).otherwise(step * F.coalesce("rest", F.lit(1.0)))
    return rows.groupBy(*cells).agg(F.sum(F.log(step)).alias("log_return"), F.count("*").alias("n_days")).withColumn("total_return", F.exp("log_return") - 1)


def also_volatile(candidates: DataFrame, metrics: DataFrame, vol: str, share: float = config.VOL_KEEP) -> DataFrame:
    """Candidates that pass the fixed volatility filter, which looks at the whole set of a date and method; for a bias grid of the combined profile."""
    joined = candidates.join(metrics.select("date", "index_code", F.col(vol).alias("_vol")), ["date", "index_code"], "left")
    return joined.withColumn("_ok", passes_volatility(F.col("_vol"), ["method", "date"], share)).where("_ok").drop("_vol", "_ok")


def also_unbiased(candidates: DataFrame, metrics: DataFrame, bias: str, upper: float = config.BIAS_UPPER) -> DataFrame:
    """Candidates with the flag ``eligible`` of the fixed bias filter; for a volatility grid of the combined profile, whose order is of all of them."""
    joined = candidates.join(metrics.select("date", "index_code", F.col(bias).alias("_bias")), ["date", "index_code"], "left")
    return joined.withColumn("eligible", passes_bias(F.col("_bias"), upper)).drop("_bias")


def bias_choices(candidates: DataFrame, metrics: DataFrame, windows: Sequence[int], uppers: Sequence[float]) -> DataFrame:
    """(method, window, level, date, index_code): the best candidate that each cell lets pass.

    candidates: (date, index_code, method, score); metrics: bias_n for every window, computed once."""
    config.validate_grid(windows, uppers)
    long = candidates.join(metrics.select("date", "index_code", F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"bias_{n}").alias("bias")) for n in windows])).alias("m")).select("date", "index_code", "m.*"), ["date", "index_code"])
    # In order of score a candidate is the choice of the levels from its bias up to the lowest bias before it.
    order = Window.partitionBy("method", "window", "date").orderBy(F.round("score", 10).desc(), "index_code")
    lowest = F.min("bias").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stairs = long.where("bias is not null").withColumn("lowest", lowest).where("lowest is null or bias < lowest")
    mine = F.filter(F.array(*map(F.lit, uppers)), lambda u: (F.col("bias") <= u + config.TOLERANCE) & (F.col("lowest").isNull() | (F.col("lowest") > u + config.TOLERANCE)))
    return stairs.select("date", "index_code", "method", "window", F.explode(mine).alias("level"))


def volatility_choices(candidates: DataFrame, metrics: DataFrame, windows: Sequence[int], shares: Sequence[float]) -> DataFrame:
    """As bias_choices for the share of the most volatile candidates; the order of a window is made once for all shares.

    With a column ``eligible`` only candidates that have it are chosen, though all count for the order."""
    config.validate_grid(windows, shares)
    if "eligible" not in candidates.columns:
        candidates = candidates.withColumn("eligible", F.lit(True))
    long = candidates.join(metrics.select("date", "index_code", F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"vol_{n}").alias("vol")) for n in windows])).alias("m")).select("date", "index_code", "m.*"), ["date", "index_code"])
    w = Window.partitionBy("method", "window", "date")
    ordered = long.where("vol is not null").withColumn("place", F.row_number().over(w.orderBy(F.round("vol", 10).desc(), "index_code"))).withColumn("n", F.count("*").over(w))
    # From the most volatile on, a candidate with the best score so far is the choice of the shares that end before the next such.
    near = w.orderBy("place")
    best = F.min(F.when(F.col("eligible"), F.struct((-F.round("score", 10)).alias("s"), "index_code")))
    so_far = ordered.withColumn("best", best.over(near.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("eligible") & (F.col("best.index_code") == F.col("index_code")))
    until = F.coalesce(F.lead("place").over(near) - 1, F.col("n"))
    shared = F.filter(F.array(*map(F.lit, shares)), lambda s: keep_count(F.col("n"), s).between(F.col("place"), F.col("until")))
    return so_far.withColumn("until", until).select("date", "index_code", "method", "window", F.explode(shared).alias("level"))


def _members(candidates: DataFrame, metrics: DataFrame, kind: str, windows: Sequence[int]) -> DataFrame:
    """(method, date, members): the candidates of a day, best first, each with its metric of every window; a row for each date, so of the pool's size."""
    values = metrics.select("date", "index_code", F.array(*[F.col(f"{kind}_{n}") for n in windows]).alias("m"))
    eligible = F.col("eligible") if "eligible" in candidates.columns else F.lit(True)
    rows = candidates.select("method", "date", "index_code", (-F.round("score", 10)).alias("s"), eligible.alias("eligible")).join(values, ["date", "index_code"])
    return rows.groupBy("method", "date").agg(F.sort_array(F.collect_list(F.struct("s", "index_code", "eligible", "m"))).alias("members"))


def _of_windows(members: DataFrame, windows: Sequence[int]) -> DataFrame:
    """(method, date, window, x): of every window the candidates (place, code, eligible, v) that have its metric."""
    axis = F.posexplode(F.array(*map(F.lit, windows))).alias("w", "window")
    x = F.transform("members", lambda c, i: F.struct(i.alias("place"), c["index_code"].alias("code"), c["eligible"].alias("eligible"), F.get(c["m"], F.col("w")).alias("v")))
    return members.select("method", "date", "members", axis).select("method", "date", "window", F.filter(x, lambda c: c["v"].isNotNull()).alias("x"))


def _first(codes: Column, fraction: float) -> Column:
    return F.slice(codes, F.lit(1), keep_count(F.size(codes), fraction))


def _levels(rows: DataFrame, levels: Sequence[float], chosen: Callable[[Column], Column]) -> DataFrame:
    each = F.transform(F.array(*[F.lit(float(u)) for u in levels]), lambda u: F.struct(u.alias("level"), chosen(u).alias("codes")))
    return rows.select("method", "window", "date", F.inline(each)).where(F.size("codes") > 0)


def bias_sets(candidates: DataFrame, metrics: DataFrame, windows: Sequence[int], uppers: Sequence[float], fraction: float = config.TOP_FRACTION) -> DataFrame:
    """(method, window, level, date, codes): the top share of what each cell lets pass, best first; a date without any has no row."""
    config.validate_grid(windows, uppers)
    rows = _of_windows(_members(candidates, metrics, "bias", windows), windows)
    return _levels(rows, uppers, lambda u: _first(F.transform(F.filter("x", lambda c: c["eligible"] & (c["v"] <= u + config.TOLERANCE)), lambda c: c["code"]), fraction))


def volatility_sets(candidates: DataFrame, metrics: DataFrame, windows: Sequence[int], shares: Sequence[float], fraction: float = config.TOP_FRACTION) -> DataFrame:
    """As bias_sets for the share of the most volatile candidates; the order of a window is made once for all shares."""
    config.validate_grid(windows, shares)
    rows = _of_windows(_members(candidates, metrics, "vol", windows), windows)
    order = F.sort_array(F.transform("x", lambda c: F.struct((-F.round(c["v"], 10)).alias("v"), c["code"].alias("code"), c["place"].alias("place"), c["eligible"].alias("eligible"))))
    rows = rows.withColumn("x", order)

    def chosen(share: Column) -> Column:
        kept = F.slice("x", F.lit(1), keep_count(F.size("x"), share))
        best = F.sort_array(F.transform(F.filter(kept, lambda c: c["eligible"]), lambda c: F.struct(c["place"].alias("place"), c["code"].alias("code"))))
        return _first(F.transform(best, lambda c: c["code"]), fraction)

    return _levels(rows, shares, chosen)


def staggered_returns(sets: DataFrame, calendar: DataFrame, prices: DataFrame, cells: Sequence[str], days: int = 1, mode: str = "close", rate: float = config.COST_RATE) -> DataFrame:
    """log_return and total_return of every cell whose ``days`` accounts hold the sets of (cells, date, codes) in equal weights.

    After a rebalancing the weights are those of the target, whatever was before. So an
    account is a product of steps from one of its rebalancing days to the next, and a
    step depends on two sets and two days only: every different step is worked out once,
    however many cells and factors share it, and a cell is a sum of logarithms. In a step the
    value after costs is found by V' = V - rate x sum |w V' - p| from V' = V on, each round
    of which leaves a thousandth of the error. Prices are the last known up to a day;
    orders of next_day_vwap are filled at the average price of the day after the signal."""
    config.validate(stagger_days=days, execution_mode=mode)
    later = 0 if mode == "close" else 1
    by = Window.orderBy("date")  # one row a day
    plan_days = calendar.select("date", F.lead("date", later).over(by).alias("act") if later else F.col("date").alias("act"), (F.pmod(F.col("pos") - 1, F.lit(days)) + 1).alias("account")).where("act is not null")
    named = sets.withColumn("set", F.xxhash64("codes"))
    plan = named.join(F.broadcast(plan_days), "date").select(*cells, "account", F.col("act").alias("date"), "set")  # the calendar
    path = Window.partitionBy(*cells, "account").orderBy("date")
    plan = plan.withColumn("old", F.lag("set").over(path)).withColumn("before", F.lag("date").over(path)).withColumn("final", F.lead("date").over(path).isNull())
    codes = named.select("set", "codes").distinct()
    last = calendar.agg(F.max("date").alias("last"))
    moves = plan.where("old is not null").select("before", "old", "date", "set").distinct()
    ends = plan.where("final").select("date", "set").distinct().join(F.broadcast(last))  # one row
    share = F.explode("codes").alias("index_code"), (1 / F.size("codes")).alias("w")
    held = moves.join(codes.withColumnRenamed("set", "old"), "old").select("before", "old", "date", "set", *share)
    wanted = moves.join(codes, "set").select("before", "old", "date", "set", *share)
    kept = ends.join(codes, "set").select("date", "set", "last", *share)
    asked = held.select("index_code", "date").unionByName(held.select("index_code", F.col("before").alias("date"))).unionByName(kept.select("index_code", "date")).unionByName(kept.select("index_code", F.col("last").alias("date"))).distinct()
    known = _last_prices(asked, prices)
    fill = F.when(F.col("price_date") == F.col("date"), F.col("vwap")).otherwise(F.col("close")) if later else F.col("close")
    at = lambda day, name, value: known.select("index_code", F.col("date").alias(day), value.alias(name))
    grown = held.join(at("before", "x0", fill), ["index_code", "before"]).join(at("date", "x1", fill), ["index_code", "date"])
    key = ["before", "old", "date", "set"]
    legs = grown.select(*key, "index_code", (F.col("w") * F.col("x1") / F.col("x0")).alias("p"), F.lit(0.0).alias("goal")).unionByName(wanted.select(*key, "index_code", F.lit(0.0).alias("p"), F.col("w").alias("goal")))
    legs = legs.groupBy(*key, "index_code").agg(F.sum("p").alias("p"), F.sum("goal").alias("goal")).groupBy(*key).agg(F.sum("p").alias("v"), F.collect_list(F.struct("p", "goal")).alias("legs"))
    after = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.col("v"), lambda v, _: F.col("v") - rate * F.aggregate("legs", F.lit(0.0), lambda s, x: s + F.abs(x["goal"] * v - x["p"])))
    steps = legs.select(*key, F.log(after).alias("step"))
    value = kept.join(at("date", "x0", fill), ["index_code", "date"]).join(at("last", "x1", F.col("close")), ["index_code", "last"])
    value = value.groupBy("date", "set").agg(F.log(F.sum(F.col("w") * F.col("x1") / F.col("x0"))).alias("end"))
    bought = plan.join(steps, key, "left").join(value, ["date", "set"], "left")
    step = F.when(F.col("old").isNull(), F.lit(-math.log(1 + rate))).otherwise(F.col("step")) + F.when(F.col("final"), F.col("end")).otherwise(0.0)
    accounts = bought.groupBy(*cells, "account").agg(F.sum(step).alias("log_value"), F.count("*").alias("n"))
    # An account without any order keeps its cash. The sum of the accounts by its largest term, as values run over many orders of size.
    idle = F.lit(days) - F.size("x")
    top = F.when(idle > 0, F.greatest(F.array_max("x"), F.lit(0.0))).otherwise(F.array_max("x"))
    total = F.col("top") + F.log((F.aggregate("x", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))) + idle * F.exp(-F.greatest(F.col("top"), F.lit(-700.0)))) / days)
    summed = accounts.groupBy(*cells).agg(F.collect_list("log_value").alias("x"), F.sum("n").alias("n_rebalances")).withColumn("top", top)
    return summed.select(*cells, total.alias("log_return"), "n_rebalances").withColumn("total_return", F.exp("log_return") - 1)


def _last_prices(asked: DataFrame, prices: DataFrame) -> DataFrame:
    """(index_code, date, price_date, close, vwap): the last prices up to every date asked for, by a merge of both in one order."""
    kind = "struct<price_date: date, close: double, vwap: double>"
    have = prices.where("close is not null").select("index_code", "date", F.lit(0).alias("side"), F.struct(F.col("date").alias("price_date"), F.col("close").cast("double").alias("close"), F.col("vwap").cast("double").alias("vwap")).alias("p"))
    both = have.unionByName(asked.select("index_code", "date", F.lit(1).alias("side"), F.lit(None).cast(kind).alias("p")))
    seen = F.last("p", ignorenulls=True).over(Window.partitionBy("index_code").orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("p", seen).where("side = 1 and p is not null").select("index_code", "date", "p.*")


def heatmap(returns: DataFrame, windows: Sequence[int], value: str = "total_return") -> DataFrame:
    """One row for each level, one column for each window."""
    wide = returns.groupBy("method", "level").pivot("window", list(windows)).agg(F.first(value))
    return wide.withColumnsRenamed({str(n): f"w{n}" for n in windows})

"""A formal case from pools and bars to targets, accounts and performance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom import config
from panelloom.functions.scalars import ratio
from panelloom.operators import accounts, cluster, factor, metrics, select
from panelloom.operators.universe import largest_by
from panelloom.plans.runner import RunSummary, validate_plan
from panelloom.sources.sinks import exists, write_partitions


@dataclass(frozen=True)
class Panels:
    """What all cases share. ``calendar``: (date, pos); ``pools``: (selection_date, index_code, etf_code,
    avg_turnover_20d); ``returns``: bars of the return panels; ``indexes``, ``etfs``: daily bars."""

    calendar: DataFrame
    pools: DataFrame
    returns: DataFrame
    indexes: DataFrame
    etfs: DataFrame
    closes: int = config.PANEL_CLOSES


def _date_bits(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """(index_code, word, bits): the days on which an index has a close, a bit for each place of dates(date, pos)."""
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    return bars.select("index_code", "date").join(dates, "date").groupBy("index_code", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))


def shared_dates(members: DataFrame, bars: DataFrame, closes: int) -> DataFrame:
    """(selection_date, date): the last ``closes`` days up to each selection on which all its members have a close; none where there are fewer.

    Days are bits. A pool's members are met with one word for 64 days instead of with every
    day of their history, the words of a pool are joined by AND, and the last set bits of
    what remains are its days."""
    known = bars.where("close is not null")
    dates = known.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)  # one row a day
    pools = members.groupBy("selection_date").agg(F.count("*").alias("members"))
    # the last day up to a selection: two short tables in one order
    asked = pools.select(F.col("selection_date").alias("date"), F.lit(None).cast("int").alias("pos"), F.lit(1).alias("side")).unionByName(dates.select("date", "pos", F.lit(0).alias("side")))
    until = asked.withColumn("until", F.max("pos").over(Window.orderBy("date", "side").rowsBetween(Window.unboundedPreceding, 0))).where("side = 1 and until is not null").select(F.col("date").alias("selection_date"), "until")
    common = members.join(_date_bits(known, dates), "index_code").groupBy("selection_date", "word").agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n"))
    common = common.join(pools.join(until, "selection_date"), "selection_date").where("n = members and word <= until div 64")
    common = common.withColumn("bits", F.expr("if(word < until div 64, bits, bits & shiftrightunsigned(-1L, cast(63 - until % 64 as int)))"))
    newest = Window.partitionBy("selection_date").orderBy(F.desc("word"))
    common = common.withColumn("have", F.bit_count("bits")).withColumn("after", F.sum("have").over(newest) - F.col("have")).withColumn("total", F.sum("have").over(Window.partitionBy("selection_date")))
    places = F.filter(F.transform(F.sequence(F.lit(63), F.lit(0), F.lit(-1)), lambda k: F.when(F.getbit(F.col("bits"), k) == 1, F.col("word") * 64 + k)), lambda x: x.isNotNull())
    last = common.where((F.col("total") >= closes) & (F.col("after") < closes) & (F.col("have") > 0))
    return last.select("selection_date", F.explode(F.slice(places, F.lit(1), F.lit(closes) - F.col("after"))).alias("pos")).join(dates, "pos").select("selection_date", "date")


def snapshot_returns(pools: DataFrame, bars: DataFrame, closes: int = config.PANEL_CLOSES) -> DataFrame:
    """(selection_date, index_code, return_date, daily_return): the returns of each pool over the last
    dates up to its own on which all its members have a close; pools with fewer such dates have none."""
    members = pools.select("selection_date", "index_code").distinct()
    wanted = members.join(shared_dates(members, bars, closes), "selection_date")
    before = F.lag("close").over(Window.partitionBy("selection_date", "index_code").orderBy("date"))
    rows = wanted.join(bars.where("close is not null").select("index_code", "date", "close"), ["index_code", "date"])
    panel = rows.select("selection_date", "index_code", F.col("date").alias("return_date"), (ratio(F.col("close"), before) - 1).alias("daily_return"))
    return panel.where("daily_return is not null")


def snapshot_clusterings(panels: Panels, thresholds: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """(clusters of every pool and threshold, pairs of every pool)."""
    key = ("selection_date",)
    pairs = cluster.correlation_pairs(snapshot_returns(panels.pools, panels.returns, panels.closes), key)
    found = cluster.complete_linkage(panels.pools.select("selection_date", "index_code").distinct(), pairs, thresholds, key)
    return found.join(panels.pools.select("selection_date", "index_code", "etf_code", "avg_turnover_20d"), ["selection_date", "index_code"]), pairs


def snapshot_clusters(panels: Panels, threshold: float) -> DataFrame:
    """(selection_date, index_code, cluster_id, etf_code, avg_turnover_20d) of every pool."""
    return snapshot_clusterings(panels, (threshold,))[0].drop("corr_threshold")


def case_pools(clusters: DataFrame) -> DataFrame:
    """One index for each cluster of each pool: the largest turnover, ties to the smallest instrument code."""
    order = [F.round("avg_turnover_20d", 6).desc(), F.col("etf_code")]
    return largest_by(clusters, ["selection_date", "cluster_id"], order, "selection_date", "index_code", "etf_code")


def case_targets(case: config.ExperimentCase, panels: Panels) -> DataFrame:
    """Daily targets of a case: factor rows of the pool active on the day, filtered, the top share, its instruments."""
    config.validate(update_frequency=case.update_frequency, filter_profile=case.filter_profile, correlation_threshold=case.correlation_threshold, trend_factor=case.trend_factor, trend_window=case.trend_window, stagger_days=case.stagger_days)
    pools = case_pools(snapshot_clusters(panels, case.correlation_threshold))
    active = factor.active_pool(panels.calendar.select("date"), pools)
    rows = factor.daily_factor_rows(active, pools, factor.trend_windows(panels.indexes, (case.trend_window,)))
    rows = rows.select("date", "index_code", F.col(case.trend_factor).alias("score")).where("score is not null")
    measured = None if case.filter_profile == "base" else select.filter_metrics(panels.indexes)
    top = select.top_fraction(select.filter_candidates(rows, measured, case.filter_profile), "score")
    return select.daily_targets(top, select.tracking_etf(panels.etfs))


def _both_modes(spark, names: list[tuple[str, int]]) -> DataFrame:
    rows = [(name, f"{name}/{mode}", days, mode) for name, days in names for mode in config.EXECUTION_MODES]
    return spark.createDataFrame(rows, "name string, case_id string, stagger_days int, execution_mode string")


def run_modes(names: list[tuple[str, int]], targets: DataFrame, panels: Panels) -> DataFrame:
    """Account days and trades of cases (name, stagger_days) in both fill modes, as one job; targets have a column name."""
    plan = _both_modes(targets.sparkSession, names)
    weights = targets.groupBy("name", "signal_date", "etf_code").agg(F.sum("target_weight").alias("weight"))
    return accounts.run_portfolios(panels.calendar, plan.drop("name"), plan.select("name", "case_id").join(weights, "name").drop("name"), panels.etfs.select("date", "etf_code", "close", "vwap"))


def mode_performance(rows: DataFrame) -> DataFrame:
    """(name, execution_mode, …performance and trading) of rows of run_modes."""
    p = metrics.performance(accounts.portfolio_days(rows), ("case_id",), trading=True)
    return p.withColumn("name", F.substring_index("case_id", "/", 1)).withColumn("execution_mode", F.substring_index("case_id", "/", -1)).drop("case_id")


def run_case(case: config.ExperimentCase, panels: Panels) -> dict[str, DataFrame]:
    """Targets, account days and trades of both fill modes, and their performance, by name."""
    targets = case_targets(case, panels)
    rows = run_modes([("one", case.stagger_days)], targets.withColumn("name", F.lit("one")), panels)
    split = lambda df: df.withColumn("execution_mode", F.substring_index("case_id", "/", -1)).drop("case_id")
    return {"targets": targets, "accounts": split(accounts.account_days(rows)), "trades": split(accounts.trade_records(rows)), "nav": split(accounts.portfolio_days(rows)), "performance": mode_performance(rows).drop("name")}


def case_name(case: config.ExperimentCase) -> str:
    return "-".join(str(v) for v in vars(case).values())


def pending_cases(spark, path: str, cases: Sequence[config.ExperimentCase]) -> list[config.ExperimentCase]:
    """Cases without a committed partition of performance, the last table that a run writes."""
    wanted = spark.createDataFrame([(i, case_name(c)) for i, c in enumerate(cases)], "k int, name string")
    if exists(spark, f"{path}/performance"):
        done = spark.read.parquet(f"{path}/performance").select("name").distinct()
        wanted = wanted.join(done, "name", "left_anti")
    return [cases[r.k] for r in wanted.orderBy("k").collect()]


def run_pending(cases: Sequence[config.ExperimentCase], panels: Panels, path: str, force: bool = False) -> RunSummary:
    """Run all cases that are not there yet as one job, and write their tables by case.

    targets, rows (account days and trades) and performance are partitioned by name; a partition is
    replaced as a whole, when its job commits, so a run that broke off leaves nothing
    half done and the next takes its cases up again. Cases are validated first."""
    validate_plan(cases)
    spark = panels.calendar.sparkSession
    todo = list(cases) if force else pending_cases(spark, path, cases)
    if todo:
        each = [case_targets(c, panels).withColumn("name", F.lit(case_name(c))) for c in todo]
        write_partitions(reduce(DataFrame.unionByName, each), f"{path}/targets", ["name"])
        names = spark.createDataFrame([(case_name(c),) for c in todo], "name string")
        targets = spark.read.parquet(f"{path}/targets").join(names, "name", "left_semi")
        rows = run_modes([(case_name(c), c.stagger_days) for c in todo], targets, panels).withColumn("name", F.substring_index("case_id", "/", 1))
        write_partitions(rows, f"{path}/rows", ["name"])
        kept = spark.read.parquet(f"{path}/rows").join(names, "name", "left_semi").drop("name")
        write_partitions(mode_performance(kept), f"{path}/performance", ["name"])
    return RunSummary(len(cases), len(todo), len(cases) - len(todo))

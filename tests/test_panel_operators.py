"""Golden micro-fixtures and look-ahead tests of the panel operators."""

import datetime as dt
import math
import random
import statistics

import pytest
import stepwise
from pyspark.sql import functions as F

from panelloom.functions import scalars
from panelloom.operators import cluster, factor, grid, metrics, returns, select, simulate, universe
from panelloom.plans import cases
from panelloom.sources import panel, sinks

D = dt.date


def days(first: dt.date, n: int) -> list[dt.date]:
    return [first + dt.timedelta(i) for i in range(n)]


def bars(spark, closes: dict[str, list[float]], first=D(2021, 1, 1)):
    rows = [(d, k, float(c), float(c)) for k, v in closes.items() for d, c in zip(days(first, len(v)), v, strict=True)]
    return spark.createDataFrame(rows, "date date, index_code string, close double, vwap double")


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_selection_calendar(spark):
    cal = panel.calendar(spark.createDataFrame([(d,) for d in days(D(2020, 12, 1), 90)], "date date"))
    assert [r[0] for r in values(universe.selection_plans(cal, "daily", "2021-01-01"), "selection_date")] == days(D(2021, 1, 1), 59)
    monthly = universe.selection_plans(cal, "monthly", "2021-01-01")
    assert [r[0] for r in values(monthly, "selection_date")] == [D(2021, 1, 31), D(2021, 2, 28)]
    w = values(universe.turnover_windows(monthly, cal).where("selection_date = date'2021-02-28'"), "date")
    assert [x[0] for x in w] == days(D(2021, 2, 9), 20)
    with pytest.raises(ValueError):
        universe.selection_plans(cal, "weekly", "2021-01-01")


def test_return_panel_ends_on_the_selection_date(spark):
    closes = {"A": [100 + i for i in range(61)] + [1.0], "B": [200 + i for i in range(62)]}
    got = returns.return_panel(bars(spark, closes), "2021-03-02")
    rows = values(got, "index_code", "return_date", "daily_return")
    assert len(rows) == 120 and max(r[1] for r in rows) == D(2021, 3, 2)
    assert rows[0][2] == pytest.approx(0.01)


def test_common_dates_need_every_index(spark):
    b = bars(spark, {"A": [1, 2, 3], "B": [1, 2]})
    assert [r[0] for r in values(returns.common_dates(b), "date")] == days(D(2021, 1, 1), 2)
    assert values(returns.insufficient(b, 3), "index_code") == [("B",)]


def test_linkage_follows_the_threshold(spark):
    codes = spark.createDataFrame([("A",), ("B",), ("C",)], "index_code string")
    pairs = spark.createDataFrame([("A", "B", 0.2), ("A", "C", 0.9), ("B", "C", 0.9)], "code_a string, code_b string, dist double")
    got = values(cluster.complete_linkage(codes, pairs, (0.7, 0.9)), "corr_threshold", "index_code", "cluster_id")
    assert got == [(0.7, "A", 1), (0.7, "B", 1), (0.7, "C", 2), (0.9, "A", 1), (0.9, "B", 2), (0.9, "C", 3)]


def test_linkage_is_complete_not_single():
    import numpy as np

    d = np.array([[0, 0.1, 0.5], [0.1, 0, 0.2], [0.5, 0.2, 0]])
    assert cluster.linkage(["a", "b", "c"], d, 0.7) == {"a": 1, "b": 1, "c": 2}
    assert cluster.linkage([], np.zeros((0, 0)), 0.7) == {}


def test_representative_tie_goes_to_the_smaller_code(spark):
    clusters = spark.createDataFrame([("A", 1), ("B", 1)], "index_code string, cluster_id int")
    turnover = spark.createDataFrame([("A", "510002.SH", 100.0), ("B", "510001.SH", 100.0)], "index_code string, etf_code string, avg_turnover_20d double")
    pairs = spark.createDataFrame([("A", "B", 0.8)], "code_a string, code_b string, corr double")
    assert values(cluster.representatives(clusters, turnover), "etf_code", "cluster_size") == [("510001.SH", 2)]
    detail = values(cluster.cluster_detail(clusters, turnover, pairs, 0.7), "etf_code", "is_representative", "corr_to_representative", "min_corr_in_cluster", "dist_threshold")
    assert detail == [("510001.SH", True, 1.0, 0.8, 0.3), ("510002.SH", False, 0.8, 0.8, 0.3)]


def test_correlation_without_variance_is_null(spark):
    rows = [(D(2021, 1, i), c, x) for i, (a, b) in enumerate([(0.1, 0.0), (0.2, 0.0), (0.1, 0.0)], 1) for c, x in (("A", a), ("B", b))]
    got = cluster.correlation_pairs(spark.createDataFrame(rows, "return_date date, index_code string, daily_return double")).first()
    assert got.corr is None


def test_trend_windows_and_no_look_ahead(spark):
    price = [100 + 0.4 * i + 0.03 * (i % 5) ** 2 for i in range(70)]
    for future in ([], [1_000_000.0] * 5):
        t = factor.trend_windows(bars(spark, {"A": price + future})).where(F.col("date") == F.lit(D(2021, 1, 1) + dt.timedelta(69)))
        rows = {r.trend_window: r for r in t.collect()}
        assert rows[20].window_return == pytest.approx(0.06733333333333325)
        assert rows[20].log_price_slope == pytest.approx(0.0032851944908194)
        assert rows[60].r_squared == pytest.approx(0.9986232613025)
        assert rows[10].return_r2 == pytest.approx(0.0323884631824554)
        assert rows[40].window_start_close == pytest.approx(112.0)
        assert rows[15].window_volatility == pytest.approx(0.0018166678473059 * math.sqrt(14))
        for r in rows.values():
            assert r.return_vol == pytest.approx(r.window_return / r.window_volatility)
            assert r.return_r2 == pytest.approx(r.window_return * r.r_squared)


def test_active_pool_is_strictly_before(spark):
    dates = spark.createDataFrame([(D(2021, 1, 29),), (D(2021, 2, 1),), (D(2021, 2, 2),)], "date date")
    pools = spark.createDataFrame([(D(2021, 1, 29),), (D(2021, 2, 1),)], "selection_date date")
    assert sorted(tuple(r) for r in factor.active_pool(dates, pools).collect()) == [(D(2021, 1, 29), None), (D(2021, 2, 1), D(2021, 1, 29)), (D(2021, 2, 2), D(2021, 2, 1))]
    ends = factor.pool_ranges(pools).select("selection_date", F.coalesce("next_date", "selection_date"))
    assert sorted(tuple(r) for r in ends.collect()) == [(D(2021, 1, 29), D(2021, 2, 1)), (D(2021, 2, 1), D(2021, 2, 1))]


def test_filter_metrics(spark):
    m = select.filter_metrics(bars(spark, {"A": [100, 110, 105]}), (2,), (2,)).where("date = date'2021-01-03'").first()
    assert m.bias_2 == pytest.approx(-0.023255813953488413)
    assert m.vol_2 == pytest.approx(0.10285189544531603)
    m = select.filter_metrics(bars(spark, {"A": [100 + i for i in range(36)] + [1e6]}), (36,), (2,)).where("date = date'2021-02-05'").first()
    assert m.bias_36 == pytest.approx(0.14893617021276606)
    assert m.vol_2 == pytest.approx(3.9676062237e-05)
    assert values(select.missing_history(bars(spark, {"A": [1, 2]}), 2), "index_code") == [("A",)]


def test_filter_profiles(spark):
    closes = {
        "A": [95 if i % 2 == 0 else 105 for i in range(35)] + [150, 1_000_000],
        "B": [90 if i % 2 == 0 else 110 for i in range(35)] + [100, 1_000_000],
        "C": [100 + 0.01 * i for i in range(36)] + [1_000_000],
    }
    m = select.filter_metrics(bars(spark, closes, D(2021, 2, 24)))
    c = spark.createDataFrame([(D(2021, 3, 31), k, 1.0) for k in "ABC"], "date date, index_code string, score double")
    got = {p: [r[0] for r in values(select.filter_candidates(c, None if p == "base" else m, p).where("eligible"), "index_code")] for p in ("base", "bias_only", "volatility_only", "bias_and_volatility")}
    assert got == {"base": ["A", "B", "C"], "bias_only": ["B", "C"], "volatility_only": ["A", "B"], "bias_and_volatility": ["B"]}


def test_bias_upper_is_inclusive_with_tolerance(spark):
    df = spark.createDataFrame([(0.09,), (0.09 + 5e-13,), (0.10,), (None,)], "b double")
    assert [r[0] for r in df.select(select.passes_bias(F.col("b"))).collect()] == [True, True, False, False]


def test_volatility_rank_ties_and_share(spark):
    df = spark.createDataFrame([("d", c, v) for c, v in zip("ABC", (0.3, 0.2, 0.2), strict=True)], "date string, index_code string, v double")
    got = df.select("index_code", select.passes_volatility(F.col("v"), ["date"], 0.55).alias("ok"))
    assert values(got, "index_code", "ok") == [("A", True), ("B", True), ("C", False)]


def test_top_fraction_takes_one_at_least(spark):
    df = spark.createDataFrame([("d", "A", 2.0, 1.0, True), ("d", "B", 1.0, 2.0, True)], "date string, index_code string, return_r2 double, return_vol double, eligible boolean")
    assert values(select.top_fraction(df, "return_r2"), "index_code") == [("A",)]
    assert values(select.top_fraction(df, "return_vol"), "index_code") == [("B",)]
    assert select.top_fraction(df.withColumn("eligible", F.lit(False)), "return_r2").count() == 0


@pytest.mark.parametrize("d", range(1, 11))
def test_stagger_schedule(spark, d):
    cal = panel.calendar(spark.createDataFrame([(x,) for x in days(D(2021, 1, 1), 21)], "date date"))
    at = days(D(2021, 1, 1), 21)
    for mode, shift in (("close", 0), ("next_day_vwap", 1)):
        rows = values(simulate.stagger_schedule(cal, d, mode), "account_id", "date", "signal_date")
        for k in range(1, d + 1):
            assert [r[1] for r in rows if r[0] == k] == at[k - 1 + shift :: d]
        assert all(at.index(r[1]) - at.index(r[2]) == shift for r in rows)


def _two_signals():
    a, b, c = days(D(2021, 1, 1), 3)
    targets = {a: {"E1": 1.0}, b: {"E2": 1.0}}
    close = {a: {"E1": 100.0, "E2": 200.0}, b: {"E1": 100.0, "E2": 200.0}, c: {"E1": 100.0, "E2": 202.0}}
    vwap = {b: {"E1": 101.0, "E2": 202.0}, c: {"E1": 101.0, "E2": 202.0}}
    return (a, b, c), targets, close, vwap


def test_fill_models():
    (a, b, c), targets, close, vwap = _two_signals()
    path = stepwise.account_path([a, b, c], {b: a, c: b}, targets, close, vwap, 1.0, "next_day_vwap")
    assert path[0][1] == 1.0
    assert path[1][1] == pytest.approx(1 / 1.001 * 100 / 101)
    assert [p[3] for p in path] == [False, True, True]
    now = stepwise.account_path([a, b, c], {a: a, b: b, c: c}, targets, close, close, 1.0, "close")
    assert now[0][1] == pytest.approx(1 / 1.001)
    assert now[1][1] == pytest.approx(1 / 1.001 * 0.999 / 1.001)
    assert now[2][2] and not now[2][3] and now[2][1] == pytest.approx(now[1][1] * 1.01)


def test_without_price_a_holding_stays():
    (a, b, c), targets, close, vwap = _two_signals()
    del close[b]["E2"]
    path = stepwise.account_path([a, b, c], {a: a, b: b}, targets, close, close, 1.0, "close")
    assert path[1][6] == 0 or path[1][1] == pytest.approx(1 / 1.001, rel=1e-2)


def test_rebalance_costs_balance():
    import numpy as np

    new, cash, traded, cost = stepwise.rebalance(np.array([0.5, 0.5]), 0.0, np.array([0.2, 0.8]))
    assert float(new.sum()) + cash + cost == pytest.approx(1.0)
    assert new[1] / new[0] == pytest.approx(4.0)
    new, cash, traded, cost = stepwise.rebalance(np.zeros(1), 1.0, np.ones(1))
    assert float(new[0]) == pytest.approx(1 / 1.001)


def test_kernel_agrees_with_the_closed_form(spark):
    closes = {"A": [10, 11, 12, 11, 13, 12], "B": [20, 19, 22, 23, 21, 25]}
    b = bars(spark, closes)
    choice = spark.createDataFrame(list(zip(days(D(2021, 1, 1), 6), "AABBAB", strict=True)), "date date, index_code string")
    for mode in ("close", "next_day_vwap"):
        form = {r.date: r.nav for r in simulate.top_one_nav(choice, b, mode).collect()}
        weights = choice.select(F.col("date").alias("signal_date"), F.col("index_code").alias("etf_code"), F.lit(1.0).alias("weight"))
        accounts = simulate.run_accounts(panel.calendar(b), weights, b.withColumnRenamed("index_code", "etf_code"), 1, mode)
        for r in simulate.portfolio_nav(accounts).collect():
            assert r.nav == pytest.approx(form[r.date], rel=1e-9)


def test_accounts_start_with_equal_shares(spark):
    b = bars(spark, {"A": [1.0] * 5})
    none = spark.createDataFrame([], "signal_date date, etf_code string, weight double")
    rows = simulate.run_accounts(panel.calendar(b), none, b.withColumnRenamed("index_code", "etf_code"), 4, "close").collect()
    assert len(rows) == 20 and {r.account_nav for r in rows} == {0.25}
    assert sum(r.rebalance_attempted for r in rows) == 5


def test_performance(spark):
    navs = [1.0, 1.1, 0.99, 1.2]
    nav = spark.createDataFrame(list(zip(days(D(2021, 12, 30), 4), navs, strict=True)), "date date, nav double")
    p = metrics.performance(nav).first()
    r = [b / a - 1 for a, b in zip(navs, navs[1:], strict=False)]
    assert p.total_return == pytest.approx(0.2) and p.n_days == 4
    assert p.max_drawdown == pytest.approx(-0.1) and p.max_drawdown_date == D(2022, 1, 1)
    assert p.sharpe == pytest.approx(statistics.mean(r) / statistics.stdev(r) * math.sqrt(252))
    years = {x.year: x for x in metrics.annual_metrics(nav).collect()}
    assert years[2021].year_return == pytest.approx(0.1) and years[2022].year_return == pytest.approx(1.2 / 1.1 - 1)
    one = metrics.performance(nav.limit(1)).first()
    assert one.sharpe is None and one.annual_return is None


def test_csv_scan_reads_one_folder(spark, tmp_path):
    head = "日期,代码,名称,上市日期,对标指数,benchmark,管理人,托管人,类别大类,类别细类,对标指数代码,规模,成交量,成交额,收盘价,VWAP,溢价率"
    (tmp_path / "a.csv").write_text("﻿" + head + "\n2021-04-07,510001.SH,x,20200101,I,b,m,c,股票型ETF,,000001.CSI,1e9,,,1.5,1.5,NaN\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.csv").write_text(head + "\n", encoding="utf-8")
    rows = panel.scan_csv(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    assert rows[0].date == D(2021, 4, 7) and rows[0].listing_date == D(2020, 1, 1)
    assert rows[0].volume is None and rows[0].premium_pct is None and rows[0].subcategory is None


@pytest.mark.parametrize("header", ["月末交易日", "筛选日期"])
def test_both_selection_date_headers(spark, tmp_path, header):
    (tmp_path / "a.csv").write_text(f"{header},收益日期,对标指数代码,日收益率\n2021-01-29,2021-01-28,X,0.5\n", encoding="utf-8")
    r = panel.scan_csv(spark, str(tmp_path), panel.PANEL_COLUMNS).first()
    assert r.selection_date == D(2021, 1, 29) and r.daily_return == 0.5


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(D(2021, 1, 1), 1.0), (D(2022, 1, 1), 2.0)], "date date, x double")
    path = str(tmp_path / "t")
    assert sinks.write_years(df, path, range(2021, 2024)) == [2023]
    sinks.write_years(df.where("x = 2").withColumn("x", F.lit(3.0)), path, [2022])
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1.0, 3.0]
    assert sinks.remove_partitions(spark, path, "year", ["2022"]) == 1
    assert [r.x for r in spark.read.parquet(path).collect()] == [3.0]


def test_completeness(spark):
    expected = spark.createDataFrame([(D(2021, 1, 3), "A"), (D(2021, 1, 3), "B"), (D(2021, 2, 3), "A")], "selection_date date, index_code string")
    rows = [(D(2021, 1, 3), "A", D(2021, 1, 2)), (D(2021, 1, 3), "A", D(2021, 1, 3)), (D(2021, 1, 3), "B", D(2021, 1, 2)), (D(2021, 1, 3), "B", D(2021, 1, 4)), (D(2021, 2, 3), "A", D(2021, 2, 2)), (D(2021, 2, 3), "A", D(2021, 2, 3))]
    got = sinks.panel_complete(spark.createDataFrame(rows, "selection_date date, index_code string, return_date date"), expected, 2)
    assert values(got, "selection_date", "complete") == [(D(2021, 1, 3), False), (D(2021, 2, 3), True)]


def test_stream_of_events_gives_the_batch_bars(spark, tmp_path, sf_dir):
    from panelloom.streaming.bars import daily_event_bars

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = daily_event_bars(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "60 days")
    q = stream.writeStream.format("memory").queryName("bars").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert values(spark.table("bars"), "date", "event_type", "n_events") == values(daily_event_bars(events), "date", "event_type", "n_events")


def test_linkage_takes_configured_thresholds_only(spark):
    codes = spark.createDataFrame([("A",)], "index_code string")
    pairs = spark.createDataFrame([], "code_a string, code_b string, dist double")
    with pytest.raises(ValueError, match="correlation_threshold"):
        cluster.complete_linkage(codes, pairs, (0.75,))


def test_periods_a_year_and_drawdown_start(spark):
    nav = spark.createDataFrame([(D(2021, m, 1), x) for m, x in enumerate([1.0, 1.2, 1.2, 0.9, 1.0, 1.1, 1.3, 1.2, 1.3, 1.4, 1.4, 1.5], 1)] + [(D(2022, 1, 1), 2.0)], "date date, nav double")
    p = metrics.performance(nav, periods=12).first()
    assert p.annual_return == pytest.approx(1.0) and p.max_drawdown == pytest.approx(-0.25)
    assert (p.max_drawdown_start, p.max_drawdown_date) == (D(2021, 2, 1), D(2021, 4, 1))


def test_factor_labels(spark):
    df = spark.createDataFrame([("return_r2",), ("return_vol",)], "m string")
    assert len({r[0] for r in df.select(scalars.factor_label(df["m"])).collect()}) == 2
    with pytest.raises(Exception, match="unknown factor"):
        spark.createDataFrame([("other",)], "m string").select(scalars.factor_label(F.col("m"))).collect()


def test_grid_choices_against_every_cell(spark):
    """Full axes on a small panel: each cell's choice by trying all candidates."""
    dice = random.Random(9)
    rows = [(D(2021, 1, d), f"I{i}", round(dice.random(), 1), round(dice.random() - 0.5, 2), round(dice.random(), 1)) for d in range(1, 6) for i in range(12)]
    cand = spark.createDataFrame([(d, c, "m", s) for d, c, s, *_ in rows], "date date, index_code string, method string, score double")
    made = spark.createDataFrame([(d, c, b, v) for d, c, _, b, v in rows], "date date, index_code string, bias_6 double, vol_6 double")
    uppers, shares = [x / 50 for x in range(-10, 16)], [x / 20 for x in range(1, 21)]
    best = lambda some: min(some, key=lambda r: (-r[2], r[1]))[1]
    want_b, want_v = {}, {}
    for d in {r[0] for r in rows}:
        day = [r for r in rows if r[0] == d]
        for u in uppers:
            if some := [r for r in day if r[3] <= u + 1e-12]:
                want_b[d, u] = best(some)
        for s in shares:
            want_v[d, s] = best(sorted(day, key=lambda r: (-r[4], r[1]))[: max(1, math.ceil(12 * s - 1e-12))])
    got_b = {(r.date, r.level): r.index_code for r in grid.bias_choices(cand, made, [6], uppers).collect()}
    got_v = {(r.date, r.level): r.index_code for r in grid.volatility_choices(cand, made, [6], shares).collect()}
    assert got_b == want_b and got_v == want_v


def test_clusters_of_each_snapshot(spark):
    """Two pools of one panel: each sees its own past only."""
    dates = [D(2021, 1, i) for i in range(1, 11)]
    up = [1.0, 1.1, 1.0, 1.1, 1.0]
    closes = {"A": [*up, 1.0, 1.1, 1.0, 1.1, 1.0], "B": [*(2 * x for x in up), 2.0, 1.8, 2.0, 1.8, 2.0], "C": [3.0, 2.9, 3.1, 2.8, 3.3, 3.0, 3.3, 3.0, 3.3, 3.0]}
    rows = [(c, d, x) for c, xs in closes.items() for d, x in zip(dates, xs, strict=True)]
    panel_bars = spark.createDataFrame(rows, "index_code string, date date, close double")
    pools = spark.createDataFrame([(D(2021, 1, d), c, f"E{c}", t) for d in (5, 10) for c, t in (("A", 1.0), ("B", 2.0), ("C", 3.0))], "selection_date date, index_code string, etf_code string, avg_turnover_20d double")
    p = cases.Panels(None, pools, panel_bars, None, None, closes=5)
    found = cases.snapshot_clusters(p, 0.9)
    groups = {}
    for r in found.collect():
        groups.setdefault((r.selection_date, r.cluster_id), set()).add(r.index_code)
    assert sorted(map(sorted, (g for (d, _), g in groups.items() if d == D(2021, 1, 5)))) == [["A", "B"], ["C"]]
    assert sorted(map(sorted, (g for (d, _), g in groups.items() if d == D(2021, 1, 10)))) == [["A", "C"], ["B"]]
    assert {(r.selection_date.day, r.index_code) for r in cases.case_pools(found).collect()} == {(5, "B"), (5, "C"), (10, "C"), (10, "B")}


def test_asof_prices_and_staleness(spark):
    panel_bars = spark.createDataFrame([("A", D(2021, 1, 1), 1.0), ("A", D(2021, 1, 5), 2.0), ("A", D(2021, 1, 6), None), ("B", D(2021, 2, 1), 3.0)], "index_code string, date date, close double")
    signals = spark.createDataFrame([("A", D(2021, 1, 4)), ("A", D(2021, 1, 6)), ("A", D(2021, 1, 12)), ("A", D(2021, 1, 13)), ("B", D(2021, 1, 31)), ("C", D(2021, 1, 1))], "index_code string, date date")
    got = {(r.index_code, r.date.day): (r.close, r.is_fresh) for r in select.asof_prices(signals, panel_bars).collect()}
    assert got == {("A", 4): (1.0, True), ("A", 6): (2.0, True), ("A", 12): (2.0, True), ("A", 13): (2.0, False), ("B", 31): (None, False), ("C", 1): (None, False)}


def test_missing_history_is_an_error(spark):
    two = bars(spark, {"A": [1.0, 2.0], "B": [1.0, 2.0, 3.0]})
    select.require_history(two, 1)
    with pytest.raises(ValueError, match="A"):
        select.require_history(two, 2)


def test_trades_are_dealt_out_in_parts_of_one_size(spark, sf_dir, monkeypatch):
    """However many trades there are, a task adds up about so many, and no file split is grouped as a whole before."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    monkeypatch.setattr(panel, "TASK_TRADES", 100)
    parts = -(-line.count() // 100)
    assert panel.trades(spark, sf_dir).rdd.getNumPartitions() == max(parts, spark.sparkContext.defaultParallelism)
    bars = panel.etf_bars(spark, sf_dir)
    plan = bars._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression")
    got = {(r.date, r.etf_code): (r.volume, round(r.close, 9)) for r in bars.collect()}
    plain = line.groupBy(F.to_date("l_shipdate").alias("date"), "l_partkey").agg(F.sum("l_quantity").alias("v"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("c"))
    assert got == {(r.date, r.l_partkey): (r.v, round(r.c, 9)) for r in plain.collect()}

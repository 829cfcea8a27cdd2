"""Accounts of many cases against one account day by day, golden trades, exact rebalancing."""

import datetime as dt
import random

import numpy as np
import pytest
import stepwise
from pyspark.sql import functions as F

from panelloom.operators import accounts
from panelloom.sources import panel

D = dt.date
CASES = "case_id string, stagger_days int, execution_mode string"
TARGETS = "case_id string, signal_date date, etf_code string, weight double"
PRICES = "date date, etf_code string, close double, vwap double"


def test_exact_value_after_costs():
    dice = np.random.default_rng(11)
    for _ in range(3000):
        n = int(dice.integers(1, 12))
        value = dice.random(n) * (dice.random(n) < 0.7)
        weight = dice.random(n) * (dice.random(n) < 0.7)
        weight /= max(1.0, weight.sum())
        cash, rate = float(dice.random() * (dice.random() < 0.7)), float(dice.choice([0.0, 0.001, 0.05, 0.3]))
        if cash + value.sum() == 0:
            continue
        after = accounts.solve_after(value, cash, weight, rate)
        new, left, traded, cost = stepwise.rebalance(value, cash, weight, rate)
        assert after == pytest.approx(float(new.sum()) + left, abs=1e-12)
        assert after + rate * np.abs(weight * after - value).sum() == pytest.approx(cash + value.sum(), abs=1e-12)


def test_ties_and_edges_of_rebalancing():
    solve = accounts.solve_after
    assert solve(np.array([0.5, 0.5]), 0.0, np.array([0.5, 0.5])) == 1.0  # all at the target
    assert solve(np.zeros(1), 1.0, np.ones(1)) == pytest.approx(1 / 1.001, abs=1e-15)
    assert solve(np.array([1.0]), 0.0, np.zeros(1)) == pytest.approx(0.999, abs=1e-15)
    assert solve(np.array([1.0, 0.0]), 0.0, np.array([0.0, 1.0])) == pytest.approx(0.999 / 1.001, abs=1e-15)


def test_many_cases_at_once(spark):
    """Random prices with gaps, targets on some days; every account equals its own path day by day."""
    dice = random.Random(2)
    dates = [D(2021, 1, 1) + dt.timedelta(i) for i in range(60)]
    codes = ["A", "B", "C", "D", "E"]
    prices = [(d, c, round(dice.uniform(5, 50), 3), round(dice.uniform(5, 50), 3)) for d in dates for c in codes if dice.random() < 0.8]
    cases = [("one", 1, "close"), ("two", 3, "close"), ("three", 4, "next_day_vwap"), ("four", 10, "next_day_vwap"), ("none", 2, "close")]
    targets = []
    for name, _, _ in cases[:-1]:
        for d in dates:
            if dice.random() < 0.9:
                chosen = dice.sample(codes, dice.randint(1, 4))
                raw = [dice.random() for _ in chosen]
                targets += [(name, d, c, w / sum(raw)) for c, w in zip(chosen, raw, strict=True)]
    cal = panel.calendar(spark.createDataFrame([(d,) for d in dates], "date date"))
    rows = accounts.run_portfolios(cal, spark.createDataFrame(cases, CASES), spark.createDataFrame(targets, TARGETS), spark.createDataFrame(prices, PRICES)).cache()
    got = {(r.case_id, r.account_id, r.date): r for r in accounts.account_days(rows).collect()}
    assert len(got) == 60 * sum(c[1] for c in cases)
    close = {d: {c: x for e, c, x, _ in prices if e == d} for d in dates}
    vwap = {d: {c: v for e, c, _, v in prices if e == d} for d in dates}
    for name, days, mode in cases:
        goals = {}
        for n, d, c, w in targets:
            if n == name:
                goals.setdefault(d, {})[c] = w
        for k in range(1, days + 1):
            shift = 0 if mode == "close" else 1
            acts = {dates[i]: dates[i - shift] for i in range(k - 1 + shift, 60, days)}
            for day, nav, tried, done, traded, cost, held in stepwise.account_path(dates, acts, goals, close, close if mode == "close" else vwap, 1 / days, mode):
                r = got[name, k, day]
                assert (r.rebalance_attempted, r.rebalanced, r.n_holdings) == (tried, done, held), (name, k, day)
                assert (r.account_nav, r.turnover, r.cost) == pytest.approx((nav, traded, cost), rel=1e-11, abs=1e-13)
    # the trades of a day add up to its turnover and costs
    sums = accounts.trade_records(rows).groupBy("case_id", "account_id", F.col("execution_date").alias("date")).agg(F.sum("amount").alias("t"), F.sum("trade_cost").alias("c")).collect()
    assert sums and all((got[r.case_id, r.account_id, r.date].turnover, got[r.case_id, r.account_id, r.date].cost) == pytest.approx((r.t, r.c), rel=1e-9, abs=1e-12) for r in sums)
    day = accounts.portfolio_days(rows).where("case_id = 'two'").orderBy("date").first()
    assert day.nav < 1.0 and day.n_rebalanced == 1


def test_golden_trades(spark):
    """Signals on the first two of three days: both fill models buy on their own days; the second day's value is known."""
    a, b, c = D(2021, 1, 4), D(2021, 1, 5), D(2021, 1, 6)
    cal = panel.calendar(spark.createDataFrame([(a,), (b,), (c,)], "date date"))
    prices = [(d, e, x, v) for d in (a, b, c) for e, x, v in (("ETF1", 100.0, 101.0), ("ETF2", 200.0, 202.0))]
    targets = [(case, d, e, 1.0) for case in ("close", "next_day_vwap") for d, e in ((a, "ETF1"), (b, "ETF2"))]
    cases = [("close", 1, "close"), ("next_day_vwap", 1, "next_day_vwap")]
    rows = accounts.run_portfolios(cal, spark.createDataFrame(cases, CASES), spark.createDataFrame(targets, TARGETS), spark.createDataFrame(prices, PRICES))
    trades = accounts.trade_records(rows).collect()
    buys = lambda case: sorted((t.execution_date, t.signal_date, t.etf_code) for t in trades if t.case_id == case and t.direction == "买入")
    assert buys("close") == [(a, a, "ETF1"), (b, b, "ETF2")]
    assert buys("next_day_vwap") == [(b, a, "ETF1"), (c, b, "ETF2")]
    assert sorted((t.execution_date, t.etf_code) for t in trades if t.direction == "卖出") == [(b, "ETF1"), (c, "ETF1")]
    nav = {(r.case_id, r.date): r.nav for r in accounts.portfolio_days(rows).collect()}
    assert nav["next_day_vwap", b] == pytest.approx(1 / 1.001 * 100 / 101, abs=1e-12)


def test_cases_are_checked():
    accounts.check_cases([("a", 1, "close"), ("b", 10, "next_day_vwap")])
    for bad in ([("a", 1, "close"), ("a", 2, "close")], [("a", 11, "close")], [("a", 1, "open")]):
        with pytest.raises(ValueError):
            accounts.check_cases(bad)

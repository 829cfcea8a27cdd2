"""Accounts of many cases at once: exact rebalancing, account days and trades.

A case is a set of dated target weights that ``stagger_days`` accounts follow in turn.
Accounts never meet, so (case, account) is a group, and all cases run as one job. A
group's prices become two arrays, days by instruments, which the recursion over its
rebalancing days reads; the days in between are one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.config import COST_RATE, EXECUTION_MODES, STAGGER_DAYS

#: Directions of a trade (fixed values of the reports).
BUY, SELL = "买入", "卖出"
#: A position of a smaller share of its account is what rounding left and counts as none.
DUST = 1e-9
#: Nor is what rounding left in cash traded, where all else cannot be: a part of the account up to this.
IDLE = 1e-12
DAY_COLUMNS = "date date, account_nav double, rebalance_attempted boolean, rebalanced boolean, turnover double, cost double, n_holdings int"
TRADE_COLUMNS = "execution_date date, signal_date date, etf_code string, direction string, price double, amount double, trade_cost double"


def solve_after(value: np.ndarray, cash: float, weight: np.ndarray, rate: float = COST_RATE) -> float:
    """What is left, V', after trading positions to weight x V': V' = V - rate x sum |weight V' - value|.

    V' plus the costs rises in V' and is linear between the points value / weight, where
    an instrument turns from a sale into a purchase. Sorted, with running sums, they
    give the cost at each of them; V' lies on the one piece where the sum meets V."""
    total = cash + float(value.sum())
    bought = weight > 0
    p, w = value[bought], weight[bought]
    out = float(value[~bought].sum())
    order = np.argsort(p / w, kind="stable")
    p, w = p[order], w[order]
    point = p / w
    below_p, below_w = np.concatenate([[0.0], np.cumsum(p)]), np.concatenate([[0.0], np.cumsum(w)])
    all_p, all_w = below_p[-1], below_w[-1]
    # cost at V' with the first k points below it: rate (V'(2 W_k - W) + P - 2 P_k + out)
    at_points = point + rate * (point * (2 * below_w[1:] - all_w) + all_p - 2 * below_p[1:] + out)
    k = int(np.searchsorted(at_points, total, side="left"))
    return (total - rate * (all_p - 2 * below_p[k] + out)) / (1 + rate * (2 * below_w[k] - all_w))


def follow(days: int, acts: list[tuple[int, np.ndarray | None]], close: np.ndarray, fill: np.ndarray, start: float, rate: float = COST_RATE) -> Iterator[tuple[int, int, np.ndarray, float, tuple | None]]:
    """Stretches (first day, end, units, cash, trade) of equal holdings of one account.

    ``acts``: days of rebalancing in order, with the target weights by instrument, or
    None without a target; ``close``: last known closes by day and instrument, NaN before the
    first; ``fill``: fill prices, NaN where there is none that day. ``trade``: (values
    before, values after, prices, which were able, cost), None where nothing was traded.

    An instrument without a fill price is not traded that day: a held one keeps its
    value, a wanted one is left out and its weight stays cash."""
    units, cash = np.zeros(close.shape[1]), start
    if not acts or acts[0][0] > 0:
        yield 0, acts[0][0] if acts else days, units, cash, None
    for k, (day, weight) in enumerate(acts):
        trade = None
        if weight is not None and weight.any():
            price = fill[day]
            able = (price > 0) & ((units > 0) | (weight > 0))
            if able.any():
                value = units[able] * price[able]
                idle = (units > 0) & ~able
                frozen = float((units[idle] * close[day, idle]).sum())
                part = cash + float(value.sum())
                if part > IDLE * (part + frozen):
                    # weights are of the whole account, of which what is frozen cannot be traded
                    goal = weight[able] * ((part + frozen) / part)
                    goal /= max(1.0, float(goal.sum()))
                    after = solve_after(value, cash, goal, rate)
                    wanted = goal * after
                    units = units.copy()
                    units[able] = wanted / price[able]
                    cash = after - float(wanted.sum())
                    trade = (value, wanted, price[able], able, rate * float(np.abs(wanted - value).sum()))
        yield day, acts[k + 1][0] if k + 1 < len(acts) else days, units, cash, trade


def _arrays(group: pd.DataFrame) -> tuple[np.ndarray, list, list, np.ndarray, np.ndarray]:
    """(dates, codes, acts, closes carried on, fill prices) of one group's rows."""
    kind = group.kind.to_numpy()
    plain = group[kind == 0].sort_values("date")
    dates = plain.date.to_numpy()
    at = {d: i for i, d in enumerate(dates)}
    priced = group[kind == 2]
    wanted = group[kind == 1]
    codes = sorted(set(priced.etf_code) | set(wanted.etf_code.dropna()))
    column = {c: i for i, c in enumerate(codes)}
    shape = (len(dates), len(codes))
    close, fill = np.full(shape, np.nan), np.full(shape, np.nan)
    rows, columns = priced.date.map(at).to_numpy(), priced.etf_code.map(column).to_numpy()
    known = ~pd.isna(rows)
    rows, columns = rows[known].astype(np.int64), columns[known].astype(np.int64)
    close[rows, columns] = priced.close.to_numpy(float)[known]
    fill[rows, columns] = priced.fill.to_numpy(float)[known]
    if len(codes):  # what was bought before its first close is worth what was paid
        close = pd.DataFrame(np.where(np.isnan(close), fill, close)).ffill().to_numpy()
    targets: dict[int, np.ndarray] = {}
    for d, c, w in zip(wanted.date.map(at), wanted.etf_code, wanted.weight, strict=True):
        if c is not None and w == w:
            targets.setdefault(int(d), np.zeros(len(codes)))[column[c]] = w
    acts = [(int(i), targets.get(int(i))) for i in np.flatnonzero(plain.acts.to_numpy(bool))]
    return dates, codes, acts, close, fill


def _run(days_only: bool, rate: float):
    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        case_id, account_id, stagger = keys
        dates, codes, acts, close, fill = _arrays(group)
        signals = dict(zip(group.date[group.kind == 0], group.signal_date[group.kind == 0], strict=True))
        attempted = {d for d, _ in acts}
        worth = np.where(np.isnan(close), 0.0, close)
        nav, done, turnover, cost, held = (np.zeros(len(dates)) for _ in range(5))
        trades = []
        for first, end, units, cash, trade in follow(len(dates), acts, close, fill, 1.0 / stagger, rate):
            nav[first:end] = worth[first:end] @ units + cash
            held[first:end] = np.count_nonzero(worth[first:end] * units > DUST * nav[first:end, None], axis=1)
            if trade is not None:
                value, wanted, price, able, paid = trade
                done[first], turnover[first], cost[first] = 1, float(np.abs(wanted - value).sum()), paid
                if not days_only:
                    for j, was, now, p in zip(np.flatnonzero(able).tolist(), value, wanted, price, strict=True):
                        if abs(now - was) > 1e-15:
                            trades.append((dates[first], signals[dates[first]], codes[j], BUY if now > was else SELL, p, abs(now - was), rate * abs(now - was)))
        base = pd.DataFrame({"kind": "day", "date": dates, "account_nav": nav, "rebalance_attempted": [i in attempted for i in range(len(dates))], "rebalanced": done.astype(bool), "turnover": turnover, "cost": cost, "n_holdings": held.astype(int)})
        if trades:
            more = pd.DataFrame(trades, columns=["execution_date", "signal_date", "etf_code", "direction", "price", "amount", "trade_cost"])
            more.insert(0, "kind", "trade")
            base = pd.concat([base, more], ignore_index=True)
        base.insert(0, "account_id", account_id)
        base.insert(0, "case_id", case_id)
        base = base.reindex(columns=_COLUMNS)
        for c in ("date", "execution_date", "signal_date", "etf_code", "direction"):
            base[c] = base[c].astype(object).where(base[c].notna(), None)
        return base

    return run


_COLUMNS = ["case_id", "account_id", "kind", *[x.split()[0] for x in f"{DAY_COLUMNS}, {TRADE_COLUMNS}".split(", ")]]


def schedules(calendar: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, account_id, stagger_days, execution_mode, date, signal_date, acts) of every account and day of cases(case_id, stagger_days, execution_mode).

    Account k of d acts first on position k - 1 (close) or k (next_day_vwap, on the
    signal of the day before), then every d days."""
    days = calendar.select("date", "pos", F.lag("date").over(Window.orderBy("date")).alias("before"))  # one row a day
    shift = F.when(F.col("execution_mode") == "close", 0).otherwise(1)
    accounts = cases.withColumn("account_id", F.explode(F.sequence(F.lit(1), F.col("stagger_days"))))
    slot = F.col("pos") - 1 - shift
    every = accounts.join(F.broadcast(days))  # the calendar: some thousand days, whatever the trades
    acts = (slot >= 0) & (F.pmod(slot, F.col("stagger_days")) + 1 == F.col("account_id"))
    signal = F.when(acts, F.when(F.col("execution_mode") == "close", F.col("date")).otherwise(F.col("before")))
    return every.select("case_id", "account_id", "stagger_days", "execution_mode", "date", signal.alias("signal_date"), F.coalesce(acts, F.lit(False)).alias("acts"))


def run_portfolios(calendar: DataFrame, cases: DataFrame, targets: DataFrame, prices: DataFrame, trades: bool = True, rate: float = COST_RATE) -> DataFrame:
    """Rows of two kinds, day and trade, of every account of every case.

    cases: (case_id, stagger_days, execution_mode); targets: (case_id, signal_date,
    etf_code, weight); prices: (date, etf_code, close, vwap). Orders are filled at the
    close of the signal's day or at the average price of the day after. Only prices
    of instruments that a case may hold go to its groups; without a target the
    holdings stay. An instrument's code is carried as text."""
    plan = schedules(calendar, cases)
    wanted = plan.where("acts").select("case_id", "account_id", "stagger_days", "signal_date", "date").join(targets.select("case_id", "signal_date", F.col("etf_code").cast("string").alias("etf_code"), "weight"), ["case_id", "signal_date"])
    codes = wanted.join(cases.select("case_id", "execution_mode"), "case_id").select("case_id", "account_id", "stagger_days", "execution_mode", "etf_code").distinct()
    fill = F.when(F.col("execution_mode") == "close", F.col("close")).otherwise(F.col("vwap"))
    priced = codes.join(prices.select("date", F.col("etf_code").cast("string").alias("etf_code"), F.col("close").cast("double").alias("close"), F.col("vwap").cast("double").alias("vwap")), "etf_code").withColumn("fill", fill)
    keys = ["case_id", "account_id", "stagger_days"]
    shape = {"kind": "int", "date": "date", "signal_date": "date", "acts": "boolean", "etf_code": "string", "weight": "double", "close": "double", "fill": "double"}

    def rows(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*keys, *[F.lit(kind).alias("kind") if c == "kind" else (F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c)) for c, t in shape.items()])

    parts = rows(plan, 0).unionByName(rows(wanted.select(*keys, "date", "etf_code", "weight"), 1)).unionByName(rows(priced.select(*keys, "date", "etf_code", "close", "fill"), 2))
    kind = dict(cases.dtypes)["case_id"]
    return parts.groupBy(*keys).applyInPandas(_run(not trades, rate), f"case_id {kind}, account_id int, kind string, {DAY_COLUMNS}, {TRADE_COLUMNS}")


def account_days(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'day'").select("case_id", "account_id", *[x.split()[0] for x in DAY_COLUMNS.split(", ")])


def trade_records(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'trade'").select("case_id", "account_id", *[x.split()[0] for x in TRADE_COLUMNS.split(", ")])


def portfolio_days(rows: DataFrame) -> DataFrame:
    """(case_id, date, nav, turnover, cost, n_holdings, n_rebalanced): sums over the accounts of a case."""
    return account_days(rows).groupBy("case_id", "date").agg(F.sum("account_nav").alias("nav"), F.sum("turnover").alias("turnover"), F.sum("cost").alias("cost"), F.sum("n_holdings").alias("n_holdings"), F.count_if("rebalanced").alias("n_rebalanced"))


def check_cases(cases: list[tuple[str, int, str]]) -> None:
    """ValueError for a repeated case or a value outside its dimension."""
    if len({c for c, _, _ in cases}) != len(cases):
        raise ValueError("repeated cases")
    for name, days, mode in cases:
        if days not in STAGGER_DAYS or mode not in EXECUTION_MODES:
            raise ValueError(f"case {name}: no such stagger or mode: {days}, {mode}")

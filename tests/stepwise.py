"""One account day by day, with the value after costs found by halving: what the accounts of the library are held against."""

import numpy as np

from panelloom.config import COST_RATE


def rebalance(value: np.ndarray, cash: float, weight: np.ndarray, rate: float = COST_RATE) -> tuple[np.ndarray, float, float, float]:
    """(positions, cash, traded, cost) after trading the differences to the target.

    What is left after costs, V', solves V' = V - rate x sum |w V' - position|; the
    right side falls in V' no faster than rate, so halving finds it."""
    total = cash + float(value.sum())
    low, high = 0.0, total
    for _ in range(200):
        mid = (low + high) / 2
        if mid + rate * float(np.abs(weight * mid - value).sum()) > total:
            high = mid
        else:
            low = mid
        if high - low <= 1e-16 * max(1.0, total):
            break
    after = (low + high) / 2
    wanted = weight * after
    traded = float(np.abs(wanted - value).sum())
    return wanted, after - float(wanted.sum()), traded, rate * traded


def account_path(dates: list, acts: dict, targets: dict, close: dict, fill: dict, start: float, mode: str, rate: float = COST_RATE) -> list[tuple]:
    """Days of one account: (date, nav, attempted, rebalanced, turnover, cost, holdings).

    ``acts``: date to signal date; ``targets``: signal date to {code: weight};
    ``close`` and ``fill``: date to {code: price}. Without a target the holdings
    stay. An instrument without a fill price is not traded that day: a held one
    keeps its value, a wanted one is left out, its weight stays cash."""
    codes: list = []
    units = np.zeros(0)
    cash, last, out = start, {}, []
    for day in dates:
        attempted = day in acts
        traded = cost = 0.0
        target = targets.get(acts.get(day)) if attempted else None
        done = False
        if target:
            prices = fill.get(day, {})
            names = [*codes, *sorted(c for c in target if c not in codes and prices.get(c))]
            held = {c: u for c, u in zip(codes, units, strict=True)}
            value, weight, frozen, price = [], [], 0.0, []
            move = [c for c in names if prices.get(c)]
            for c in codes:
                if not prices.get(c):
                    frozen += held[c] * last[c]
            for c in move:
                price.append(prices[c])
                value.append(held.get(c, 0.0) * prices[c])
                weight.append(target.get(c, 0.0))
            if move and cash + sum(value) > 1e-12 * (cash + sum(value) + frozen):
                # weights are of the whole account, of which what is frozen cannot be traded
                part = cash + sum(value)
                goal = np.array(weight) * ((part + frozen) / part if part else 0.0)
                goal /= max(1.0, float(goal.sum()))
                new, cash, traded, cost = rebalance(np.array(value), cash, goal, rate)
                units_now = {c: v / p for c, v, p in zip(move, new, price, strict=True)}
                keep = {c: held[c] for c in codes if not prices.get(c)} | {c: u for c, u in units_now.items() if u > 0}
                codes = sorted(keep)
                units = np.array([keep[c] for c in codes])
                for c, p in zip(move, price, strict=True):
                    last[c] = p
                done = True
        for c in codes:
            last[c] = close.get(day, {}).get(c) or last[c]
        nav = cash + float(sum(u * last[c] for c, u in zip(codes, units, strict=True)))
        out.append((day, nav, attempted, done, traded, cost, len(codes)))
    return out

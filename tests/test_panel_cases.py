"""Window metrics by running sums, grids of sets, shared dates as bits, linkage, unions of files, cases written and taken up again."""

import datetime as dt
import math
import random
import statistics
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom import config
from panelloom.operators import accounts, cluster, factor, grid, select
from panelloom.plans import cases
from panelloom.sources import panel, sinks

D = dt.date
BARS = "date date, index_code string, close double, vwap double"


def days(n, first=D(2021, 1, 1)):
    return [first + dt.timedelta(i) for i in range(n)]


def noise(seed, codes, n, gap=0.0, low=50.0, high=150.0):
    dice = random.Random(seed)
    return [(d, c, dice.uniform(low, high), dice.uniform(low, high)) for d in days(n) for c in codes if dice.random() >= gap]


def test_metrics_of_all_windows_against_frames(spark):
    """59 windows each, within 1e-9 of sums over the window itself; also long levels, flat and steadily rising series."""
    rows = noise(1, ["A", "B"], 130)
    rows += [(d, "FLAT", 7.0, 7.0) for d in days(130)] + [(d, "UP", 1.01**i, 1.0) for i, d in enumerate(days(130))]
    rows += [(d, "BIG", 1e7 + i % 3, 1.0) for i, d in enumerate(days(130))] + [(d, "NULL", None if i % 40 == 7 else 5.0 + i % 4, 1.0) for i, d in enumerate(days(130))]
    got = {(r.index_code, r.date): r for r in select.filter_metrics(spark.createDataFrame(rows, BARS), config.BIAS_WINDOWS, config.VOL_WINDOWS).collect()}
    for code in ("A", "B", "FLAT", "UP", "BIG", "NULL"):
        series = [(d, x) for d, c, x, _ in rows if c == code]
        closes = [x for _, x in series]
        rets = [None if i == 0 or None in (closes[i], closes[i - 1]) else closes[i] / closes[i - 1] - 1 for i in range(len(closes))]
        for i in (0, 1, 5, 30, 59, 60, 61, 100, 129):
            r = got[code, series[i][0]]
            for n in (2, 3, 10, 31, 59, 60):
                part, back = closes[max(0, i - n + 1) : i + 1], rets[max(0, i - n + 1) : i + 1]
                if len(part) < n or None in part:
                    assert r[f"bias_{n}"] is None
                else:
                    assert r[f"bias_{n}"] == pytest.approx(closes[i] / statistics.fmean(part) - 1, abs=1e-9)
                if len(back) < n or None in back:
                    assert r[f"vol_{n}"] is None
                else:
                    assert r[f"vol_{n}"] == pytest.approx(statistics.stdev(back), abs=1e-9)


@pytest.mark.parametrize("mode,stagger", [("close", 1), ("close", 4), ("next_day_vwap", 3), ("next_day_vwap", 10)])
def test_grid_of_sets_against_accounts(spark, mode, stagger):
    """Every cell of small axes equals the accounts that trade its targets day by day (prices without gaps)."""
    codes = [f"I{i:02}" for i in range(12)]
    bars = spark.createDataFrame(noise(3, codes, 70, low=90, high=110), BARS)
    dice = random.Random(4)
    scores = [(d, c, "return_r2", dice.random()) for d in days(70) for c in codes if dice.random() < 0.9]
    candidates = spark.createDataFrame(scores, "date date, index_code string, method string, score double")
    cal = panel.calendar(bars)
    for kind, windows, levels in (("bias", (3, 8), (-0.01, 0.0, 0.05)), ("vol", (4, 9), (0.3, 1.0))):
        m = select.filter_metrics(bars, windows if kind == "bias" else (), windows if kind == "vol" else ())
        sets = (grid.bias_sets if kind == "bias" else grid.volatility_sets)(candidates, m, windows, levels, 0.25).cache()
        got = {(r.window, r.level): r for r in grid.staggered_returns(sets, cal, bars, ["method", "window", "level"], stagger, mode).collect()}
        named = sets.withColumn("case_id", F.concat_ws("/", "window", "level"))
        plan = spark.createDataFrame([(f"{w}/{u}", stagger, mode) for w in windows for u in levels], "case_id string, stagger_days int, execution_mode string")
        targets = named.select("case_id", F.col("date").alias("signal_date"), F.explode("codes").alias("etf_code"), (1 / F.size("codes")).alias("weight"))
        rows = accounts.run_portfolios(cal, plan, targets, bars.withColumnRenamed("index_code", "etf_code"), trades=False)
        last = accounts.portfolio_days(rows).where(F.col("date") == days(70)[-1]).collect()
        assert len(last) == len(windows) * len(levels)
        for r in last:
            w, u = r.case_id.split("/")
            cell = got.get((int(w), float(u)))
            assert (0.0 if cell is None else cell.log_return) == pytest.approx(math.log(r.nav), abs=1e-10)


def test_sets_are_the_top_share_of_what_passes(spark):
    codes = [f"I{i:02}" for i in range(15)]
    bars = spark.createDataFrame(noise(5, codes, 30), BARS)
    dice = random.Random(6)
    scores = {(d, c): dice.choice([0.1, 0.2, 0.3]) for d in days(30) for c in codes}
    candidates = spark.createDataFrame([(d, c, "return_r2", s) for (d, c), s in scores.items()], "date date, index_code string, method string, score double")
    m = select.filter_metrics(bars, (5,), (6,))
    values = {(r.date, r.index_code): r for r in m.collect()}
    for kind, levels, sets in (("bias", (-0.2, 0.0, 0.3), grid.bias_sets(candidates, m, (5,), (-0.2, 0.0, 0.3), 0.2)), ("vol", (0.2, 0.55, 1.0), grid.volatility_sets(candidates, m, (6,), (0.2, 0.55, 1.0), 0.2))):
        got = {(r.date, r.level): list(r.codes) for r in sets.collect()}
        for d in days(30):
            known = [(c, values[d, c]["bias_5" if kind == "bias" else "vol_6"]) for c in codes]
            known = [(c, v) for c, v in known if v is not None]
            for u in levels:
                if kind == "bias":
                    able = [c for c, v in known if v <= u + 1e-12]
                else:
                    able = [c for c, _ in sorted(known, key=lambda x: (-round(x[1], 10), x[0]))[: max(1, math.ceil(len(known) * u - 1e-12)) if known else 0]]
                want = sorted(able, key=lambda c: (-scores[d, c], c))[: max(1, math.ceil(0.2 * len(able) - 1e-12)) if able else 0]
                assert got.get((d, u), []) == want


def test_shared_dates_against_sets(spark):
    """Random gaps over more than three words of days; the plan never joins pools with all days."""
    codes = [f"I{i}" for i in range(8)]
    rows = noise(8, codes, 220, gap=0.1)
    bars = spark.createDataFrame(rows, BARS)
    dice = random.Random(9)
    pools = {d: dice.sample(codes, dice.randint(1, 5)) for d in (D(2020, 12, 1), days(220)[40], days(220)[63], days(220)[64], days(220)[127], days(220)[191], days(220)[219], D(2022, 1, 1))}
    members = spark.createDataFrame([(d, c) for d, cs in pools.items() for c in cs], "selection_date date, index_code string")
    got = {}
    for r in cases.shared_dates(members, bars, 20).collect():
        got.setdefault(r.selection_date, []).append(r.date)
    have = {c: {d for d, k, _, _ in rows if k == c} for c in codes}
    for s, cs in pools.items():
        both = sorted(d for d in set.intersection(*(have[c] for c in cs)) if d <= s)
        assert sorted(got.get(s, [])) == (both[-20:] if len(both) >= 20 else [])


def greedy(codes, dist, threshold):
    """Complete linkage by trying all pairs of clusters at each step."""
    groups = [[i] for i in range(len(codes))]
    while len(groups) > 1:
        best = min(((max((math.inf if math.isnan(dist[a][b]) else dist[a][b]) for a in g for b in h), min(g), min(h), g, h) for g, h in combinations(groups, 2)), key=lambda x: x[:3])
        if not best[0] <= 1 - threshold + 1e-12:
            break
        groups = sorted([g for g in groups if g not in best[3:]] + [best[3] + best[4]], key=min)
    return {codes[k]: n for n, g in enumerate(sorted(groups, key=min), 1) for k in g}


def test_chain_against_all_pairs():
    dice = np.random.default_rng(2)
    for t in range(200):
        n = int(dice.integers(1, 12))
        d = dice.random((n, n)) * 2
        d = (d + d.T) / 2
        if t % 3 == 0:
            hole = dice.random((n, n)) < 0.2
            d[hole | hole.T] = np.nan
        np.fill_diagonal(d, 0)
        names = [f"c{i:02}" for i in range(n)]
        steps = cluster.merges(d)
        assert [h for _, _, h in steps] == sorted(h for _, _, h in steps)
        for threshold in (0.9, 0.5, 0.0, -0.9):
            assert cluster.cut(names, steps, threshold) == greedy(names, d.tolist(), threshold)


def test_chain_does_not_depend_on_the_order_of_ties():
    d = np.array([[0, 1, 1, 1], [1, 0, 1, 1], [1, 1, 0, 1], [1, 1, 1, 0]], dtype=float)
    assert cluster.merges(d) == cluster.merges(d.copy()) and len(cluster.merges(d)) == 3
    assert cluster.merges(np.zeros((1, 1))) == [] and cluster.merges(np.full((3, 3), np.nan)) == []


def test_union_of_overlapping_files(spark):
    schema = "date date, index_code string, close double"
    a = spark.createDataFrame([(D(2021, 1, 1), "A", 1.0), (D(2021, 1, 2), "A", 2.0), (D(2021, 1, 3), "A", None)], schema)
    b = spark.createDataFrame([(D(2021, 1, 2), "A", 2.0), (D(2021, 1, 3), "A", None), (D(2021, 1, 4), "A", 4.0)], schema)
    assert sorted(r.date.day for r in factor.union_checked([a, b], ("date", "index_code")).collect()) == [1, 2, 3, 4]
    for bad in ((D(2021, 1, 2), "A", 2.5), (D(2021, 1, 3), "A", 3.0)):
        c = spark.createDataFrame([bad], schema)
        with pytest.raises(Exception, match=r"files disagree at 2021-01-0\d, A"):
            factor.union_checked([a, b, c], ("date", "index_code")).collect()


def test_years_without_rows_are_there(spark, tmp_path):
    df = spark.createDataFrame([(D(2023, 5, 1), "A", 1.0)], "date date, index_code string, close double")
    path = f"file://{tmp_path}/years"
    assert sinks.write_years(df, path, config.FACTOR_YEARS) == [2021, 2022, 2024, 2025, 2026]
    for y in config.FACTOR_YEARS:
        part = spark.read.parquet(f"{path}/year={y}")
        assert part.columns == df.columns and part.count() == (y == 2023)
    assert spark.read.parquet(path).count() == 1


def test_pending_cases_run_once(spark, tmp_path, sf_dir):
    from panelloom import registry

    panels = registry._case_panels(spark, sf_dir)
    chosen = [config.ExperimentCase("monthly", p, 0.7, "return_r2", 20, n) for p, n in (("base", 3), ("bias_only", 5))]
    path = f"file://{tmp_path}/cases"
    assert cases.run_pending(chosen[:1], panels, path) == (done := cases.RunSummary(1, 1, 0)) and done.executed == 1
    assert cases.run_pending(chosen, panels, path) == cases.RunSummary(2, 1, 1)
    assert cases.run_pending(chosen, panels, path) == cases.RunSummary(2, 0, 2)
    p = spark.read.parquet(f"{path}/performance")
    assert sorted((r.name, r.execution_mode) for r in p.collect()) == sorted((cases.case_name(c), m) for c in chosen for m in config.EXECUTION_MODES)
    assert spark.read.parquet(f"{path}/rows").where("kind = 'trade'").count() > 0
    with pytest.raises(ValueError):
        cases.run_pending([chosen[0], chosen[0]], panels, path)


def test_case_panels_are_made_once(spark, sf_dir):
    """The steps of a case read written panels, not the trades again."""
    from panelloom import registry

    p = registry._case_panels(spark, sf_dir)
    for df in (p.calendar, p.pools, p.returns, p.indexes, p.etfs):
        assert df.inputFiles() and not any("lineitem" in f for f in df.inputFiles())
    assert p.pools.count() == registry._pool(spark, sf_dir).count()

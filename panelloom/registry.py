"""Registered queries over the driver's tables, each with its SQL where SQL has a form for it.

Roles: instrument = part, index = brand, category = part type, day = ship date.
Sums of doubles differ in their last bits between engines, so final columns are
rounded and ranks are by rounded scores.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom import config, oracles
from panelloom.functions import scalars
from panelloom.operators import accounts, cluster, factor, grid, metrics, returns, select, simulate, universe
from panelloom.plans import cases
from panelloom.sources import panel, workbook
from panelloom.streaming import bars as stream_bars

START = "1996-01-01"
CLUSTER_THRESHOLDS = {"07": 0.7, "08": 0.8, "09": 0.9}
GRID_BIAS = ((12, 24, 36, 48, 60), (-0.02, 0.0, 0.03, 0.06, 0.09, 0.15))
GRID_VOL = ((6, 12, 18, 36), (0.25, 0.55, 0.8, 1.0))

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded columns; a zero loses its sign."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def _price(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded prices. Prices of cents over small quantities end in a five, so they are moved off that tie first."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(1e-9), 6) for c in columns})


def _price_sql(column: str) -> str:
    return f"ROUND({column} + 1e-9, 6) AS {column}"


# SQL of the panels, shared by the oracles.
ETF = """etf AS (SELECT CAST(l_shipdate AS DATE) AS date, l_partkey AS etf_code, p_brand AS index_code, p_type AS category, SUM(l_quantity) AS volume,
  SUM(l_extendedprice) AS amount, SUM(l_extendedprice) / SUM(l_quantity) AS vwap, AVG(l_extendedprice / l_quantity) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"""
IDX = """idx AS (SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS index_code, SUM(l_quantity) AS volume, SUM(l_extendedprice) AS amount,
  SUM(l_extendedprice) / SUM(l_quantity) AS vwap, AVG(l_extendedprice / l_quantity) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
MON = """mon AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, p_brand AS index_code, AVG(l_extendedprice / l_quantity) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
CAL = "cal AS (SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem))"
PLAN = f"plan AS (SELECT MAX(date) AS selection_date, MAX(pos) AS pos FROM cal WHERE date >= DATE '{START}' AND pos >= {config.TURNOVER_DATES} GROUP BY date_trunc('month', date))"
WIN = f"win AS (SELECT selection_date, cal.date FROM plan JOIN cal ON cal.pos BETWEEN plan.pos - {config.TURNOVER_DATES - 1} AND plan.pos)"
TURN = "turn AS (SELECT selection_date, etf_code, index_code, category, AVG(amount) AS avg_turnover_20d FROM win JOIN etf USING (date) GROUP BY 1, 2, 3, 4)"
SCREEN = """pool AS (SELECT * FROM (SELECT selection_date, turn.index_code, turn.etf_code, turn.category, listing_date, avg_turnover_20d,
  ROW_NUMBER() OVER (PARTITION BY selection_date, turn.index_code ORDER BY ROUND(avg_turnover_20d, 6) DESC, turn.etf_code) AS k
  FROM turn JOIN (SELECT etf_code, MIN(date) AS listing_date FROM etf GROUP BY 1) USING (etf_code)
  WHERE turn.category <> 'ECONOMY' AND date_diff('day', listing_date, selection_date) >= 365) WHERE k = 1)"""
POOL = f"{ETF}, {CAL}, {PLAN}, {WIN}, {TURN}, {SCREEN}"
RET = "ret AS (SELECT *, close / LAG(close) OVER (PARTITION BY index_code ORDER BY date) - 1 AS r FROM idx)"


def _trend_sql(n: int) -> str:
    w = f"(PARTITION BY index_code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    v = f"(PARTITION BY index_code ORDER BY date ROWS BETWEEN {n - 2} PRECEDING AND CURRENT ROW)"
    return f"""SELECT date, index_code, {n} AS trend_window, window_start, date AS window_end, window_start_close, close AS window_end_close, log_price_slope,
  close / window_start_close - 1 AS window_return, window_volatility, r_squared, (close / window_start_close - 1) * r_squared AS return_r2,
  (close / window_start_close - 1) / NULLIF(window_volatility, 0) AS return_vol
  FROM (SELECT date, index_code, close, COUNT(*) OVER {w} AS n, FIRST_VALUE(date) OVER {w} AS window_start, FIRST_VALUE(close) OVER {w} AS window_start_close,
    REGR_SLOPE(LN(close), t) OVER {w} AS log_price_slope, REGR_R2(LN(close), t) OVER {w} AS r_squared, STDDEV_SAMP(r) OVER {v} * SQRT({n - 1}.0) AS window_volatility
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY index_code ORDER BY date) AS t FROM ret)) WHERE n = {n}"""


TREND20 = f"{IDX}, {RET}, trend AS ({_trend_sql(20)})"
_BIAS_W, _VOL_W = config.BIAS_WINDOW, config.VOL_WINDOW


def _metric_sql(bias: tuple[int, ...], vol: tuple[int, ...]) -> str:
    made = []
    for n in bias:
        w = f"(PARTITION BY index_code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        made.append(f"CASE WHEN COUNT(close) OVER {w} = {n} THEN close / AVG(close) OVER {w} - 1 END AS bias_{n}")
    for n in vol:
        w = f"(PARTITION BY index_code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        made.append(f"CASE WHEN COUNT(r) OVER {w} = {n} THEN STDDEV_SAMP(r) OVER {w} END AS vol_{n}")
    return f"metric AS (SELECT index_code, date, close, {', '.join(made)} FROM ret)"


METRIC = _metric_sql((_BIAS_W,), (_VOL_W,))
_BIAS_OK = f"COALESCE(bias_{_BIAS_W} <= {config.BIAS_UPPER} + 1e-12, FALSE)"
_VOL_OK = f"(vol_{_VOL_W} IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY date ORDER BY ROUND(vol_{_VOL_W}, 10) DESC NULLS LAST, index_code) <= GREATEST(1, CEIL(COUNT(*) OVER (PARTITION BY date) * {config.VOL_KEEP} - 1e-12)))"
_PROFILE_SQL = {"base": "TRUE", "bias_only": _BIAS_OK, "volatility_only": _VOL_OK, "bias_and_volatility": f"({_BIAS_OK} AND {_VOL_OK})"}


def _flag_sql(profile: str) -> str:
    return f"{TREND20}, {METRIC}, flag AS (SELECT date, index_code, return_r2, {_PROFILE_SQL[profile]} AS eligible FROM trend LEFT JOIN metric USING (date, index_code))"


TOP = "top AS (SELECT date, index_code, return_r2, factor_rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY ROUND(return_r2, 10) DESC NULLS LAST, index_code) AS factor_rank, COUNT(*) OVER (PARTITION BY date) AS n FROM flag WHERE eligible) WHERE factor_rank <= GREATEST(1, CEIL(0.1 * n - 1e-12)))"
TRACK = "track AS (SELECT * FROM (SELECT date, index_code, etf_code, volume, amount, ROW_NUMBER() OVER (PARTITION BY date, index_code ORDER BY volume DESC, etf_code) AS k FROM etf) WHERE k = 1)"
TARGET = "target AS (SELECT date AS signal_date, index_code, etf_code, 1.0 / COUNT(*) OVER (PARTITION BY date) AS target_weight, factor_rank, volume AS selection_volume, amount AS selection_amount FROM top JOIN track USING (date, index_code))"


# --- flagship and panels


def _trends(spark: SparkSession, sf_dir: str, *windows: int) -> DataFrame:
    return factor.trend_windows(panel.index_bars(spark, sf_dir), windows)


@_query(f"WITH {TREND20}, flag AS (SELECT *, TRUE AS eligible FROM trend), {TOP} SELECT date, index_code, factor_rank, ROUND(return_r2, 6) + 0.0 AS return_r2 FROM top")
def trend_factor_top_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trends(spark, sf_dir, 20).select("date", "index_code", "return_r2", F.lit(True).alias("eligible"))
    return _round(select.top_fraction(t, "return_r2").select("date", "index_code", F.col("factor_rank").cast("long"), "return_r2"), "return_r2")


@_query(f"WITH {ETF} SELECT date, etf_code, index_code, category, volume, ROUND(amount, 4) AS amount, {_price_sql("vwap")}, {_price_sql("close")} FROM etf")
def etf_daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _price(_round(panel.etf_bars(spark, sf_dir), "amount", digits=4), "vwap", "close")


@_query(f"WITH {IDX} SELECT date, index_code, volume, ROUND(amount, 4) AS amount, {_price_sql("vwap")}, {_price_sql("close")} FROM idx")
def index_daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _price(_round(panel.index_bars(spark, sf_dir), "amount", digits=4), "vwap", "close")


@_query(f"WITH {CAL} SELECT date, pos FROM cal")
def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calendar(spark, sf_dir).select("date", F.col("pos").cast("long"))


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.calendar(panel.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")))


def _plans(spark: SparkSession, sf_dir: str, frequency: str = "monthly") -> DataFrame:
    return universe.selection_plans(_calendar(spark, sf_dir), frequency, START)


@_query(f"WITH {CAL}, {PLAN} SELECT selection_date, pos FROM plan")
def month_end_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir).select("selection_date", F.col("pos").cast("long"))


@_query(f"WITH {CAL} SELECT date AS selection_date, pos FROM cal WHERE date >= DATE '{START}' AND pos >= {config.TURNOVER_DATES}")
def daily_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir, "daily").select("selection_date", F.col("pos").cast("long"))


@_query(f"WITH {CAL}, {PLAN}, {WIN} SELECT selection_date, date FROM win")
def turnover_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.turnover_windows(_plans(spark, sf_dir), _calendar(spark, sf_dir))


@_query(f"WITH {IDX}, {RET} SELECT date, index_code, {_price_sql("close")}, ROUND(r, 6) + 0.0 AS daily_return FROM ret")
def daily_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_price(returns.daily_returns(panel.index_bars(spark, sf_dir)), "close"), "daily_return")


COMMON = "common AS (SELECT date FROM mon GROUP BY date HAVING COUNT(DISTINCT index_code) = (SELECT COUNT(DISTINCT index_code) FROM mon))"
PANEL = f"""pan AS (SELECT * FROM (SELECT index_code, date AS return_date, close, close / LAG(close) OVER (PARTITION BY index_code ORDER BY date) - 1 AS daily_return
  FROM mon JOIN (SELECT date FROM common ORDER BY date DESC LIMIT {config.PANEL_CLOSES}) USING (date)) WHERE daily_return IS NOT NULL)"""
PAIRS = """pairs AS (SELECT a.index_code AS code_a, b.index_code AS code_b, COVAR_SAMP(a.daily_return, b.daily_return) / NULLIF(STDDEV_SAMP(a.daily_return) * STDDEV_SAMP(b.daily_return), 0) AS corr
  FROM pan a JOIN pan b ON a.return_date = b.return_date AND a.index_code < b.index_code GROUP BY 1, 2)"""


@_query(f"WITH {MON}, {COMMON} SELECT date FROM common")
def common_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.common_dates(panel.index_bars(spark, sf_dir, "month"))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns.return_panel(panel.index_bars(spark, sf_dir, "month"))


@_query(f"WITH {MON}, {COMMON}, {PANEL} SELECT index_code, return_date, {_price_sql("close")}, ROUND(daily_return, 6) + 0.0 AS daily_return FROM pan")
def returns_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_price(_panel(spark, sf_dir), "close"), "daily_return")


# --- universe


def _turnover(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    return universe.average_turnover(universe.turnover_windows(_plans(spark, sf_dir), _calendar(spark, sf_dir)), bars or panel.etf_bars(spark, sf_dir))


def _pool(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    bars = bars or panel.etf_bars(spark, sf_dir)
    return universe.initial_screen(_turnover(spark, sf_dir, bars), bars)


@_query(f"WITH {ETF}, {CAL}, {PLAN}, {WIN}, {TURN} SELECT selection_date, etf_code, index_code, category, ROUND(avg_turnover_20d, 4) AS avg_turnover_20d FROM turn")
def avg_turnover_20d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_turnover(spark, sf_dir), "avg_turnover_20d", digits=4)


@_query(f"WITH {POOL} SELECT selection_date, index_code, etf_code, category, listing_date, ROUND(avg_turnover_20d, 4) AS avg_turnover_20d FROM pool")
def initial_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_pool(spark, sf_dir), "avg_turnover_20d", digits=4)


@_query(f"WITH {ETF}, {TRACK} SELECT date, index_code, etf_code, volume, ROUND(amount, 4) AS amount FROM track")
def largest_volume_etf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(select.tracking_etf(panel.etf_bars(spark, sf_dir)), "amount", digits=4)


LAST = "last AS (SELECT index_code, etf_code, avg_turnover_20d, CAST(regexp_extract(index_code, '[0-9]+') AS INT) % 5 + 1 AS cluster_id FROM pool WHERE selection_date = (SELECT MAX(selection_date) FROM pool))"
REP = "rep AS (SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY cluster_id) AS cluster_size, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY ROUND(avg_turnover_20d, 6) DESC, etf_code) AS k FROM last) WHERE k = 1)"


def _fixed_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clusters by the number of the brand, which SQL can follow, and the turnover of the last pool."""
    pool = _pool(spark, sf_dir)
    last = pool.join(F.broadcast(pool.agg(F.max("selection_date").alias("selection_date"))), "selection_date")  # one row
    number = F.regexp_extract("index_code", "[0-9]+", 0).cast("int")
    return last.select("index_code", (number % 5 + 1).alias("cluster_id")), last.select("index_code", "etf_code", "avg_turnover_20d")


@_query(f"WITH {POOL}, {LAST}, {REP} SELECT cluster_id, cluster_size, index_code, etf_code, ROUND(avg_turnover_20d, 4) AS avg_turnover_20d FROM rep")
def cluster_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cluster.representatives(*_fixed_clusters(spark, sf_dir)), "avg_turnover_20d", digits=4)


# --- factors

_TREND_OUT = f"date, index_code, trend_window, window_start, window_end, {_price_sql("window_start_close")}, {_price_sql("window_end_close")}, ROUND(log_price_slope, 8) + 0.0 AS log_price_slope, ROUND(window_return, 6) + 0.0 AS window_return, ROUND(window_volatility, 6) AS window_volatility, ROUND(r_squared, 6) + 0.0 AS r_squared, ROUND(return_r2, 6) + 0.0 AS return_r2, ROUND(return_vol, 6) + 0.0 AS return_vol"


def _trend_out(df: DataFrame) -> DataFrame:
    return _round(_price(_round(df, "log_price_slope", digits=8), "window_start_close", "window_end_close"), "window_return", "window_volatility", "r_squared", "return_r2", "return_vol")


def _add_trend(n: int) -> None:
    @_query(f"WITH {IDX}, {RET}, trend AS ({_trend_sql(n)}) SELECT {_TREND_OUT} FROM trend", f"trend_window_{n}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _trend_out(_trends(spark, sf_dir, n))


for _n in config.TREND_WINDOWS:
    _add_trend(_n)


@_query(f"WITH {IDX}, {RET}, trend AS ({' UNION ALL '.join(_trend_sql(n) for n in config.TREND_WINDOWS)}) SELECT {_TREND_OUT} FROM trend")
def trend_long_all_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trend_out(_trends(spark, sf_dir, *config.TREND_WINDOWS))


def _add_rank(score: str) -> None:
    sql = f"WITH {TREND20} SELECT date, index_code, ROUND({score}, 6) + 0.0 AS score, ROW_NUMBER() OVER w AS factor_rank, ROUND(ROW_NUMBER() OVER w * 1.0 / COUNT(*) OVER (PARTITION BY date), 6) AS rank_pct FROM trend WINDOW w AS (PARTITION BY date ORDER BY ROUND({score}, 10) DESC NULLS LAST, index_code)"

    @_query(sql, f"factor_rank_{score}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = factor.rank_factor(_trends(spark, sf_dir, 20), score)
        return _round(r.select("date", "index_code", F.col(score).alias("score"), F.col("factor_rank").cast("long"), "rank_pct"), "score", "rank_pct")


for _s in config.TREND_FACTORS:
    _add_rank(_s)


@_query(f"WITH {TREND20} SELECT date, index_code, 'return_r2' AS method, ROUND(return_r2, 6) + 0.0 AS score FROM trend UNION ALL SELECT date, index_code, 'return_vol', ROUND(return_vol, 6) + 0.0 FROM trend")
def factor_universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(factor.stacked_scores(_trends(spark, sf_dir, 20)).select("date", "index_code", "method", "score"), "score")


@_query(f"WITH {CAL}, {PLAN} SELECT cal.date, p.selection_date FROM cal ASOF LEFT JOIN plan p ON cal.date > p.selection_date")
def active_pool_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor.active_pool(_calendar(spark, sf_dir), _plans(spark, sf_dir))


INTERVAL = f"""ends AS (SELECT selection_date, COALESCE(LEAD(selection_date) OVER (ORDER BY selection_date), selection_date) AS end_date FROM (SELECT DISTINCT selection_date FROM pool)),
  num AS (SELECT index_code, date, close, ROW_NUMBER() OVER (PARTITION BY index_code ORDER BY date) AS k FROM idx),
  span AS (SELECT selection_date, end_date, index_code, MAX(CASE WHEN date <= selection_date THEN num.k END) AS lo, MAX(CASE WHEN date <= end_date THEN num.k END) AS hi FROM pool JOIN ends USING (selection_date) JOIN num USING (index_code) GROUP BY 1, 2, 3)"""


@_query(f"WITH {POOL}, {IDX}, {INTERVAL} SELECT selection_date, end_date, span.index_code, date, {_price_sql("close")} FROM span JOIN num ON num.index_code = span.index_code AND num.k BETWEEN lo - 60 AND hi WHERE lo IS NOT NULL")
def price_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _price(factor.price_intervals(_pool(spark, sf_dir).select("selection_date", "index_code"), panel.index_bars(spark, sf_dir)), "close")


@_query(f"WITH {POOL}, {IDX}, {INTERVAL} SELECT DISTINCT span.index_code, date, {_price_sql("close")} FROM span JOIN num ON num.index_code = span.index_code AND num.k BETWEEN lo - 60 AND hi WHERE lo IS NOT NULL")
def price_files_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price tables of all pools, which overlap, as one; a conflict would fail the query."""
    rows = factor.price_intervals(_pool(spark, sf_dir).select("selection_date", "index_code"), panel.index_bars(spark, sf_dir))
    odd = F.pmod(F.month("selection_date"), F.lit(2))
    parts = [rows.where(odd == k).select("index_code", "date", "close") for k in (0, 1)]
    return _price(factor.union_checked(parts, ("index_code", "date")), "close")


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder of this run under the one that executors share; a local one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_query(f"WITH {POOL} SELECT selection_date, index_code, CAST(etf_code AS VARCHAR) AS etf_code, category, ROUND(avg_turnover_20d, 4) AS avg_turnover_20d FROM pool")
def workbook_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools written as one workbook for each selection date, and read from those files."""
    pool = _round(_pool(spark, sf_dir), "avg_turnover_20d", digits=4)
    rows = pool.select(F.concat(scalars.file_date(F.col("selection_date")), F.lit(".xlsx")).alias("file"), F.col("selection_date").alias("日期"), F.col("index_code").alias("对标指数代码"), F.col("etf_code").cast("string").alias("代码"), F.col("category").alias("类别大类"), F.col("avg_turnover_20d").alias("过去20个交易日平均成交额"))
    folder = _scratch(spark, "pools")
    workbook.write_workbooks([workbook.Sheet(workbook.POOL_SHEET, rows, ("对标指数代码",))], folder).count()  # writes
    back = workbook.scan_workbooks(spark, folder, workbook.POOL_SHEET, ("日期", "对标指数代码", "代码", "类别大类", "过去20个交易日平均成交额"))
    return back.select(F.to_date("日期").alias("selection_date"), F.col("对标指数代码").alias("index_code"), F.col("代码").alias("etf_code"), F.col("类别大类").alias("category"), F.col("过去20个交易日平均成交额").cast("double").alias("avg_turnover_20d"))


@_query(f"WITH {POOL}, {TREND20}, act AS (SELECT cal.date, p.selection_date FROM cal ASOF JOIN plan p ON cal.date > p.selection_date) SELECT trend.date, act.selection_date AS pool_date, index_code, etf_code, trend_window, ROUND(return_r2, 6) + 0.0 AS return_r2, ROUND(return_vol, 6) + 0.0 AS return_vol FROM act JOIN pool USING (selection_date) JOIN trend USING (date, index_code)")
def daily_factor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = factor.active_pool(_calendar(spark, sf_dir), _plans(spark, sf_dir))
    rows = factor.daily_factor_rows(active, _pool(spark, sf_dir), _trends(spark, sf_dir, 20))
    return _round(rows.select("date", "pool_date", "index_code", "etf_code", "trend_window", "return_r2", "return_vol"), "return_r2", "return_vol")


# --- filters


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.filter_metrics(panel.index_bars(spark, sf_dir))


@_query(f"WITH {IDX}, {RET}, {METRIC} SELECT date, index_code, ROUND(bias_{_BIAS_W}, 6) + 0.0 AS bias, {_BIAS_OK} AS passes FROM metric")
def bias_36(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    return _round(m.select("date", "index_code", F.col(f"bias_{_BIAS_W}").alias("bias"), select.passes_bias(F.col(f"bias_{_BIAS_W}")).alias("passes")), "bias")


@_query(f"WITH {IDX}, {RET}, {METRIC} SELECT date, index_code, ROUND(vol_{_VOL_W}, 6) AS volatility, {_VOL_OK} AS passes FROM metric")
def volatility_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    return _round(m.select("date", "index_code", F.col(f"vol_{_VOL_W}").alias("volatility"), select.passes_volatility(F.col(f"vol_{_VOL_W}"), ["date"]).alias("passes")), "volatility")


def _flagged(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    candidates = _trends(spark, sf_dir, 20).select("date", "index_code", "return_r2")
    return select.filter_candidates(candidates, None if profile == "base" else _metrics(spark, sf_dir), profile)


def _add_filter(profile: str, name: str) -> None:
    @_query(f"WITH {_flag_sql(profile)}, {TOP} SELECT date, index_code, factor_rank, ROUND(return_r2, 6) + 0.0 AS return_r2 FROM top", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        top = select.top_fraction(_flagged(spark, sf_dir, profile), "return_r2")
        return _round(top.select("date", "index_code", F.col("factor_rank").cast("long"), "return_r2"), "return_r2")


for _p, _name in (("base", "filter_base"), ("bias_only", "filter_bias_only"), ("volatility_only", "filter_volatility_only"), ("bias_and_volatility", "filter_combined")):
    _add_filter(_p, _name)


@_query(f"WITH {_flag_sql('bias_and_volatility')} SELECT date, COUNT(*) AS planned_index_count, COUNT(*) FILTER (WHERE eligible) AS eligible_count, COUNT(*) FILTER (WHERE NOT eligible) AS filtered_index_count FROM flag GROUP BY date")
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.filter_counts(_flagged(spark, sf_dir, "bias_and_volatility"))


@_query(f"WITH {POOL}, {IDX} SELECT p.selection_date AS date, p.index_code, idx.date AS price_date, {_price_sql("close").replace("close +", "idx.close +", 1)}, COALESCE(date_diff('day', idx.date, p.selection_date) <= {config.STALE_DAYS}, FALSE) AS is_fresh FROM pool p ASOF LEFT JOIN idx ON p.index_code = idx.index_code AND p.selection_date >= idx.date")
def asof_pool_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = _pool(spark, sf_dir).select(F.col("selection_date").alias("date"), "index_code")
    return _price(select.asof_prices(signals, panel.index_bars(spark, sf_dir)), "close")


@_query(f"WITH {IDX}, {RET}, {METRIC} SELECT strftime(date, '%Y_%m_%d') AS file_date, index_code, printf('%.15g', volume) AS volume, CASE WHEN {_BIAS_OK} THEN '是' ELSE '否' END AS passes FROM metric JOIN (SELECT date, index_code, volume FROM idx) USING (date, index_code)")
def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = panel.index_bars(spark, sf_dir).select("date", "index_code", "volume")
    m = _metrics(spark, sf_dir).join(bars, ["date", "index_code"])
    flag = scalars.yes_no(select.passes_bias(F.col(f"bias_{_BIAS_W}")))
    return m.select(scalars.file_date(F.col("date")).alias("file_date"), "index_code", scalars.fifteen_digits(F.col("volume").cast("double")).alias("volume"), flag.alias("passes"))


# --- correlation and clusters


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.correlation_pairs(_panel(spark, sf_dir))


@_query(f"WITH {MON}, {COMMON}, {PANEL}, {PAIRS} SELECT code_a, code_b, ROUND(corr, 6) + 0.0 AS corr FROM pairs")
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_pairs(spark, sf_dir).select("code_a", "code_b", "corr"), "corr")


@_query(f"WITH {MON}, {COMMON}, {PANEL}, {PAIRS} SELECT code_a, code_b, ROUND(1 - corr, 6) + 0.0 AS dist FROM pairs UNION ALL SELECT code_b, code_a, ROUND(1 - corr, 6) + 0.0 FROM pairs UNION ALL SELECT DISTINCT index_code, index_code, 0.0 FROM pan")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    both = p.select("code_a", "code_b", "dist").unionByName(p.select(F.col("code_b").alias("code_a"), F.col("code_a").alias("code_b"), "dist"))
    own = _panel(spark, sf_dir).select(F.col("index_code").alias("code_a"), F.col("index_code").alias("code_b"), F.lit(0.0).alias("dist")).distinct()
    return _round(both.unionByName(own), "dist")


@_query(f"WITH {MON}, {COMMON}, {PANEL}, {PAIRS}, {POOL}, {LAST} SELECT c.cluster_id, ROUND(m, 6) + 0.0 AS min_corr_in_cluster FROM (SELECT DISTINCT cluster_id FROM last) c LEFT JOIN (SELECT a.cluster_id, MIN(corr) AS m FROM pairs JOIN last a ON a.index_code = code_a JOIN last b ON b.index_code = code_b WHERE a.cluster_id = b.cluster_id GROUP BY 1) USING (cluster_id)")
def min_corr_in_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cluster.min_correlation(_fixed_clusters(spark, sf_dir)[0], _pairs(spark, sf_dir)), "min_corr_in_cluster")


@_query(f"""WITH {MON}, {COMMON}, {PANEL}, {PAIRS}, {POOL}, {LAST}, {REP}, low AS (SELECT a.cluster_id, MIN(corr) AS m FROM pairs JOIN last a ON a.index_code = code_a JOIN last b ON b.index_code = code_b WHERE a.cluster_id = b.cluster_id GROUP BY 1)
  SELECT l.cluster_id, l.index_code = rep.index_code AS is_representative, l.etf_code, l.index_code, ROUND(l.avg_turnover_20d, 4) AS avg_turnover_20d,
  ROUND(CASE WHEN l.index_code = rep.index_code THEN 1.0 ELSE corr END, 6) + 0.0 AS corr_to_representative, ROUND(m, 6) + 0.0 AS min_corr_in_cluster, CAST(0.7 AS DOUBLE) AS corr_threshold, CAST(0.3 AS DOUBLE) AS dist_threshold
  FROM last l JOIN rep USING (cluster_id) LEFT JOIN low USING (cluster_id) LEFT JOIN pairs ON code_a = LEAST(l.index_code, rep.index_code) AND code_b = GREATEST(l.index_code, rep.index_code)""")
def cluster_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, turnover = _fixed_clusters(spark, sf_dir)
    d = cluster.cluster_detail(clusters, turnover, _pairs(spark, sf_dir), 0.7)
    return _round(_round(d, "avg_turnover_20d", digits=4), "corr_to_representative", "min_corr_in_cluster")


def _add_linkage(label: str, threshold: float) -> None:
    one = "all_m AS (SELECT DISTINCT DATE '2000-01-01' AS selection_date, index_code FROM pan), all_p AS (SELECT DATE '2000-01-01' AS selection_date, code_a, code_b, corr FROM pairs)"

    @_query(f"WITH RECURSIVE {MON}, {COMMON}, {PANEL}, {PAIRS}, {one}, {oracles.linkage_sql('all_m', 'all_p', (threshold,))} SELECT corr_threshold, index_code, cluster_id FROM clusters", f"complete_linkage_{label}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        codes = _panel(spark, sf_dir).select("index_code").distinct()
        return cluster.complete_linkage(codes, _pairs(spark, sf_dir), (threshold,))


for _label, _t in CLUSTER_THRESHOLDS.items():
    _add_linkage(_label, _t)


# --- targets and simulation

_TARGET_SQL = f"{_flag_sql('bias_and_volatility')}, {TOP}, {ETF}, {TRACK}, {TARGET}"
_TARGET_OUT = "index_code, etf_code, ROUND(target_weight, 6) AS target_weight, factor_rank, selection_volume, ROUND(selection_amount, 4) AS selection_amount"


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = select.top_fraction(_flagged(spark, sf_dir, "bias_and_volatility"), "return_r2")
    return select.daily_targets(top, select.tracking_etf(panel.etf_bars(spark, sf_dir)))


def _target_out(df: DataFrame) -> DataFrame:
    return _round(_round(df.withColumn("factor_rank", F.col("factor_rank").cast("long")), "selection_amount", digits=4), "target_weight")


@_query(f"WITH {_TARGET_SQL} SELECT signal_date, signal_date AS execution_date, {_TARGET_OUT} FROM target")
def daily_targets_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target_out(select.execution_schedule(_targets(spark, sf_dir), _calendar(spark, sf_dir), "close"))


@_query(f"WITH {_TARGET_SQL}, {CAL}, nxt AS (SELECT date, LEAD(date) OVER (ORDER BY date) AS execution_date FROM cal) SELECT signal_date, execution_date, {_TARGET_OUT} FROM target JOIN nxt ON nxt.date = signal_date WHERE execution_date IS NOT NULL")
def daily_targets_next_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _target_out(select.execution_schedule(_targets(spark, sf_dir), _calendar(spark, sf_dir), "next_day_vwap"))


@_query(f"WITH {_TARGET_SQL} SELECT signal_date, etf_code, ROUND(SUM(target_weight), 6) AS weight, COUNT(*) AS n_indexes FROM target GROUP BY 1, 2")
def target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(select.aggregate_weights(_targets(spark, sf_dir)), "weight")


@_query(f"WITH {_TARGET_SQL} SELECT signal_date, ROUND(MIN(0.1 * selection_amount / target_weight), 4) AS capacity FROM target GROUP BY 1")
def target_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(select_capacity(_targets(spark, sf_dir)), "capacity", digits=4)


def select_capacity(targets: DataFrame) -> DataFrame:
    return metrics.capacity(targets)


@_query(f"WITH {CAL} SELECT CAST((pos - 2) % 3 + 1 AS INT) AS account_id, date, LAG(date) OVER (ORDER BY date) AS signal_date FROM cal QUALIFY pos >= 2")
def stagger_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.stagger_schedule(_calendar(spark, sf_dir), 3, "next_day_vwap")


# Daily closes of a brand are averages of a few trades, too noisy to hold: navs are of the monthly panel.
NAV_WINDOW = 10
MONTHS_A_YEAR = 12


def _choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = factor.trend_windows(panel.index_bars(spark, sf_dir, "month"), (NAV_WINDOW,)).select("date", "index_code", "return_r2")
    return universe.largest_by(t, ["date"], [F.round("return_r2", 10).desc_nulls_last(), F.col("index_code")], "date", "index_code")


IDX_MONTH = IDX.replace("CAST(l_shipdate AS DATE) AS date", "CAST(date_trunc('month', l_shipdate) AS DATE) AS date")
CHOICE = f"{IDX_MONTH}, {RET}, trend AS ({_trend_sql(NAV_WINDOW)}), choice AS (SELECT date, index_code FROM (SELECT date, index_code, ROW_NUMBER() OVER (PARTITION BY date ORDER BY ROUND(return_r2, 10) DESC NULLS LAST, index_code) AS k FROM trend) WHERE k = 1)"
_FEE = "CASE WHEN old IS NULL THEN 1 / 1.001 WHEN old = now THEN 1.0 ELSE 0.999 / 1.001 END"
NAV_CLOSE = f"""{CHOICE}, plan1 AS (SELECT date, index_code AS now, LAG(index_code) OVER (ORDER BY date) AS old, LAG(date) OVER (ORDER BY date) AS before FROM choice),
  nav AS (SELECT p.date, now AS index_code, EXP(SUM(LN(COALESCE(a.close / b.close, 1.0) * {_FEE})) OVER (ORDER BY p.date ROWS UNBOUNDED PRECEDING)) AS nav
  FROM plan1 p LEFT JOIN idx a ON a.date = p.date AND a.index_code = old LEFT JOIN idx b ON b.date = before AND b.index_code = old)"""
NAV_VWAP = f"""{CHOICE}, plan1 AS (SELECT date, LAG(index_code) OVER (ORDER BY date) AS now, LAG(index_code, 2) OVER (ORDER BY date) AS old, LAG(date) OVER (ORDER BY date) AS before FROM choice),
  nav AS (SELECT p.date, now AS index_code, EXP(SUM(LN(CASE WHEN now IS NULL THEN 1.0 ELSE COALESCE(a.vwap / b.close, 1.0) * {_FEE} * c.close / c.vwap END)) OVER (ORDER BY p.date ROWS UNBOUNDED PRECEDING)) AS nav
  FROM plan1 p LEFT JOIN idx a ON a.date = p.date AND a.index_code = old LEFT JOIN idx b ON b.date = before AND b.index_code = old LEFT JOIN idx c ON c.date = p.date AND c.index_code = now)"""


def _nav(spark: SparkSession, sf_dir: str, mode: str = "close") -> DataFrame:
    return simulate.top_one_nav(_choice(spark, sf_dir), panel.index_bars(spark, sf_dir, "month"), mode)


@_query(f"WITH {NAV_CLOSE} SELECT date, index_code, ROUND(LN(nav), 6) + 0.0 AS log_nav FROM nav")
def nav_top1_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_nav(spark, sf_dir).select("date", "index_code", "log_nav"), "log_nav")


@_query(f"WITH {NAV_VWAP} SELECT date, index_code, ROUND(LN(nav), 6) + 0.0 AS log_nav FROM nav")
def nav_top1_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_nav(spark, sf_dir, "next_day_vwap").select("date", "index_code", "log_nav"), "log_nav")


BATCH_PROFILES = tuple(config.FILTER_PROFILES)
_CASES_T = "case_id string, stagger_days int, execution_mode string"


def _one_case(days: int, mode: str) -> str:
    """CTEs of one case, the top decile of the combined profile, day by day; the instruments are the indexes."""
    tw = "tw AS (SELECT 'one' AS case_id, date AS signal_date, index_code, 1.0 / COUNT(*) OVER (PARTITION BY date) AS weight FROM top)"
    return f"WITH RECURSIVE {_flag_sql('bias_and_volatility')}, {TOP}, {CAL}, {tw}, cs AS (SELECT 'one' AS case_id, {days} AS d, '{mode}' AS mode), {oracles.accounts_sql()}"


def _portfolio(spark: SparkSession, sf_dir: str, days: int, mode: str) -> DataFrame:
    """Top decile of the indexes, traded as instruments of their own (their panel is dense)."""
    bars = panel.index_bars(spark, sf_dir)
    top = select.top_fraction(_flagged(spark, sf_dir, "bias_and_volatility"), "return_r2")
    weights = top.select(F.lit("one").alias("case_id"), F.col("date").alias("signal_date"), F.col("index_code").alias("etf_code"), (1 / F.count("*").over(Window.partitionBy("date"))).alias("weight"))
    case = spark.createDataFrame([("one", days, mode)], _CASES_T)
    return accounts.run_portfolios(_calendar(spark, sf_dir), case, weights, bars.select("date", F.col("index_code").alias("etf_code"), "close", "vwap"))


def _nav_out(rows: DataFrame) -> DataFrame:
    """Logarithms and shares, as navs of random prices run over many orders of size."""
    d = accounts.portfolio_days(rows)
    out = d.select("date", F.log("nav").alias("log_nav"), (F.col("turnover") / F.col("nav")).alias("turnover_rate"), (F.col("cost") / F.col("nav")).alias("cost_rate"), "n_holdings", "n_rebalanced")
    return _round(out, "log_nav", "turnover_rate", "cost_rate")


_NAV_OUT = "SELECT date, ROUND(LN(nav), 6) + 0.0 AS log_nav, ROUND(traded / nav, 6) + 0.0 AS turnover_rate, ROUND(cost / nav, 6) + 0.0 AS cost_rate, CAST(n_holdings AS BIGINT) AS n_holdings, n_rebalanced FROM total"


@_query(f"{_one_case(1, 'close')} {_NAV_OUT}")
def nav_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nav_out(_portfolio(spark, sf_dir, 1, "close"))


@_query(f"{_one_case(5, 'next_day_vwap')} {_NAV_OUT}")
def nav_staggered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nav_out(_portfolio(spark, sf_dir, 5, "next_day_vwap"))


@_query(f"{_one_case(3, 'next_day_vwap')} SELECT days.account_id, days.date, ROUND(LN(nav), 6) + 0.0 AS log_nav, slot.pos IS NOT NULL AS rebalance_attempted, done AS rebalanced, ROUND(traded / nav, 6) + 0.0 AS turnover_rate, ROUND(cost / nav, 6) + 0.0 AS cost_rate, CAST(n_holdings AS INT) AS n_holdings FROM days LEFT JOIN slot ON slot.account_id = days.account_id AND slot.date = days.date")
def account_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = accounts.account_days(_portfolio(spark, sf_dir, 3, "next_day_vwap"))
    rates = {c: F.col(c.removesuffix("_rate")) / F.col("account_nav") for c in ("turnover_rate", "cost_rate")}
    return _round(d.select("account_id", "date", F.log("account_nav").alias("log_nav"), "rebalance_attempted", "rebalanced", *[v.alias(k) for k, v in rates.items()], "n_holdings"), "log_nav", *rates)


@_query(f"{_one_case(2, 'close')} SELECT date, ROUND(traded / (2 * nav), 6) + 0.0 AS one_way_turnover, ROUND(cost / nav, 6) + 0.0 AS cost_rate, CAST(n_holdings AS BIGINT) AS n_holdings, n_rebalanced FROM total")
def turnover_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.turnover_cost(accounts.account_days(_portfolio(spark, sf_dir, 2, "close"))), "one_way_turnover", "cost_rate")


@_query(f"""{_one_case(3, 'next_day_vwap')}, moved AS (SELECT account_id, date AS execution_date, nav, UNNEST(range(1, len(p) + 1)) AS k, UNNEST(p) AS was, UNNEST(wanted) AS now FROM days WHERE done)
  SELECT moved.account_id, execution_date, slot.signal_date, index_code AS etf_code, CASE WHEN now > was THEN '买入' ELSE '卖出' END AS direction, ROUND(ABS(now - was) / nav, 6) + 0.0 AS amount_rate
  FROM moved JOIN cd USING (k) JOIN slot ON slot.account_id = moved.account_id AND slot.date = execution_date WHERE ABS(now - was) / nav > 1e-9""")
def trade_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _portfolio(spark, sf_dir, 3, "next_day_vwap")
    nav = accounts.account_days(rows).select("account_id", F.col("date").alias("execution_date"), "account_nav")
    trades = accounts.trade_records(rows).join(nav, ["account_id", "execution_date"]).withColumn("amount_rate", F.col("amount") / F.col("account_nav")).where("amount_rate > 1e-9")
    return _round(trades.select("account_id", "execution_date", "signal_date", "etf_code", "direction", "amount_rate"), "amount_rate")


def _batch() -> list[tuple[str, int, str]]:
    """Twenty cases: every filter profile with every window, staggered by 3 to 10 days, in turn with both fill modes.

    (Prices of the tables are noise: what trades on them every day is worth nothing within a few years.)"""
    every = [(p, n) for p in BATCH_PROFILES for n in config.TREND_WINDOWS]
    return [(f"{p}_{n}", (3, 4, 6, 8, 10)[i % 5], config.EXECUTION_MODES[i % 2]) for i, (p, n) in enumerate(every)]


_BATCH_FLAGS = " UNION ALL ".join(f"SELECT '{p}_' || trend_window AS case_id, date, index_code, return_r2, {_PROFILE_SQL[p].replace('PARTITION BY date', 'PARTITION BY trend_window, date')} AS eligible FROM trend LEFT JOIN metric USING (date, index_code)" for p in BATCH_PROFILES)
_BATCH_SQL = f"""WITH RECURSIVE {IDX}, {RET}, trend AS ({' UNION ALL '.join(_trend_sql(n) for n in config.TREND_WINDOWS)}), {METRIC}, flag AS ({_BATCH_FLAGS}), {CAL},
  ranked AS (SELECT case_id, date, index_code, ROW_NUMBER() OVER (PARTITION BY case_id, date ORDER BY ROUND(return_r2, 10) DESC NULLS LAST, index_code) AS k, COUNT(*) OVER (PARTITION BY case_id, date) AS n FROM flag WHERE eligible),
  tw AS (SELECT case_id, date AS signal_date, index_code, 1.0 / COUNT(*) OVER (PARTITION BY case_id, date) AS weight FROM ranked WHERE k <= GREATEST(1, CEIL(0.1 * n - 1e-12))),
  cs(case_id, d, mode) AS (VALUES {', '.join(map(str, _batch()))}), {oracles.accounts_sql()},
  dd AS (SELECT *, nav / MAX(nav) OVER (PARTITION BY case_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM total)
  SELECT case_id, MIN(date) AS start_date, MAX(date) AS end_date, COUNT(*) AS n_days, ROUND(LN(ARG_MAX(nav, date)), 6) + 0.0 AS log_nav, ROUND(MIN(drawdown), 6) + 0.0 AS max_drawdown, ROUND(AVG(traded / (2 * nav)), 6) + 0.0 AS mean_daily_turnover,
  ROUND(AVG(traded / (2 * nav)) * {config.DAYS_A_YEAR}, 4) + 0.0 AS annual_turnover, ROUND(SUM(cost / nav), 6) + 0.0 AS total_cost_rate, ROUND(AVG(n_holdings), 6) + 0.0 AS mean_holdings, CAST(SUM(n_rebalanced) AS BIGINT) AS n_rebalances FROM dd GROUP BY case_id"""


@_query(_BATCH_SQL)
def case_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty cases in one job: a group for each account of each."""
    bars = panel.index_bars(spark, sf_dir)
    trends = _trends(spark, sf_dir, *config.TREND_WINDOWS).select("date", "trend_window", "index_code", "return_r2")
    flagged = None
    for p in BATCH_PROFILES:
        one = select.filter_candidates(trends, None if p == "base" else _metrics(spark, sf_dir), p, ("trend_window", "date"))
        one = one.select(F.concat_ws("_", F.lit(p), "trend_window").alias("case_id"), "date", "index_code", "return_r2", "eligible")
        flagged = one if flagged is None else flagged.unionByName(one)
    top = select.top_fraction(flagged, "return_r2", ("case_id", "date"))
    weights = top.select("case_id", F.col("date").alias("signal_date"), F.col("index_code").alias("etf_code"), (1 / F.count("*").over(Window.partitionBy("case_id", "date"))).alias("weight"))
    rows = accounts.run_portfolios(_calendar(spark, sf_dir), spark.createDataFrame(_batch(), _CASES_T), weights, bars.select("date", F.col("index_code").alias("etf_code"), "close", "vwap"), trades=False)
    days = accounts.portfolio_days(rows)
    p = metrics.performance(days, ("case_id",), trading=True).withColumn("log_nav", F.log("final_nav"))
    out = ("log_nav", "max_drawdown", "mean_daily_turnover", "total_cost_rate", "mean_holdings")
    return _round(_round(p.select("case_id", "start_date", "end_date", "n_days", *out, "annual_turnover", "n_rebalances"), *out), "annual_turnover", digits=4)


# --- whole cases

#: Months of the return panels, as the common days of all brands are few.
CASE_CLOSES = 13
CASE = config.ExperimentCase("monthly", "bias_and_volatility", 0.7, "return_r2", 20, 5)


def _case_panels(spark: SparkSession, sf_dir: str) -> cases.Panels:
    """Each panel is made once and written, as the steps of a case read it many times."""
    folder = _scratch(spark, "panels")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    etfs = written(panel.etf_bars(spark, sf_dir), "etfs")
    calendar, pools = written(_calendar(spark, sf_dir), "calendar"), written(_pool(spark, sf_dir, etfs), "pools")
    indexes = [written(panel.index_bars(spark, sf_dir, by), by) for by in ("month", "day")]
    return cases.Panels(calendar, pools, *indexes, etfs, CASE_CLOSES)


SNAP = f"""mem AS (SELECT selection_date, index_code, COUNT(*) OVER (PARTITION BY selection_date) AS members FROM pool), hist AS (SELECT m.selection_date, m.index_code, members, date, close FROM mem m JOIN mon USING (index_code) WHERE date <= m.selection_date),
  dts AS (SELECT selection_date, date FROM (SELECT *, COUNT(*) OVER (PARTITION BY selection_date) AS dates FROM (SELECT selection_date, date, ROW_NUMBER() OVER (PARTITION BY selection_date ORDER BY date DESC) AS k FROM hist GROUP BY selection_date, date, members HAVING COUNT(*) = members) WHERE k <= {CASE_CLOSES}) WHERE dates = {CASE_CLOSES}),
  snap AS (SELECT * FROM (SELECT selection_date, index_code, date AS return_date, close / LAG(close) OVER (PARTITION BY selection_date, index_code ORDER BY date) - 1 AS daily_return FROM hist JOIN dts USING (selection_date, date)) WHERE daily_return IS NOT NULL),
  spair AS (SELECT selection_date, a.index_code AS code_a, b.index_code AS code_b, COVAR_SAMP(a.daily_return, b.daily_return) / NULLIF(STDDEV_SAMP(a.daily_return) * STDDEV_SAMP(b.daily_return), 0) AS corr FROM snap a JOIN snap b USING (selection_date, return_date) WHERE a.index_code < b.index_code GROUP BY 1, 2, 3)"""


@_query(f"WITH {POOL}, {MON}, {SNAP} SELECT selection_date, code_a, code_b, ROUND(corr, 6) + 0.0 AS corr FROM spair")
def snapshot_corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _case_panels(spark, sf_dir)
    pairs = cluster.correlation_pairs(cases.snapshot_returns(p.pools, p.returns, p.closes), ("selection_date",))
    return _round(pairs.select("selection_date", "code_a", "code_b", "corr"), "corr")


def _snapshot_sql(thresholds: tuple[float, ...]) -> str:
    return f"WITH RECURSIVE {POOL}, {MON}, {SNAP}, {oracles.linkage_sql('(SELECT DISTINCT selection_date, index_code FROM pool)', 'spair', thresholds)}"


@_query(f"{_snapshot_sql((CASE.correlation_threshold,))} SELECT c.selection_date, c.index_code, cluster_id, etf_code, ROUND(avg_turnover_20d, 4) AS avg_turnover_20d FROM clusters c JOIN pool USING (selection_date, index_code)")
def snapshot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cases.snapshot_clusters(_case_panels(spark, sf_dir), CASE.correlation_threshold), "avg_turnover_20d", digits=4)


@_query(f"""{_snapshot_sql(config.CORRELATION_THRESHOLDS)}, own AS (SELECT c.*, etf_code, avg_turnover_20d, category, ROW_NUMBER() OVER w AS k, FIRST_VALUE(c.index_code) OVER w AS rep FROM clusters c JOIN pool USING (selection_date, index_code) WINDOW w AS (PARTITION BY selection_date, corr_threshold, cluster_id ORDER BY ROUND(avg_turnover_20d, 6) DESC, etf_code)),
  low AS (SELECT a.selection_date, a.corr_threshold, a.cluster_id, MIN(corr) AS m FROM own a JOIN own b USING (selection_date, corr_threshold, cluster_id) JOIN spair p ON p.selection_date = a.selection_date AND p.code_a = a.index_code AND p.code_b = b.index_code GROUP BY 1, 2, 3)
  SELECT own.selection_date, own.cluster_id, k = 1 AS is_representative, etf_code, p_name AS etf_name, own.category, own.index_code, p_brand AS index_name, ROUND(avg_turnover_20d, 4) AS avg_turnover_20d,
  ROUND(CASE WHEN k = 1 THEN 1.0 ELSE corr END, 6) + 0.0 AS corr_to_representative, ROUND(m, 6) + 0.0 AS min_corr_in_cluster, own.corr_threshold, ROUND(1 - own.corr_threshold, 10) AS dist_threshold
  FROM own JOIN part ON p_partkey = etf_code LEFT JOIN low USING (selection_date, corr_threshold, cluster_id) LEFT JOIN spair p ON p.selection_date = own.selection_date AND code_a = LEAST(own.index_code, rep) AND code_b = GREATEST(own.index_code, rep)""")
def snapshot_cluster_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thresholds from one run of the linkage; the report's twelve columns."""
    found, pairs = cases.snapshot_clusterings(_case_panels(spark, sf_dir), config.CORRELATION_THRESHOLDS)
    names = panel.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("etf_code"), F.col("p_name").alias("etf_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("index_name"))
    d = cluster.snapshot_detail(found, pairs, names)
    return _round(_round(d, "avg_turnover_20d", digits=4), "corr_to_representative", "min_corr_in_cluster")


@_query()
def case_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cases.run_case(CASE, _case_panels(spark, sf_dir))["performance"].withColumn("log_nav", F.log("final_nav"))
    out = ("log_nav", "max_drawdown", "mean_daily_turnover", "total_cost_rate", "mean_holdings")
    return _round(p.select("execution_mode", "start_date", "end_date", "n_days", *out, "n_rebalances"), *out)


# --- performance

DRAW = "dd AS (SELECT date, nav, nav / LAG(nav) OVER (ORDER BY date) - 1 AS daily_return, MAX(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak, nav / MAX(nav) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM nav)"


@_query(f"WITH {NAV_CLOSE}, {DRAW} SELECT date, ROUND(daily_return, 6) + 0.0 AS daily_return, ROUND(drawdown, 6) + 0.0 AS drawdown FROM dd")
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.drawdowns(_nav(spark, sf_dir)).select("date", "daily_return", "drawdown"), "daily_return", "drawdown")


@_query(f"""WITH {NAV_CLOSE}, {DRAW}, agg AS (SELECT MIN(date) AS start_date, MAX(date) AS end_date, COUNT(*) AS n_days, ARG_MIN(nav, date) AS a, ARG_MAX(nav, date) AS b, STDDEV_SAMP(daily_return) AS sd, AVG(daily_return) AS mu,
  SQRT(AVG(POW(LEAST(daily_return, 0.0), 2))) AS down, MIN(drawdown) AS max_drawdown, ARG_MIN(date, ROUND(drawdown, 10)) AS max_drawdown_date, (COUNT(*) - 1) / 12.0 AS years FROM (SELECT *, CASE WHEN daily_return IS NULL THEN NULL ELSE daily_return END AS x FROM dd ORDER BY date))
  SELECT start_date, end_date, n_days, ROUND(LN(b / a), 6) + 0.0 AS log_return, ROUND(POW(b / a, 1 / years) - 1, 6) + 0.0 AS annual_return, ROUND(sd * SQRT(12.0), 6) AS annual_volatility, ROUND(mu / sd * SQRT(12.0), 6) + 0.0 AS sharpe,
  ROUND(mu / down * SQRT(12.0), 6) + 0.0 AS sortino, ROUND(max_drawdown, 6) + 0.0 AS max_drawdown, ROUND((POW(b / a, 1 / years) - 1) / -max_drawdown, 6) + 0.0 AS calmar,
  (SELECT MIN(date) FROM nav WHERE nav.nav = (SELECT peak FROM dd WHERE dd.date = agg.max_drawdown_date)) AS max_drawdown_start, max_drawdown_date FROM agg""")
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = metrics.performance(_nav(spark, sf_dir), periods=MONTHS_A_YEAR).withColumn("log_return", F.log("final_nav") - F.log("initial_nav"))
    out = ("annual_return", "annual_volatility", "sharpe", "sortino", "max_drawdown", "calmar", "log_return")
    return _round(p.select("start_date", "end_date", "n_days", *out, "max_drawdown_start", "max_drawdown_date"), *out)


ALL = "allp AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, AVG(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1)"
REL = f"""{NAV_CLOSE}, {ALL}, bench AS (SELECT nav.date, allp.close / FIRST_VALUE(allp.close) OVER (ORDER BY nav.date) AS benchmark_nav FROM nav JOIN allp USING (date)),
  rel AS (SELECT date, nav, benchmark_nav, nav / benchmark_nav AS rel, nav / LAG(nav) OVER (ORDER BY date) - benchmark_nav / LAG(benchmark_nav) OVER (ORDER BY date) AS x FROM nav JOIN bench USING (date)),
  rel2 AS (SELECT *, rel / MAX(rel) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS down FROM rel)"""


@_query(f"""WITH {REL}, g AS (SELECT (COUNT(*) - 1) / 12.0 AS years, ARG_MAX(nav, date) / ARG_MIN(nav, date) AS s, ARG_MAX(benchmark_nav, date) / ARG_MIN(benchmark_nav, date) AS b, ARG_MAX(rel, date) / ARG_MIN(rel, date) AS e, STDDEV_SAMP(x) AS sd, AVG(x) AS mu, MIN(down) AS down FROM rel2)
  SELECT ROUND(POW(b, 1 / years) - 1, 6) + 0.0 AS benchmark_annual_return, ROUND(POW(s, 1 / years) - POW(b, 1 / years), 6) + 0.0 AS excess_annual_return, ROUND(sd * SQRT(12.0), 6) AS tracking_error, ROUND(mu / sd * SQRT(12.0), 6) + 0.0 AS information_ratio, ROUND(down, 6) + 0.0 AS excess_max_drawdown, ROUND(e - 1, 6) + 0.0 AS excess_cumulative FROM g""")
def relative_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = _nav(spark, sf_dir)
    bars = panel.table(spark, sf_dir, "lineitem").groupBy(F.trunc(F.to_date("l_shipdate"), "month").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    r = metrics.relative_performance(nav, metrics.benchmark_nav(bars, nav), MONTHS_A_YEAR)
    out = ("benchmark_annual_return", "excess_annual_return", "tracking_error", "information_ratio", "excess_max_drawdown", "excess_cumulative")
    return _round(r.select(*out), *out)


@_query(f"""WITH {NAV_CLOSE}, {DRAW}, y AS (SELECT *, EXTRACT(YEAR FROM date) AS year, LAG(nav) OVER (ORDER BY date) AS before FROM dd), z AS (SELECT *, nav / MAX(nav) OVER (PARTITION BY year ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS yd FROM y)
  SELECT CAST(year AS INT) AS year, COUNT(*) AS n_days, ROUND(ARG_MAX(nav, date) / COALESCE(ARG_MIN(before, date), ARG_MIN(nav, date)) - 1, 6) + 0.0 AS year_return, ROUND(STDDEV_SAMP(daily_return) * SQRT(12.0), 6) AS year_volatility, ROUND(MIN(yd), 6) + 0.0 AS year_max_drawdown FROM z GROUP BY year""")
def annual_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(metrics.annual_metrics(_nav(spark, sf_dir), periods=MONTHS_A_YEAR), "year_return", "year_volatility", "year_max_drawdown")


# --- grids and matrices


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor.stacked_scores(_trends(spark, sf_dir, 20)).select("date", "index_code", "method", "score").where("score is not null")


def _bias_grid(spark: SparkSession, sf_dir: str, mode: str = "close", combined: bool = False) -> DataFrame:
    bars = panel.index_bars(spark, sf_dir)
    m = select.filter_metrics(bars, GRID_BIAS[0], (_VOL_W,) if combined else ())
    candidates = grid.also_volatile(_candidates(spark, sf_dir), m, f"vol_{_VOL_W}") if combined else _candidates(spark, sf_dir)
    return grid.total_returns(grid.bias_choices(candidates, m, *GRID_BIAS), bars, ["method", "window", "level"], mode=mode)


def _vol_grid(spark: SparkSession, sf_dir: str, mode: str = "close", combined: bool = False) -> DataFrame:
    bars = panel.index_bars(spark, sf_dir)
    m = select.filter_metrics(bars, (_BIAS_W,) if combined else (), GRID_VOL[0])
    candidates = grid.also_unbiased(_candidates(spark, sf_dir), m, f"bias_{_BIAS_W}") if combined else _candidates(spark, sf_dir)
    return grid.total_returns(grid.volatility_choices(candidates, m, *GRID_VOL), bars, ["method", "window", "level"], mode=mode)


def _grid_sql(kind: str, mode: str = "close", combined: bool = False) -> str:
    windows, levels = GRID_BIAS if kind == "bias" else GRID_VOL
    metric = _metric_sql(*((windows, (_VOL_W,) if combined else ()) if kind == "bias" else ((_BIAS_W,) if combined else (), windows)))
    union = " UNION ALL ".join(f'SELECT date, index_code, {n} AS "window", {kind}_{n} AS m FROM metric WHERE {kind}_{n} IS NOT NULL' for n in windows)
    level = ", ".join(f"({x})" for x in levels)
    flag = "TRUE"
    if combined and kind == "bias":
        flag = f"vol_{_VOL_W} IS NOT NULL AND ROW_NUMBER() OVER (PARTITION BY method, date ORDER BY ROUND(vol_{_VOL_W}, 10) DESC NULLS LAST, index_code) <= GREATEST(1, CEIL(COUNT(*) OVER (PARTITION BY method, date) * {config.VOL_KEEP} - 1e-12))"
    elif combined:
        flag = _BIAS_OK
    if kind == "bias":
        passing = "SELECT method, \"window\", CAST(level AS DOUBLE) AS level, date, index_code, score FROM cand JOIN ms USING (date, index_code) JOIN lv ON m <= level + 1e-12 WHERE ok"
    else:
        passing = "SELECT method, \"window\", CAST(level AS DOUBLE) AS level, date, index_code, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY method, \"window\", date ORDER BY ROUND(m, 10) DESC, index_code) AS place, COUNT(*) OVER (PARTITION BY method, \"window\", date) AS n FROM cand JOIN ms USING (date, index_code)) JOIN lv ON place <= GREATEST(1, CEIL(n * CAST(level AS DOUBLE) - 1e-12)) WHERE ok"
    if mode == "close":
        plan = "index_code AS now, LAG(index_code) OVER w AS old"
        step = f"COALESCE(a.close / b.close, 1.0) * {_FEE}"
    else:
        plan = "LAG(index_code) OVER w AS now, LAG(index_code, 2) OVER w AS old"
        step = f"CASE WHEN now IS NULL THEN 1.0 ELSE COALESCE(a.vwap / b.close, 1.0) * {_FEE} * COALESCE(c.close / c.vwap, 1.0) END"
    return f"""{TREND20}, {metric}, ms AS ({union}), lv(level) AS (VALUES {level}), raw AS (SELECT date, index_code, 'return_r2' AS method, return_r2 AS score FROM trend WHERE return_r2 IS NOT NULL UNION ALL SELECT date, index_code, 'return_vol', return_vol FROM trend WHERE return_vol IS NOT NULL),
  cand AS (SELECT date, index_code, method, score, {flag} AS ok FROM raw LEFT JOIN metric USING (date, index_code)),
  pass AS ({passing}), best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY method, "window", level, date ORDER BY ROUND(score, 10) DESC, index_code) AS k FROM pass) WHERE k = 1),
  pl AS (SELECT method, "window", level, date, {plan}, LAG(date) OVER w AS before FROM best WINDOW w AS (PARTITION BY method, "window", level ORDER BY date)),
  cell AS (SELECT method, "window", level, SUM(LN({step})) AS log_return, COUNT(*) AS n_days FROM pl LEFT JOIN idx a ON a.date = pl.date AND a.index_code = old LEFT JOIN idx b ON b.date = before AND b.index_code = old LEFT JOIN idx c ON c.date = pl.date AND c.index_code = now GROUP BY 1, 2, 3)"""


def _add_grid(kind: str, build: Callable[..., DataFrame], mode: str = "close", combined: bool = False) -> None:
    name = f"{'bias' if kind == 'bias' else 'volatility'}_grid{'_combined' * combined}{'_vwap' * (mode != 'close')}"

    @_query(f'WITH {_grid_sql(kind, mode, combined)} SELECT method, "window", level, ROUND(log_return, 6) + 0.0 AS log_return, n_days FROM cell', name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(build(spark, sf_dir, mode, combined).select("method", "window", "level", "log_return", "n_days"), "log_return")


for _combined in (False, True):
    for _mode in config.EXECUTION_MODES:
        _add_grid("bias", _bias_grid, _mode, _combined)
        _add_grid("vol", _vol_grid, _mode, _combined)


#: Days between the rebalancings of an account in the full grids.
GRID_STAGGER = {"bias": 5, "vol": 3}


def _sets_sql(kind: str, windows: tuple, levels: tuple, mode: str, days: int) -> str:
    """CTEs of a grid whose cells hold their top tenth, by staggered accounts; ends in ``cell``."""
    metric = _metric_sql(windows if kind == "bias" else (), windows if kind == "vol" else ())
    level = ", ".join(f"({x})" for x in levels)
    values = "[" + ", ".join(f"{kind}_{n}" for n in windows) + "]"
    window = ", ".join(f"({i}, {n})" for i, n in enumerate(windows, 1))
    tenth = "[1:CAST(GREATEST(1, CEIL(0.1 * len(e) - 1e-12)) AS INT)]"
    x = "SELECT method, date, \"window\", list_filter(list_transform(l, lambda c: {'place': c.place, 'code': c.code, 'v': c.m[w]}), lambda c: c.v IS NOT NULL) AS x FROM mem, wn"
    if kind == "bias":
        chosen = f"SELECT method, \"window\", level, date, e{tenth} AS codes FROM (SELECT method, \"window\", CAST(level AS DOUBLE) AS level, date, list_transform(list_filter(x, lambda c: c.v <= level + 1e-12), lambda c: c.code) AS e FROM wx, lv) WHERE len(e) > 0"
    else:
        order = "list_sort(list_transform(x, lambda c: {'v': -ROUND(c.v, 10), 'code': c.code, 'place': c.place}))"
        chosen = f"""SELECT method, "window", level, date, list_transform(e{tenth}, lambda c: c.code) AS codes FROM (SELECT method, "window", level, date, list_sort(list_transform(o[1:CAST(GREATEST(1, CEIL(len(o) * level - 1e-12)) AS INT)], lambda c: {{'place': c.place, 'code': c.code}})) AS e
  FROM (SELECT method, "window", CAST(level AS DOUBLE) AS level, date, o FROM (SELECT *, {order} AS o FROM wx), lv) WHERE len(o) > 0)"""
    later = 0 if mode == "close" else 1
    act = "date" if not later else "LEAD(date) OVER (ORDER BY date)"
    fill = "close" if not later else "CASE WHEN price_date = date THEN vwap ELSE close END"
    rounds, v = "", "v0"
    for k in range(1, 6):
        rounds += f", r{k} AS (SELECT *, v0 - {config.COST_RATE} * list_sum(list_transform(g, lambda c: abs(c.goal * {v} - c.p))) AS v{k} FROM {'legs' if k == 1 else f'r{k - 1}'})"
        v = f"v{k}"
    return f"""{TREND20}, {metric}, {CAL}, wn(w, "window") AS (VALUES {window}), lv(level) AS (VALUES {level}),
  cand AS (SELECT date, index_code, 'return_r2' AS method, return_r2 AS score FROM trend WHERE return_r2 IS NOT NULL UNION ALL SELECT date, index_code, 'return_vol', return_vol FROM trend WHERE return_vol IS NOT NULL),
  placed AS (SELECT method, date, index_code, ROW_NUMBER() OVER (PARTITION BY method, date ORDER BY ROUND(score, 10) DESC, index_code) AS place, {values} AS m FROM cand JOIN metric USING (date, index_code)),
  mem AS (SELECT method, date, list({{'place': place, 'code': index_code, 'm': m}} ORDER BY place) AS l FROM placed GROUP BY 1, 2), wx AS ({x}), sets AS ({chosen}),
  acts AS (SELECT * FROM (SELECT date AS signal, {act} AS date, CAST((pos - 1) % {days} AS INT) + 1 AS account FROM cal) WHERE date IS NOT NULL),
  plan AS MATERIALIZED (SELECT method, "window", level, account, acts.date, array_to_string(codes, '|') AS s, LAG(array_to_string(codes, '|')) OVER w AS old, LAG(acts.date) OVER w AS before, LEAD(acts.date) OVER w IS NULL AS final FROM sets JOIN acts ON acts.signal = sets.date WINDOW w AS (PARTITION BY method, "window", level, account ORDER BY acts.date)),
  moves AS (SELECT DISTINCT before, old, date, s FROM plan WHERE old IS NOT NULL),
  held AS (SELECT *, UNNEST(string_split(old, '|')) AS index_code, 1.0 / len(string_split(old, '|')) AS w FROM moves), wanted AS (SELECT *, UNNEST(string_split(s, '|')) AS index_code, 1.0 / len(string_split(s, '|')) AS w FROM moves),
  ends AS (SELECT *, (SELECT MAX(date) FROM cal) AS last, UNNEST(string_split(s, '|')) AS index_code, 1.0 / len(string_split(s, '|')) AS w FROM (SELECT DISTINCT date, s FROM plan WHERE final)),
  dense AS (SELECT cal.date, c.index_code, p.date AS price_date, p.close, p.vwap FROM (cal CROSS JOIN (SELECT DISTINCT index_code FROM idx) c) ASOF JOIN idx p ON p.index_code = c.index_code AND cal.date >= p.date), known AS (SELECT date, index_code, close, {fill} AS fill FROM dense),
  pieces AS (SELECT held.before, held.old, held.date, held.s, held.index_code, w * b.fill / a.fill AS p, 0.0 AS goal FROM held JOIN known a ON a.index_code = held.index_code AND a.date = before JOIN known b ON b.index_code = held.index_code AND b.date = held.date UNION ALL SELECT before, old, date, s, index_code, 0.0, w FROM wanted),
  legs AS (SELECT before, old, date, s, SUM(p) AS v0, list({{'p': p, 'goal': goal}}) AS g FROM (SELECT before, old, date, s, index_code, SUM(p) AS p, SUM(goal) AS goal FROM pieces GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4){rounds},
  worth AS (SELECT ends.date, s, LN(SUM(w * b.close / a.fill)) AS at_end FROM ends JOIN known a ON a.index_code = ends.index_code AND a.date = ends.date JOIN known b ON b.index_code = ends.index_code AND b.date = last GROUP BY 1, 2),
  acc AS (SELECT method, "window", level, account, SUM(CASE WHEN plan.old IS NULL THEN -LN(1 + {config.COST_RATE}) ELSE LN({v}) END + CASE WHEN final THEN at_end ELSE 0 END) AS x, COUNT(*) AS n FROM plan LEFT JOIN r5 ON r5.before = plan.before AND r5.old = plan.old AND r5.date = plan.date AND r5.s = plan.s LEFT JOIN worth ON worth.date = plan.date AND worth.s = plan.s GROUP BY 1, 2, 3, 4),
  tops AS (SELECT method, "window", level, CASE WHEN COUNT(*) < {days} THEN GREATEST(MAX(x), 0) ELSE MAX(x) END AS top FROM acc GROUP BY 1, 2, 3),
  cell AS (SELECT method, "window", level, MAX(top) + LN((SUM(EXP(x - top)) + ({days} - COUNT(*)) * EXP(-GREATEST(MAX(top), -700))) / {days}) AS log_return, CAST(SUM(n) AS BIGINT) AS n_rebalances FROM acc JOIN tops USING (method, "window", level) GROUP BY 1, 2, 3)"""


def _set_grid(spark: SparkSession, sf_dir: str, kind: str, windows: tuple, levels: tuple, mode: str, days: int) -> DataFrame:
    bars = panel.index_bars(spark, sf_dir)
    m = select.filter_metrics(bars, windows if kind == "bias" else (), windows if kind == "vol" else ())
    sets = (grid.bias_sets if kind == "bias" else grid.volatility_sets)(_candidates(spark, sf_dir), m, windows, levels)
    return grid.staggered_returns(sets, _calendar(spark, sf_dir), bars, ["method", "window", "level"], days, mode)


def _add_set_grid(name: str, kind: str, windows: tuple, levels: tuple, mode: str, days: int) -> None:
    @_query(f'WITH {_sets_sql(kind, windows, levels, mode, days)} SELECT method, "window", level, ROUND(log_return, 6) + 0.0 AS log_return, n_rebalances FROM cell', name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round(_set_grid(spark, sf_dir, kind, windows, levels, mode, days).select("method", "window", "level", "log_return", "n_rebalances"), "log_return")


# Every level with every sixth window, the top tenth held by staggered accounts, in one fill mode each; the other mode on axes of a few levels.
_add_set_grid("bias_grid_levels", "bias", config.BIAS_WINDOWS[4::6], config.BIAS_UPPERS, "close", GRID_STAGGER["bias"])
_add_set_grid("volatility_grid_levels", "vol", config.VOL_WINDOWS[4::6], config.VOL_KEEP_RATIOS, "next_day_vwap", GRID_STAGGER["vol"])
_add_set_grid("bias_grid_staggered_vwap", "bias", *GRID_BIAS, "next_day_vwap", 10)
_add_set_grid("volatility_grid_staggered", "vol", *GRID_VOL, "close", 7)


@_query(f"WITH {_grid_sql('vol')} SELECT method, level, " + ", ".join(f'ROUND(MAX(CASE WHEN "window" = {n} THEN log_return END), 6) + 0.0 AS w{n}' for n in GRID_VOL[0]) + " FROM cell GROUP BY 1, 2")
def heatmap_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = grid.heatmap(_vol_grid(spark, sf_dir), GRID_VOL[0], "log_return")
    return _round(wide, *[f"w{n}" for n in GRID_VOL[0]])


def _values(name: str, values) -> str:
    return f"(VALUES {', '.join(f'({v!r})' for v in values)}) {name[0]}_({name})"


_CASES = f"SELECT * FROM {_values('update_frequency', config.UPDATE_FREQUENCIES)}, {_values('filter_profile', config.FILTER_PROFILES)}, (SELECT CAST(correlation_threshold AS DOUBLE) AS correlation_threshold FROM {_values('correlation_threshold', config.CORRELATION_THRESHOLDS)}), {_values('trend_window', config.TREND_WINDOWS)}"
_FULL = f"WITH c AS ({_CASES}), s AS (SELECT CAST(range AS INT) AS stagger_days FROM range(1, 11))"


@_query(f"{_FULL} SELECT update_frequency, filter_profile, correlation_threshold, trend_factor, trend_window, stagger_days FROM c, s, {_values('trend_factor', config.TREND_FACTORS)}")
def experiment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.experiment_matrix(spark)


_TUNING = f"{_FULL}, t AS (SELECT tuning_type, update_frequency, filter_profile, correlation_threshold, trend_window, stagger_days, CASE tuning_type WHEN 'bias' THEN 59 * 31 * 4 ELSE 59 * 20 * 4 END AS simulations FROM (VALUES ('bias'), ('volatility')) k(tuning_type), c, s WHERE filter_profile = 'bias_and_volatility' OR filter_profile = tuning_type || '_only')"


@_query(f"{_TUNING} SELECT tuning_type, update_frequency, filter_profile, correlation_threshold, trend_window, stagger_days, CAST(simulations AS BIGINT) AS simulations FROM t")
def tuning_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tuning_matrix(spark)


@_query(f"{_TUNING} SELECT tuning_type, filter_profile, COUNT(*) AS n_cases, CAST(SUM(simulations) AS BIGINT) AS simulations FROM t GROUP BY 1, 2")
def tuning_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tuning_matrix(spark).groupBy("tuning_type", "filter_profile").agg(F.count("*").alias("n_cases"), F.sum("simulations").alias("simulations"))


@_query(f"WITH c AS ({_CASES}) SELECT DISTINCT 'factor' AS kind, update_frequency, correlation_threshold, trend_window FROM c UNION ALL SELECT DISTINCT 'price', update_frequency, correlation_threshold, NULL FROM c")
def distinct_input_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.input_keys(grid.experiment_matrix(spark))


@_query(f"""WITH f AS (SELECT * FROM (VALUES ('daily', 1), ('monthly', 2)) f(update_frequency, fo)), t AS (SELECT CAST(x AS DOUBLE) AS correlation_threshold FROM (VALUES (0.7), (0.8), (0.9)) t(x)), w AS (SELECT * FROM (VALUES (10), (15), (20), (40), (60)) w(trend_window)),
  p AS (SELECT 1 AS so, 'etf_selection' AS stage, update_frequency, fo, CAST(NULL AS DOUBLE) AS correlation_threshold, CAST(NULL AS INT) AS trend_window FROM f UNION ALL SELECT 2, 'index_return', update_frequency, fo, NULL, NULL FROM f UNION ALL SELECT 3, 'index_cluster', update_frequency, fo, correlation_threshold, NULL FROM f, t UNION ALL SELECT 4, 'trend_price', update_frequency, fo, correlation_threshold, NULL FROM f, t UNION ALL SELECT 5, 'trend_factor', update_frequency, fo, correlation_threshold, trend_window FROM f, t, w)
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY so, fo, correlation_threshold, trend_window) AS INT) AS position, stage, update_frequency, correlation_threshold, trend_window FROM p""")
def preparation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.preparation_plan(spark)


@_query("SELECT CAST(ts AS DATE) AS date, event_type, COUNT(*) AS n_events, ROUND(SUM(value), 4) AS value_sum, ROUND(AVG(value), 6) AS value_avg FROM events GROUP BY 1, 2")
def event_daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_round(stream_bars.daily_event_bars(panel.table(spark, sf_dir, "events")), "value_sum", digits=4), "value_avg")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""Dimensions of the experiments, their validation, and the paths of their outputs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import product
from pathlib import PurePosixPath

UPDATE_FREQUENCIES = ("daily", "monthly")
FILTER_PROFILES = {
    "base": ("none", False),
    "bias_only": ("upper", False),
    "volatility_only": ("none", True),
    "bias_and_volatility": ("upper", True),
}
CORRELATION_THRESHOLDS = (0.7, 0.8, 0.9)
TREND_FACTORS = ("return_r2", "return_vol")
TREND_WINDOWS = (10, 15, 20, 40, 60)
STAGGER_DAYS = tuple(range(1, 11))
EXECUTION_MODES = ("close", "next_day_vwap")
TUNING_TYPES = {"bias": ("bias_only", "bias_and_volatility"), "volatility": ("volatility_only", "bias_and_volatility")}
BIAS_WINDOWS = tuple(range(2, 61))
BIAS_UPPERS = tuple(round(0.01 * i, 2) for i in range(31))
VOL_WINDOWS = tuple(range(2, 61))
VOL_KEEP_RATIOS = tuple(round(0.05 * i, 2) for i in range(1, 21))
FACTOR_YEARS = tuple(range(2021, 2027))

BIAS_WINDOW, BIAS_UPPER, VOL_WINDOW, VOL_KEEP = 36, 0.09, 18, 0.55
TOP_FRACTION = 0.1
COST_RATE = 0.001
TURNOVER_DATES = 20
PANEL_CLOSES = 61
STALE_DAYS = 7
DAYS_A_YEAR = 252
TOLERANCE = 1e-12
STAGES = ("etf_selection", "index_return", "index_cluster", "trend_price", "trend_factor")


@dataclass(frozen=True)
class ExperimentCase:
    update_frequency: str
    filter_profile: str
    correlation_threshold: float
    trend_factor: str
    trend_window: int
    stagger_days: int


@dataclass(frozen=True)
class TuningCase:
    tuning_type: str
    update_frequency: str
    filter_profile: str
    correlation_threshold: float
    trend_window: int
    stagger_days: int


@dataclass(frozen=True)
class PreparationTask:
    stage: str
    update_frequency: str
    correlation_threshold: float | None = None
    trend_window: int | None = None


#: Allowed values by the name of the dimension.
ALLOWED: dict[str, Sequence] = {
    "update_frequency": UPDATE_FREQUENCIES,
    "filter_profile": tuple(FILTER_PROFILES),
    "correlation_threshold": CORRELATION_THRESHOLDS,
    "trend_factor": TREND_FACTORS,
    "trend_window": TREND_WINDOWS,
    "stagger_days": STAGGER_DAYS,
    "tuning_type": tuple(TUNING_TYPES),
    "execution_mode": EXECUTION_MODES,
    "stage": STAGES,
}


def validate(**dimensions) -> None:
    """Raise ValueError, before any I/O, for a value outside its dimension or a tuning type that the profile does not use."""
    for name, value in dimensions.items():
        if name not in ALLOWED:
            raise ValueError(f"unknown dimension {name}")
        if isinstance(value, bool) or value not in ALLOWED[name]:
            raise ValueError(f"{name} must be one of {ALLOWED[name]}, not {value!r}")
    if {"tuning_type", "filter_profile"} <= set(dimensions) and dimensions["filter_profile"] not in TUNING_TYPES[dimensions["tuning_type"]]:
        raise ValueError(f"{dimensions['tuning_type']} tuning does not go with {dimensions['filter_profile']}")


def validate_grid(windows: Sequence[int], levels: Sequence[float]) -> None:
    for axis in (windows, levels):
        if not axis or len(set(axis)) != len(axis) or list(axis) != sorted(axis):
            raise ValueError("a grid axis must have rising values")
    if min(windows) < 2:
        raise ValueError("windows need two days at least")


def experiment_cases() -> list[ExperimentCase]:
    return [ExperimentCase(*x) for x in product(UPDATE_FREQUENCIES, FILTER_PROFILES, CORRELATION_THRESHOLDS, TREND_FACTORS, TREND_WINDOWS, STAGGER_DAYS)]


def tuning_cases() -> list[TuningCase]:
    return [
        TuningCase(kind, frequency, profile, threshold, window, stagger)
        for kind, profiles in TUNING_TYPES.items()
        for frequency, profile, threshold, window, stagger in product(UPDATE_FREQUENCIES, profiles, CORRELATION_THRESHOLDS, TREND_WINDOWS, STAGGER_DAYS)
    ]


def preparation_tasks() -> list[PreparationTask]:
    """Tasks in dependency order."""
    pairs = list(product(UPDATE_FREQUENCIES, CORRELATION_THRESHOLDS))
    return [
        *(PreparationTask(s, f) for s in STAGES[:2] for f in UPDATE_FREQUENCIES),
        *(PreparationTask(s, f, t) for s in STAGES[2:4] for f, t in pairs),
        *(PreparationTask(STAGES[4], f, t, w) for f, t in pairs for w in TREND_WINDOWS),
    ]


def select_cases(cases: Iterable[TuningCase], **choices: Sequence) -> list[TuningCase]:
    """Cases whose every named dimension is among the chosen values, in their order."""
    chosen = {k: tuple(v) for k, v in choices.items() if v is not None}
    for name, values in chosen.items():
        for value in values:
            validate(**{name: value})
    return [c for c in cases if all(getattr(c, k) in v for k, v in chosen.items())]


def grid_cells(tuning_type: str) -> int:
    return len(BIAS_WINDOWS) * len(BIAS_UPPERS) if tuning_type == "bias" else len(VOL_WINDOWS) * len(VOL_KEEP_RATIOS)


def simulation_count(cases: Iterable[TuningCase]) -> int:
    return sum(grid_cells(c.tuning_type) * len(TREND_FACTORS) * len(EXECUTION_MODES) for c in cases)


# One canonical folder for each tuple of dimensions.


def _under(root: str, *parts: str) -> str:
    return str(PurePosixPath(root, *parts))


def pool_dir(root: str, frequency: str, kind: str = "initial") -> str:
    validate(update_frequency=frequency)
    return _under(root, "etf_pool", frequency, kind)


def cluster_dir(root: str, frequency: str, threshold: float) -> str:
    validate(update_frequency=frequency, correlation_threshold=threshold)
    return _under(root, "etf_pool", frequency, "clusters", str(threshold))


def price_dir(root: str, frequency: str, threshold: float) -> str:
    validate(update_frequency=frequency, correlation_threshold=threshold)
    return _under(root, "trend", frequency, str(threshold), "prices")


def factor_dir(root: str, frequency: str, threshold: float, window: int) -> str:
    validate(update_frequency=frequency, correlation_threshold=threshold, trend_window=window)
    return _under(root, "trend", frequency, str(threshold), "factors", str(window))


def backtest_dir(root: str, case: ExperimentCase, mode: str) -> str:
    validate(**vars(case), execution_mode=mode)
    return _under(root, "backtest", case.update_frequency, case.filter_profile, str(case.correlation_threshold), case.trend_factor, str(case.trend_window), f"staggered_{case.stagger_days}d", mode)


def tuning_dir(root: str, case: TuningCase) -> str:
    validate(**vars(case))
    return _under(root, "tuning", case.tuning_type, case.update_frequency, case.filter_profile, str(case.correlation_threshold), str(case.trend_window), f"staggered_{case.stagger_days}d")

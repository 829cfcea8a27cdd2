"""Resumable runs of cases: preflight, markers, completeness, command line."""

from __future__ import annotations

import argparse
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from panelloom import config

MARKER = ".incomplete"
WORKBOOKS = ("annual_metrics", "backtest_metrics", "holdings", "time_series", "account_details")
CURVES = ("nav", "excess", "turnover", "cost", "capacity")


@dataclass(frozen=True)
class RunSummary:
    total: int
    executed: int
    skipped: int


class CaseFailed(RuntimeError):
    """A case failed; the cause is chained, later cases did not run."""


def expected_outputs(folder: Path, kind: str = "backtest") -> list[Path]:
    """Ten tables of each fill mode, or the four matrices of a tuning case."""
    if kind == "backtest":
        return [folder / mode / name for mode in config.EXECUTION_MODES for name in (*WORKBOOKS, *CURVES)]
    return [folder / f"{factor}_{mode}_total_return" for factor in config.TREND_FACTORS for mode in config.EXECUTION_MODES]


def _filled(path: Path) -> bool:
    if path.is_dir():  # a table that its job committed
        return (path / "_SUCCESS").exists() and any(p.stat().st_size for p in path.glob("part-*"))
    return path.is_file() and path.stat().st_size > 0


def incomplete_outputs(folder: Path, kind: str = "backtest") -> list[Path]:
    return [p for p in expected_outputs(folder, kind) if not _filled(p)]


def is_complete(folder: Path, kind: str = "backtest") -> bool:
    return not (folder / MARKER).exists() and not incomplete_outputs(folder, kind)


def find_missing(paths: Iterable[Path]) -> list[Path]:
    """Inputs that are absent or empty, each once, in order."""
    return [p for p in dict.fromkeys(paths) if not (p.exists() and (_filled(p) or (p.is_dir() and any(p.iterdir()))))]


def validate_plan(cases: Sequence[Any]) -> None:
    if not cases:
        raise ValueError("no cases")
    if twice := [c for c, n in Counter(cases).items() if n > 1]:
        raise ValueError(f"repeated cases: {twice[:3]}")
    for case in cases:
        config.validate(**{k: v for k, v in vars(case).items() if v is not None})
    if isinstance(cases[0], config.PreparationTask):
        order = [config.STAGES.index(c.stage) for c in cases]
        if order != sorted(order):
            raise ValueError("tasks are out of order")


def run_cases(cases: Sequence[Any], folder_of: Callable[[Any], Path], run: Callable[[Any], None], kind: str = "backtest", force: bool = False, inputs_of: Callable[[Any], Iterable[Path]] | None = None) -> RunSummary:
    """Run what is not complete, in order.

    The plan is validated first; then the inputs of all pending cases are looked for
    and reported together. A marker stands while a case runs and stays if it fails or
    leaves outputs out, so the next run takes the case up again. The first failure
    ends the run; an interrupt is passed on."""
    validate_plan(cases)
    todo = [c for c in cases if force or not is_complete(folder_of(c), kind)]
    if inputs_of and (missing := find_missing(p for c in todo for p in inputs_of(c))):
        raise FileNotFoundError("missing inputs: " + ", ".join(map(str, missing)))
    for i, case in enumerate(todo, 1):
        folder = folder_of(case)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / MARKER).touch()
        try:
            run(case)
            if left := incomplete_outputs(folder, kind):
                raise RuntimeError(f"outputs are missing: {', '.join(p.name for p in left)}")
        except Exception as e:
            raise CaseFailed(f"case {i}/{len(todo)} failed: {case}") from e
        (folder / MARKER).unlink()
    return RunSummary(len(cases), len(todo), len(cases) - len(todo))


def parse(args: Sequence[str]) -> argparse.Namespace:
    """--all or selectors show the chosen cases; --execute runs them; --force, with it, runs complete ones again."""
    p = argparse.ArgumentParser(prog="tune", allow_abbrev=False, description=parse.__doc__)
    once = {"action": "append"}
    p.add_argument("--all", action="store_true")
    p.add_argument("--execute", action="store_true")
    p.add_argument("--force", action="store_true")
    for flag, kind in (("tuning-type", str), ("update-frequency", str), ("filter-profile", str), ("correlation-threshold", float), ("trend-window", int), ("stagger-days", int)):
        p.add_argument(f"--{flag}", type=kind, **once)
    n = p.parse_args(list(args))
    chosen = {k: v for k, v in vars(n).items() if k not in ("all", "execute", "force") and v is not None}
    if any(len(v) > 1 for v in chosen.values()):
        p.error("one value for each selector")
    if n.all and chosen:
        p.error("--all goes without selectors")
    if n.execute and not (n.all or chosen):
        p.error("--execute needs --all or selectors")
    if n.force and not n.execute:
        p.error("--force needs --execute")
    if {"tuning_type", "filter_profile"} <= set(chosen) and chosen["filter_profile"][0] not in config.TUNING_TYPES.get(chosen["tuning_type"][0], ()):
        p.error("tuning type and profile do not go together")
    n.chosen = chosen
    return n


def cli(args: Sequence[str], runner: Callable[[list, bool], RunSummary]) -> str:
    """Help, a preview, or the summary of a run."""
    n = parse(args)
    if not (n.all or n.chosen):
        return "nothing chosen: use --all or selectors, and --execute to run"
    try:
        cases = config.select_cases(config.tuning_cases(), **n.chosen)
    except ValueError as e:
        raise SystemExit(2) from e
    if not n.execute:
        return f"{len(cases)} cases, {config.simulation_count(cases)} simulations"
    done = runner(cases, n.force)
    return f"{done.total} cases, {done.executed} run, {done.skipped} skipped"

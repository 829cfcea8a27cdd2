"""Matrices, validation, paths, the resumable runner and its command line."""

from collections import Counter
from pathlib import Path

import pytest

from panelloom import config
from panelloom.plans import runner


def test_matrices_have_their_sizes_and_no_repeats():
    assert len(set(config.experiment_cases())) == 2400
    tuning = config.tuning_cases()
    assert len(set(tuning)) == 1200
    assert Counter(c.filter_profile for c in tuning) == {"bias_only": 300, "volatility_only": 300, "bias_and_volatility": 600}
    assert config.simulation_count(tuning) == 7_221_600
    tasks = config.preparation_tasks()
    assert len(set(tasks)) == 46
    assert Counter(t.stage for t in tasks) == {"etf_selection": 2, "index_return": 2, "index_cluster": 6, "trend_price": 6, "trend_factor": 30}


@pytest.mark.parametrize("bad", [{"update_frequency": "weekly"}, {"correlation_threshold": 0.75}, {"trend_window": 30}, {"stagger_days": 0}, {"stagger_days": True}, {"filter_profile": "x"}, {"tuning_type": "bias", "filter_profile": "volatility_only"}])
def test_invalid_dimensions(bad):
    with pytest.raises(ValueError):
        config.validate(**bad)


def test_selectors_keep_the_order():
    cases = config.tuning_cases()
    some = config.select_cases(cases, tuning_types=None, tuning_type=["bias"], stagger_days=[3])
    assert len(some) == 60
    assert some == [c for c in cases if c.tuning_type == "bias" and c.stagger_days == 3]


def test_paths_differ_for_every_case():
    cases = config.experiment_cases()
    paths = {config.backtest_dir("/r", c, m) for c in cases for m in config.EXECUTION_MODES}
    assert len(paths) == 4800
    assert config.backtest_dir("/r", cases[0], "close").endswith("0.7/return_r2/10/staggered_1d/close")
    assert len({config.tuning_dir("/r", c) for c in config.tuning_cases()}) == 1200


def test_grid_axes():
    config.validate_grid(config.BIAS_WINDOWS, config.BIAS_UPPERS)
    with pytest.raises(ValueError):
        config.validate_grid((3, 2), (0.1,))
    with pytest.raises(ValueError):
        config.validate_grid((), (0.1,))


def _outputs(folder: Path, kind: str) -> None:
    for p in runner.expected_outputs(folder, kind):
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")


def test_runner_skips_complete_and_retries_failed(tmp_path):
    cases = config.tuning_cases()[:3]
    folder = lambda c: tmp_path / config.tuning_dir(".", c)
    ran = []

    def run(case):
        ran.append(case)
        if case == cases[1] and ran.count(case) == 1:
            raise ValueError("no")
        _outputs(folder(case), "tuning")

    with pytest.raises(runner.CaseFailed, match="2/3") as e:
        runner.run_cases(cases, folder, run, "tuning")
    assert isinstance(e.value.__cause__, ValueError)
    assert (folder(cases[1]) / runner.MARKER).exists() and cases[2] not in ran
    assert runner.run_cases(cases, folder, run, "tuning") == runner.RunSummary(3, 2, 1)
    assert runner.run_cases(cases, folder, run, "tuning") == runner.RunSummary(3, 0, 3)
    assert runner.run_cases(cases, folder, run, "tuning", force=True).executed == 3


def test_runner_notices_missing_outputs_and_passes_interrupts(tmp_path):
    case = config.tuning_cases()[0]
    with pytest.raises(runner.CaseFailed):
        runner.run_cases([case], lambda c: tmp_path / "a", lambda c: None, "tuning")

    def stop(_):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        runner.run_cases([case], lambda c: tmp_path / "b", stop, "tuning")
    assert (tmp_path / "b" / runner.MARKER).exists()


def test_inputs_are_reported_together_before_the_first_case(tmp_path):
    with pytest.raises(FileNotFoundError) as e:
        runner.run_cases(config.tuning_cases()[:2], lambda c: tmp_path / str(c.stagger_days), lambda c: pytest.fail("ran"), "tuning", inputs_of=lambda c: [tmp_path / "bars", tmp_path / f"p{c.stagger_days}"])
    assert all(x in str(e.value) for x in ("bars", "p1", "p2")) and str(e.value).count("bars") == 1


def test_backtest_outputs():
    assert len(runner.expected_outputs(Path("x"))) == 20
    assert len(runner.expected_outputs(Path("x"), "tuning")) == 4


@pytest.mark.parametrize("plan", [[], [config.tuning_cases()[0]] * 2, list(reversed(config.preparation_tasks()))])
def test_bad_plans(plan):
    with pytest.raises(ValueError):
        runner.validate_plan(plan)


@pytest.mark.parametrize("args", [["--execute"], ["--all", "--tuning-type", "bias"], ["--force", "--all"], ["--stagger-days", "1", "--stagger-days", "2"], ["--tuning-type", "bias", "--filter-profile", "volatility_only"], ["--exec", "--all"], ["--trend-window", "11"]])
def test_unsafe_commands(args):
    with pytest.raises(SystemExit):
        runner.cli(args, lambda *_: pytest.fail("ran"))


def test_preview_and_execution():
    assert "nothing chosen" in runner.cli([], lambda *_: pytest.fail("ran"))
    assert runner.cli(["--all"], lambda *_: pytest.fail("ran")).startswith("1200 cases, 7221600")
    seen = []
    runner.cli(["--stagger-days", "2", "--execute", "--force"], lambda cases, force: seen.append((len(cases), force)) or runner.RunSummary(1, 1, 0))
    assert seen == [(120, True)]

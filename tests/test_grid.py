"""A grid of runs: what is done isn't done again, what is shared is built once."""

from __future__ import annotations

import pytest
from test_patterns_plans import machine_log

from faultline.params import Horizon, parameter_grid
from faultline.plans import grid, prediction

OPTIONS = {"sampling_seconds": [60], "horizon": [Horizon(3600, 3600)], "folds": [3], "classifier": ["svm_linear", "logistic"]}


def test_runs_are_keyed_by_all_parameters(spark):
    runs = list(parameter_grid({"target_code": [1, 2], "seeds": [(1,), (2,)], "horizon": [Horizon(1, 2), Horizon(3, 4)]}))
    table = grid.runs_table(spark, [*runs, runs[0]], "log")
    assert table.count() == table.select("run").distinct().count() == 8 and {r["pw"] for r in table.collect()} == {1, 3}
    assert grid.run_key(runs[0], "log") != grid.run_key(runs[0], "other") and grid.pending(table, None).count() == 8
    assert grid.pending(table, table.filter("pw = 1").unionByName(table.filter("pw = 1"))).count() == 4
    with pytest.raises(ValueError):
        grid.runs_table(spark, [])


def test_a_stopped_grid_goes_on(spark, tmp_path, monkeypatch):
    frame, built, evaluated = machine_log(spark), [], []
    real_cleanse, real_matrix, real_evaluated = prediction.cleanse, prediction.matrix, prediction.evaluated
    monkeypatch.setattr(prediction, "cleanse", lambda *a: built.append("cleansed") or real_cleanse(*a))
    monkeypatch.setattr(prediction, "matrix", lambda *a: built.append("matrix") or real_matrix(*a))

    def stopping(rows, p):
        if p.classifier == "logistic" and not evaluated.count("logistic"):
            evaluated.append("logistic")
            raise KeyboardInterrupt
        evaluated.append(p.classifier)
        return real_evaluated(rows, p)

    monkeypatch.setattr(prediction, "evaluated", stopping)
    with pytest.raises(KeyboardInterrupt):
        grid.run_grid(frame, OPTIONS, str(tmp_path), "log")
    first = grid.stored_results(spark, f"{tmp_path}/results")
    assert [r["classifier"] for r in first.collect()] == ["svm_linear"]
    done = grid.run_grid(frame, OPTIONS, str(tmp_path), "log")
    assert sorted(r["classifier"] for r in done.collect()) == ["logistic", "svm_linear"] and all(r["accuracy_mean"] > 0.6 for r in done.collect())
    assert built == ["cleansed", "matrix"] and evaluated == ["svm_linear", "logistic", "logistic"]
    again = grid.run_grid(frame, OPTIONS, str(tmp_path), "log")
    assert again.count() == 2 and len(evaluated) == 3
    with pytest.raises(ValueError):
        grid.run_grid(frame, {"store_examples": [True]}, str(tmp_path), "log")

"""Parameters of the jobs; every option is an explicit argument, no global state."""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

# The numeric codes and markers found in the machine logs.
OK_CODE = -2147483648      # error code that means "no error"
EXTREME_MARKER = -1e40     # number that means "value missing"
NEGATIVE_LABEL = -1        # class label of every code that is not the target


@dataclasses.dataclass(frozen=True)
class Horizon:
    """Prediction window (gap before the error) and reading window (data used), in seconds."""

    pw: int = 3600
    rw: int = 3600

    @property
    def reach(self) -> int:
        return self.pw + self.rw


@dataclasses.dataclass(frozen=True)
class PredictionParams:
    """One run of the failure-prediction job.

    ``minimal_features`` off adds the extended features of the catalogue. ``stored_per_iteration`` bounds how many examples of a
    class a run adds to the store for each horizon, ``stored_iterations`` times as many negatives; None means all.
    ``classifier_options`` go to the classifier, as ("landmarks", 256). With an ``ensemble``, a vote of these
    classifiers (``voting`` hard or soft) on draws by ``ensemble_seeds`` is evaluated as well.
    """

    target_col: str = "components.cont.conditions.logic.errorCode"
    target_code: int = 351
    sampling_seconds: int = 30
    string_fill: str = "pad"
    numeric_fill: str = "pad"
    replace_extreme: bool = True
    horizon: Horizon = Horizon()
    stored_horizons: tuple[Horizon, ...] = (Horizon(),)
    minimal_features: bool = True
    store_examples: bool = False
    stored_per_iteration: int | None = None
    stored_iterations: int = 1
    scaler: str = "standard"
    fit_scaler_per_fold: bool = False
    balance_ratio: float = 0.5
    sampling_percentage: float = 0.5
    seeds: tuple[int, ...] = (100,)
    folds: int = 5
    oversampling: str | None = None
    evaluate_all_data: bool = False
    classifier: str = "random_forest"
    classifier_options: tuple[tuple[str, Any], ...] = ()
    voting: str = "hard"
    ensemble: tuple[str, ...] = ()
    ensemble_seeds: tuple[int, ...] = (0, 1, 2)


@dataclasses.dataclass(frozen=True)
class MiningParams:
    """One run of the error-pattern job."""

    target_col: str = "components.cont.conditions.logic.errorCode"
    min_gap: int = 1000
    min_obs: int = 10
    window_len: int = 1000
    cross_component: bool = True
    support: float = 0.5
    confidence: float = 0.5


def parameter_grid(options: Mapping[str, Sequence[Any]], kind: type = PredictionParams) -> Iterator[Any]:
    """One parameter object for every combination of the listed options."""
    names = list(options)
    unknown = set(names) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    for values in itertools.product(*(options[n] for n in names)):
        yield kind(**dict(zip(names, values)))

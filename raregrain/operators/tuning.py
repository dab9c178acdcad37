"""Grid and random search with cross-validation, best-parameter report."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, TrainValidationSplit, TrainValidationSplitModel
from pyspark.sql import DataFrame, SparkSession

from raregrain.operators.classifiers import evaluator

#: Parameter name to the values it may take.
Space = Mapping[str, Sequence[object]]


def param_grid(estimator: Estimator, space: Space) -> list[dict]:
    """Every combination of the space, as parameter maps."""
    params = [estimator.getParam(name) for name in space]
    return [dict(zip(params, values)) for values in itertools.product(*space.values())]


def random_params(estimator: Estimator, space: Space, draws: int, seed: int = 42) -> list[dict]:
    """``draws`` distinct random points of a discrete space (all of it, if it is smaller).

    Points are drawn by number, so a space of any size is never enumerated.
    """
    sizes = [len(values) for values in space.values()]
    points = 1
    for size in sizes:
        points *= size
    chosen = random.Random(seed).sample(range(points), min(draws, points))
    params = [estimator.getParam(name) for name in space]
    maps = []
    for number in chosen:
        values = []
        for options in space.values():
            number, i = divmod(number, len(options))
            values.append(options[i])
        maps.append(dict(zip(params, values)))
    return maps


@dataclass(frozen=True)
class Between:
    """A range of values, evenly spread, or evenly in their logarithms; whole numbers by rounding (halves up)."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def __post_init__(self) -> None:
        if not self.low <= self.high or (self.log and self.low <= 0):
            raise ValueError(f"no range from {self.low} to {self.high}")

    def at(self, part: float) -> float | int:
        """Value at a part (0 to 1) of the range."""
        value = self.low * (self.high / self.low) ** part if self.log else self.low + (self.high - self.low) * part
        return math.floor(value + 0.5) if self.whole else value


def spread_points(space: Mapping[str, Between | Sequence[object]], draws: int, seed: int = 42) -> list[dict[str, object]]:
    """``draws`` points that fill a space of ranges and lists evenly, whatever their number.

    Coordinate j of point i is ``(start_j + i * step_j) mod 2**32`` in parts of 2**32, with steps of the inverse powers of the root
    of ``x**(d + 1) = x + 1`` for d dimensions, whose sequence has low discrepancy, and starts made of the first 32 bits
    of ``md5("<seed>:<j>")``. A list is cut in equal parts.
    """
    root = 2.0
    for _ in range(64):
        root = (1 + root) ** (1 / (len(space) + 1))
    points = []
    for i in range(1, draws + 1):
        point = {}
        for j, (name, options) in enumerate(space.items(), 1):
            step = math.floor(2**32 / root**j)
            start = int(hashlib.md5(f"{seed}:{j}".encode()).hexdigest()[:8], 16)
            part = (start + i * step) % 2**32 / 2**32
            point[name] = options.at(part) if isinstance(options, Between) else options[math.floor(part * len(options))]
        points.append(point)
    return points


def spread_params(estimator: Estimator, space: Mapping[str, Between | Sequence[object]], draws: int, seed: int = 42) -> list[dict]:
    """The points of :func:`spread_points` as parameter maps."""
    return [{estimator.getParam(name): value for name, value in point.items()} for point in spread_points(space, draws, seed)]


def cross_validate(
    df: DataFrame,
    estimator: Estimator,
    maps: Sequence[dict],
    label: str = "binds",
    metric: str = "areaUnderPR",
    folds: int = 5,
    seed: int = 42,
    parallelism: int = 4,
    fold_col: str | None = None,
) -> CrossValidatorModel:
    """k-fold cross-validation; ``fold_col`` takes stratified folds made beforehand."""
    extra = {} if fold_col is None else {"foldCol": fold_col}
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=list(maps), evaluator=evaluator(metric, label),
        numFolds=folds, seed=seed, parallelism=parallelism, **extra,
    ).fit(df)


def grid_search(df: DataFrame, estimator: Estimator, space: Space, **options: object) -> CrossValidatorModel:
    """Cross-validation over the full grid."""
    return cross_validate(df, estimator, param_grid(estimator, space), **options)


def random_search(
    df: DataFrame, estimator: Estimator, space: Space, draws: int = 100, seed: int = 42, **options: object
) -> CrossValidatorModel:
    """Cross-validation over random points of the space."""
    return cross_validate(df, estimator, random_params(estimator, space, draws, seed), seed=seed, **options)


def holdout_search(
    df: DataFrame, estimator: Estimator, space: Space, draws: int = 8, train: float = 0.85,
    label: str = "binds", metric: str = "areaUnderPR", seed: int = 42, parallelism: int = 4,
) -> TrainValidationSplitModel:
    """Random points judged on one held-out part."""
    return TrainValidationSplit(
        estimator=estimator, estimatorParamMaps=random_params(estimator, space, draws, seed),
        evaluator=evaluator(metric, label), trainRatio=train, seed=seed, parallelism=parallelism,
    ).fit(df)


def range_search(
    df: DataFrame, estimator: Estimator, space: Mapping[str, Between | Sequence[object]], draws: int = 8, train: float = 0.85,
    label: str = "binds", metric: str = "areaUnderPR", seed: int = 42, parallelism: int = 4,
) -> TrainValidationSplitModel:
    """Evenly spread points of a space with continuous ranges, judged on one held-out part."""
    return TrainValidationSplit(
        estimator=estimator, estimatorParamMaps=spread_params(estimator, space, draws, seed),
        evaluator=evaluator(metric, label), trainRatio=train, seed=seed, parallelism=parallelism,
    ).fit(df)


def search_results(spark: SparkSession, model: CrossValidatorModel | TrainValidationSplitModel) -> DataFrame:
    """``point, params, metric`` of every point tried."""
    metrics = model.avgMetrics if isinstance(model, CrossValidatorModel) else model.validationMetrics
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)), float(metric))
        for i, (m, metric) in enumerate(zip(model.getEstimatorParamMaps(), metrics))
    ]
    return spark.createDataFrame(rows, "point int, params string, metric double")


def best_params(spark: SparkSession, model: Model) -> DataFrame:
    """``param, value`` of a fitted model, or of the best model of a search."""
    best = getattr(model, "bestModel", model)
    rows = sorted((p.name, str(v)) for p, v in best.extractParamMap().items())
    return spark.createDataFrame(rows, "param string, value string")

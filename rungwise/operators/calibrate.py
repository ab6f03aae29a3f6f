"""Event-balanced Platt and beta calibration by distributed damped Newton steps.

Training rows are compressed to one weighted row per distinct (horizon, p, label). Each Newton
iteration is one Spark aggregate that returns objective, gradient and Hessian of every
(horizon, method) model together with the objectives of the shorter steps the line search may
need; the driver only solves 2x2 and 3x3 systems.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungwise.functions.numeric import (
    beta_features,
    clipped,
    is_finite,
    platt_features,
    sigmoid,
    softplus,
)

FEATURES = {"platt": platt_features, "beta": beta_features}
ARMIJO = 1e-4
MAX_HALVINGS = 40
SCALES_PER_JOB = 4


class ConvergenceError(RuntimeError):
    """The Newton procedure did not reach the gradient tolerance."""


@dataclass(frozen=True)
class Settings:
    epsilon: float = 1e-6
    l2: float = 1e-3
    tolerance: float = 1e-9
    max_iterations: int = 100

    def __post_init__(self) -> None:
        if not 0.0 < self.epsilon < 0.5:
            raise ValueError("epsilon is a number between 0 and 0.5")
        for name in ("l2", "tolerance"):
            value = getattr(self, name)
            if not math.isfinite(value) or value <= 0.0:
                raise ValueError(f"{name} has to be a positive finite number")
        if isinstance(self.max_iterations, bool) or self.max_iterations < 0:
            raise ValueError("max_iterations is a whole number, zero or more")


@dataclass(frozen=True)
class Model:
    horizon_seconds: int
    method: str
    intercept: float
    coefficients: tuple[float, ...]
    iterations: int
    objective: float


MODEL_SCHEMA = T.StructType(
    [
        T.StructField("horizon_seconds", T.LongType()),
        T.StructField("method", T.StringType()),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        T.StructField("iterations", T.LongType()),
        T.StructField("objective", T.DoubleType()),
    ]
)


def model_table(spark: SparkSession, models: Iterable[Model]) -> DataFrame:
    rows = [
        (m.horizon_seconds, m.method, m.intercept, list(m.coefficients), m.iterations, m.objective)
        for m in models
    ]
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def event_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, "event_id").agg(F.count(F.lit(1)).alias("event_rows"))


def event_balanced_weights(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row weights with equal totals per event, summing to one per ``keys`` group."""
    sizes = event_sizes(df, keys)
    events = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_events"))
    weight = 1.0 / (F.col("_events") * F.col("event_rows"))
    return (
        df.join(sizes, [*keys, "event_id"])
        .join(F.broadcast(events), keys)
        .withColumn("weight", weight)
        .drop("_events", "event_rows")
    )


def compressed_training(df: DataFrame) -> DataFrame:
    """``(horizon_seconds, p, label, weight)``: weights summed over equal (p, label) pairs.

    Rows are counted per (event, p, label) before the event sizes are joined, so a large event
    reaches the join already reduced to its distinct quotes.
    """
    quotes = df.groupBy("horizon_seconds", "event_id", "p", "label").agg(
        F.count(F.lit(1)).alias("n")
    )
    sizes = quotes.groupBy("horizon_seconds", "event_id").agg(F.sum("n").alias("event_rows"))
    events = sizes.groupBy("horizon_seconds").agg(F.count(F.lit(1)).alias("events"))
    share = F.col("n") / F.col("event_rows")
    summed = (
        quotes.join(sizes, ["horizon_seconds", "event_id"])
        .groupBy("horizon_seconds", "p", "label")
        .agg(F.sum(share).alias("share"))
    )
    return summed.join(F.broadcast(events), "horizon_seconds").select(
        "horizon_seconds", "p", "label", (F.col("share") / F.col("events")).alias("weight")
    )


def check_training(training: DataFrame, horizons: Sequence[int]) -> None:
    """Every horizon needs valid probabilities and both outcome classes."""
    p, y = F.col("p"), F.col("label")
    good_p = is_finite(p) & (p >= 0) & (p <= 1)
    facts = {
        row["horizon_seconds"]: row
        for row in training.groupBy("horizon_seconds")
        .agg(
            F.count(F.when(~F.coalesce(good_p, F.lit(False)), 1)).alias("bad_p"),
            F.count(F.when(~F.coalesce(y.isin(0.0, 1.0), F.lit(False)), 1)).alias("bad_label"),
            F.countDistinct("label").alias("classes"),
        )
        .collect()
    }
    for horizon in horizons:
        row = facts.get(horizon)
        if row is None:
            raise ValueError(f"horizon {horizon} has no rows to fit on")
        if row["bad_label"]:
            raise ValueError("a label to fit on is neither 0 nor 1")
        if row["bad_p"]:
            raise ValueError("a probability to fit on is outside [0, 1]")
        if row["classes"] != 2:
            raise ValueError("fitting takes labels of both kinds")


def _per_horizon(values: dict[int, float]) -> Column:
    """A column that holds one driver-side number per horizon."""
    picked = None
    for horizon, value in values.items():
        test = F.col("horizon_seconds") == horizon
        picked = F.when(test, value) if picked is None else picked.when(test, value)
    return picked


def _linear(theta: list[Column], features: list[Column]) -> Column:
    z = theta[0]
    for slope, x in zip(theta[1:], features, strict=True):
        z = z + slope * x
    return z


def _negative_log_likelihood(z: Column) -> Column:
    return F.sum(F.col("weight") * (softplus(z) - F.col("label") * z))


def newton_statistics(
    features: list[Column], theta: list[Column], shorter: list[list[Column]]
) -> list[Column]:
    """Objective, gradient, upper Hessian and the objectives at ``shorter`` steps, as aggregates."""
    w, y = F.col("weight"), F.col("label")
    design = [F.lit(1.0), *features]
    z = _linear(theta, features)
    fitted = sigmoid(z)
    terms = [_negative_log_likelihood(z)]
    terms += [F.sum(w * (fitted - y) * x) for x in design]
    curvature = w * fitted * (1.0 - fitted)
    for i, left in enumerate(design):
        terms += [F.sum(curvature * left * right) for right in design[i:]]
    terms += [_negative_log_likelihood(_linear(other, features)) for other in shorter]
    return terms


class _Fit:
    """Newton state of one (horizon, method) model."""

    def __init__(self, size: int) -> None:
        self.theta = np.array([0.0] + [1.0] * (size - 1))
        self.candidate = self.theta
        self.step = np.zeros(size)
        self.objective = math.inf
        self.decrease = 0.0
        self.scale = 1.0
        self.iterations = 0
        self.started = False
        self.done = False

    def shorter(self) -> list[np.ndarray]:
        scales = [self.scale * 0.5**k for k in range(1, SCALES_PER_JOB)]
        return [self.theta - scale * self.step for scale in scales]

    def advance(self, numbers: list[float], settings: Settings) -> None:
        size = len(self.theta)
        mask = np.array([0.0] + [1.0] * (size - 1))
        l2 = settings.l2

        def penalty(theta: np.ndarray) -> float:
            return 0.5 * l2 * float(np.dot(mask * theta, theta))

        objective = numbers[0] + penalty(self.candidate)
        if self.started and not self._accepts(objective, self.scale):
            for k, other in enumerate(self.shorter(), start=1):
                value = numbers[-(SCALES_PER_JOB - 1) :][k - 1] + penalty(other)
                if self._accepts(value, self.scale * 0.5**k):
                    self.scale *= 0.5**k
                    self.candidate = other
                    return
            self.scale *= 0.5**SCALES_PER_JOB
            if self.scale < 0.5 ** (MAX_HALVINGS - 1):
                raise ConvergenceError("no shorter step lowers the objective")
            self.candidate = self.theta - self.scale * self.step
            return
        if self.started:
            self.iterations += 1
        self.started, self.theta, self.objective = True, self.candidate, objective
        gradient = np.array(numbers[1 : 1 + size]) + l2 * mask * self.theta
        if float(np.max(np.abs(gradient))) <= settings.tolerance:
            if not (np.all(np.isfinite(self.theta)) and math.isfinite(objective)):
                raise ConvergenceError("the fitted parameters are not finite")
            self.done = True
            return
        if self.iterations >= settings.max_iterations:
            raise ConvergenceError(
                f"still above the tolerance after {settings.max_iterations} iterations"
            )
        upper = iter(numbers[1 + size :])
        hessian = np.diag(l2 * mask)
        for i in range(size):
            for j in range(i, size):
                value = next(upper)
                hessian[i, j] += value
                if i != j:
                    hessian[j, i] += value
        try:
            self.step = np.linalg.solve(hessian, gradient)
        except np.linalg.LinAlgError as error:
            raise ConvergenceError("the curvature matrix cannot be inverted") from error
        self.decrease = float(gradient @ self.step)
        if not math.isfinite(self.decrease) or self.decrease <= 0.0:
            raise ConvergenceError("the step does not lead downhill")
        self.scale = 1.0
        self.candidate = self.theta - self.step

    def _accepts(self, objective: float, scale: float) -> bool:
        return objective <= self.objective - ARMIJO * scale * self.decrease


def fit_calibrators(
    df: DataFrame,
    horizons: Sequence[int],
    methods: Sequence[str] = ("platt", "beta"),
    settings: Settings = Settings(),
) -> list[Model]:
    """Fit one model per (horizon, method) from training rows ``event_id, horizon, p, label``."""
    wanted = df.where(F.col("horizon_seconds").isin([int(h) for h in horizons]))
    training = compressed_training(wanted).persist()
    try:
        check_training(training, horizons)
        return _fit_all(training, horizons, methods, settings)
    finally:
        training.unpersist()


def _fit_all(training, horizons, methods, settings) -> list[Model]:
    """Newton loop. Parameters travel as a broadcast table of one row per horizon, so the query
    and its generated code stay the same from one iteration to the next."""
    spark = training.sparkSession
    width = {m: len(FEATURES[m]("p", settings.epsilon)) + 1 for m in methods}
    fits = {(h, m): _Fit(width[m]) for h in horizons for m in methods}
    names = ", ".join(methods)
    aggregates: list[Column] = []
    for m in methods:
        features = FEATURES[m]("p", settings.epsilon)
        vectors = [
            [F.col(m)[k][i] for i in range(width[m])] for k in range(SCALES_PER_JOB)
        ]
        terms = newton_statistics(features, vectors[0], vectors[1:])
        aggregates.append(F.array(*terms).alias(m))
    while not all(fit.done for fit in fits.values()):
        rows = ", ".join(
            f"({int(h)}L, " + ", ".join(_vectors(fits[h, m]) for m in methods) + ")"
            for h in horizons
        )
        parameters = spark.sql(f"select * from values {rows} as t(horizon_seconds, {names})")
        joined = training.join(F.broadcast(parameters), "horizon_seconds")
        for row in joined.groupBy("horizon_seconds").agg(*aggregates).collect():
            for m in methods:
                fit = fits[row["horizon_seconds"], m]
                if not fit.done:
                    fit.advance(row[m], settings)
    return [
        Model(
            horizon_seconds=int(horizon),
            method=method,
            intercept=float(fit.theta[0]),
            coefficients=tuple(float(v) for v in fit.theta[1:]),
            iterations=fit.iterations,
            objective=fit.objective,
        )
        for (horizon, method), fit in fits.items()
    ]


def _vectors(fit: _Fit) -> str:
    """Candidate and shorter steps as a SQL array of double arrays."""
    rows = [
        "array(" + ", ".join(f"{float(x)!r}D" for x in v) + ")"
        for v in (fit.candidate, *fit.shorter())
    ]
    return f"array({', '.join(rows)})"


def gradient_table(
    df: DataFrame, models: DataFrame, method: str, settings: Settings = Settings()
) -> DataFrame:
    """Largest absolute gradient entry of fitted models on training rows, per horizon."""
    training = compressed_training(df)
    picked = models.where(F.col("method") == method)
    features = FEATURES[method]("p", settings.epsilon)
    theta = [F.col("intercept")] + [F.col("coefficients")[i] for i in range(len(features))]
    residual = F.col("weight") * (sigmoid(_linear(theta, features)) - F.col("label"))
    sums = [F.sum(residual).alias("g0")] + [
        (F.sum(residual * x) + settings.l2 * F.first(slope)).alias(f"g{i}")
        for i, (x, slope) in enumerate(zip(features, theta[1:], strict=True), start=1)
    ]
    summed = training.join(F.broadcast(picked), "horizon_seconds").groupBy("horizon_seconds")
    gradient = summed.agg(*sums)
    names = [f"g{i}" for i in range(len(sums))]
    return gradient.select(
        "horizon_seconds", F.greatest(*[F.abs(F.col(n)) for n in names]).alias("max_gradient")
    )


def apply_calibrators(
    df: DataFrame, models: Sequence[Model], epsilon: float, p: str = "p"
) -> DataFrame:
    """Add one ``p_<method>`` column per fitted method; a missing horizon gives null.

    Parameters are a handful of driver-side numbers, so they become literals: no join is needed.
    """
    for method in dict.fromkeys(model.method for model in models):
        own = [model for model in models if model.method == method]
        features = FEATURES[method](p, epsilon)
        theta = [_per_horizon({m.horizon_seconds: m.intercept for m in own})]
        for i in range(len(features)):
            theta.append(_per_horizon({m.horizon_seconds: m.coefficients[i] for m in own}))
        df = df.withColumn(f"p_{method}", clipped(sigmoid(_linear(theta, features)), epsilon))
    return df

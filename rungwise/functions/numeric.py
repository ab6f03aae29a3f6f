"""Scores, links and ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATIO_TOLERANCE = 1e-12
RISE_TOLERANCE = 1e-12
REPORT_DECIMALS = 12


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clipped(p: Column | str, epsilon: float) -> Column:
    if not 0.0 < epsilon < 0.5:
        raise ValueError("epsilon is a number between 0 and 0.5")
    return F.least(F.greatest(_col(p), F.lit(epsilon)), F.lit(1.0 - epsilon))


def brier_loss(p: Column | str, label: Column | str) -> Column:
    gap = _col(p) - _col(label)
    return gap * gap


def log_loss(p: Column | str, label: Column | str, epsilon: float = 1e-6) -> Column:
    c, y = clipped(p, epsilon), _col(label)
    return -(y * F.log(c) + (1.0 - y) * F.log1p(-c))


def platt_features(p: Column | str, epsilon: float) -> list[Column]:
    c = clipped(p, epsilon)
    return [F.log(c) - F.log1p(-c)]


def beta_features(p: Column | str, epsilon: float) -> list[Column]:
    c = clipped(p, epsilon)
    return [F.log(c), -F.log1p(-c)]


def sigmoid(z: Column | str) -> Column:
    """Logistic function that never exponentiates a positive number."""
    z = _col(z)
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def softplus(z: Column | str) -> Column:
    z = _col(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def safe_ratio(part: Column | str, whole: Column | str) -> Column:
    """``part / whole``, and 0 for an empty whole."""
    return F.coalesce(F.try_divide(_col(part).cast("double"), _col(whole)), F.lit(0.0))


def ratio_matches(ratio: Column | str, part: Column | str, whole: Column | str) -> Column:
    gap = F.abs(_col(ratio) - safe_ratio(part, whole))
    return F.coalesce(gap <= RATIO_TOLERANCE, F.lit(False))


def is_finite(x: Column | str) -> Column:
    x = _col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def quantised(x: Column | str, decimals: int = REPORT_DECIMALS) -> Column:
    """Round for reporting; negative zero becomes zero and non-finite input raises."""
    x = _col(x)
    checked = F.when(is_finite(x), x).otherwise(
        F.raise_error(F.lit("a number to be reported is not finite"))
    )
    return F.when(x.isNull(), None).otherwise(F.round(checked, decimals) + F.lit(0.0))

"""Protocol settings: universe, splits, horizons, inference and reporting limits."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rungwise.operators.calibrate import Settings


@dataclass(frozen=True)
class Gate:
    minimum_events: int = 500
    minimum_blocks: int = 14
    minimum_event_coverage: float = 0.95
    minimum_row_coverage: float = 0.95
    minimum_relative_improvement: float = 0.001
    maximum_log_regression: float = 0.001


@dataclass(frozen=True)
class Protocol:
    """One declared benchmark run. ``splits`` maps a name to its half-open window."""

    assets: tuple[str, ...]
    splits: Mapping[str, tuple[str, str]]
    horizons: tuple[int, ...] = (1800, 900)
    title_regex: str = ".*"
    title_search: str = "above"
    discovery: tuple[str, str] = ("1970-01-01T00:00:00Z", "9999-01-01T00:00:00Z")
    required_outcomes: tuple[str, ...] = ("Yes", "No")
    required_resolution_status: str = "resolved"
    minimum_thresholds: int = 8
    max_staleness_seconds: int = 120
    resolution_grace_seconds: int = 64_800
    training_split: str = "development"
    holdout_split: str = "holdout"
    calibration: Settings = field(default_factory=Settings)
    log_epsilon: float = 1e-6
    resamples: int = 10_000
    confidence: float = 0.95
    seed: int = 0
    gate: Gate = field(default_factory=Gate)

    @property
    def primary_horizon(self) -> int:
        return self.horizons[0]

    def split_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, name, *window) for i, (name, window) in enumerate(self.splits.items())]
        df = spark.createDataFrame(rows, "split_index int, split string, start string, end string")
        return df.selectExpr(
            "split_index", "split", "to_timestamp(start) as start", "to_timestamp(end) as end"
        )

    def grid(self, spark: SparkSession) -> DataFrame:
        """Every declared (split, horizon) cell."""
        cells = [(s, int(h)) for s in self.splits for h in self.horizons]
        return spark.createDataFrame(cells, "split string, horizon_seconds bigint")

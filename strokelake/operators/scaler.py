"""Target scaling: fit, apply, invert, keep as a record."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from strokelake.config import SCORE_RANGES

METHODS = ("min_max", "standardize", "none")
EPSILON = 1e-8  # fixed value


@dataclass(frozen=True)
class Scaler:
    method: str
    min_value: float | None = None
    max_value: float | None = None
    mean: float | None = None
    std: float | None = None
    enabled: bool = True

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown scaling method: {self.method}")

    def _need(self, *names: str) -> None:
        if any(getattr(self, n) is None for n in names):
            raise ValueError("scaler is not fitted")

    def scale(self, value: Column) -> Column:
        if self.method == "min_max":
            self._need("min_value", "max_value")
            return (value - self.min_value) / F.lit(float(self.max_value - self.min_value))
        if self.method == "standardize":
            self._need("mean", "std")
            return (value - self.mean) / F.lit(self.std + EPSILON)
        return value

    def unscale(self, value: Column) -> Column:
        if self.method == "min_max":
            self._need("min_value", "max_value")
            return value * float(self.max_value - self.min_value) + self.min_value
        if self.method == "standardize":
            self._need("mean", "std")
            return value * (self.std + EPSILON) + self.mean
        return value

    def to_record(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_record(record: dict) -> "Scaler":
        if not record.get("enabled", True):
            raise ValueError("scaling is disabled in the record")
        if not record.get("method"):
            raise ValueError("the record has no scaling method")
        names = ("method", "min_value", "max_value", "mean", "std")
        return Scaler(**{n: record.get(n) for n in names})


def fit_scaler(
    df: DataFrame, value: str, method: str = "min_max", value_range: tuple[float, float] | None = None
) -> Scaler:
    """Fit on a target column; a given range wins over the data."""
    if method not in METHODS:
        raise ValueError(f"unknown scaling method: {method}")
    if method == "none":
        return Scaler(method)
    if method == "min_max" and value_range is not None:
        return Scaler(method, float(value_range[0]), float(value_range[1]))
    number = F.col(value).cast("double")
    facts = df.agg(
        F.min(number).alias("lo"), F.max(number).alias("hi"), F.avg(number).alias("m"), F.stddev_pop(number).alias("s")
    ).first()
    if method == "min_max":
        return Scaler(method, facts["lo"], facts["hi"])
    return Scaler(method, mean=facts["m"], std=facts["s"])


def scaler_for_feature(df: DataFrame, value: str, feature: str) -> Scaler:
    """Preset range of a known test, else the data's own range."""
    return fit_scaler(df, value, "min_max", SCORE_RANGES.get(feature))

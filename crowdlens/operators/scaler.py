"""The scaler: everything needed to repeat a batch score elsewhere, as one value and one-row table."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdlens.operators.ordering import exact_quantiles
from crowdlens.params import SHRUNK_SIGNALS, SIGNALS, QueueParams

SCALER_DDL = (
    "method string, signals array<string>, shrunk_signals array<string>, pseudo_count double, "
    "prior_mean map<string,double>, cdf_points int, cdf_breakpoints map<string,array<double>>, "
    "median map<string,double>, scale map<string,double>, clip_low double, clip_high double, "
    "min_reviews_per_user int, min_reviews_per_business int, model_version string"
)


class IncompleteScaler(ValueError):
    """The scaler lacks something a score depends on; scoring with a default would be silently wrong."""


@dataclass(frozen=True)
class Scaler:
    """Priors, breakpoints (or median and scale, for the older method) and the clip."""

    signals: tuple = SIGNALS
    shrunk_signals: tuple = SHRUNK_SIGNALS
    pseudo_count: float = 10.0
    prior_mean: dict = field(default_factory=dict)
    method: str = "rank_normal"
    cdf_breakpoints: dict = field(default_factory=dict)
    median: dict = field(default_factory=dict)
    scale: dict = field(default_factory=dict)
    clip_low: float = -5.0
    clip_high: float = 8.0
    min_reviews_per_user: int = 3
    min_reviews_per_business: int = 10

    def validate(self) -> Scaler:
        """Raise `IncompleteScaler` unless every signal can be scored."""
        if self.method == "rank_normal":
            missing = [name for name in self.signals if not self.cdf_breakpoints.get(name)]
        elif self.method == "robust_z":
            missing = [
                name for name in self.signals
                if not self.scale.get(name) or not math.isfinite(self.scale[name]) or name not in self.median
            ]
        else:
            raise IncompleteScaler(f"unknown method {self.method!r}")
        missing += [name for name in self.shrunk_signals if self.prior_mean.get(name) is None]
        if missing:
            raise IncompleteScaler(f"cannot score {sorted(set(missing))}: fit the scaler again")
        return self

    @property
    def cdf_points(self) -> int:
        return max((len(points) for points in self.cdf_breakpoints.values()), default=0)

    @property
    def model_version(self) -> str:
        """Hash of the content: equal scalers have equal versions."""
        content = json.dumps(
            [self.method, list(self.signals), list(self.shrunk_signals), self.pseudo_count, self.prior_mean,
             self.cdf_breakpoints, self.median, self.scale, self.clip_low, self.clip_high],
            sort_keys=True,
        )
        return hashlib.sha256(content.encode()).hexdigest()[:16]

    def to_table(self, spark: SparkSession) -> DataFrame:
        row = (
            self.method, list(self.signals), list(self.shrunk_signals), self.pseudo_count, self.prior_mean,
            self.cdf_points, self.cdf_breakpoints, self.median, self.scale, self.clip_low, self.clip_high,
            self.min_reviews_per_user, self.min_reviews_per_business, self.model_version,
        )
        return spark.createDataFrame([row], SCALER_DDL)

    @classmethod
    def from_table(cls, table: DataFrame) -> Scaler:
        row = table.head()
        return cls(
            tuple(row.signals), tuple(row.shrunk_signals), row.pseudo_count, dict(row.prior_mean or {}), row.method,
            {name: list(points) for name, points in (row.cdf_breakpoints or {}).items()},
            dict(row.median or {}), dict(row.scale or {}), row.clip_low, row.clip_high,
            row.min_reviews_per_user, row.min_reviews_per_business,
        ).validate()

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Scaler:
        return cls.from_table(spark.read.schema(SCALER_DDL).parquet(path))


def signal_priors(signals: DataFrame, columns: Sequence[str] = SHRUNK_SIGNALS) -> DataFrame:
    """Population mean of each signal as one row; 0 where no author has a value."""
    return signals.agg(*[F.coalesce(F.avg(name), F.lit(0.0)).alias(name) for name in columns])


def shrink_signals(
    signals: DataFrame, prior: dict, pseudo_count: float = 10.0, columns: Sequence[str] = SIGNALS,
    n: str = "n_reviews",
) -> DataFrame:
    """Add `s_<signal>`: (n·x + k·prior) / (n + k) where a prior is given, else the value itself."""
    k = F.lit(float(pseudo_count))
    reviews = F.col(n).cast("double")
    added = {}
    for name in columns:
        if name in prior:
            added[f"s_{name}"] = (reviews * F.col(name) + k * F.lit(float(prior[name]))) / (reviews + k)
        else:
            added[f"s_{name}"] = F.col(name).cast("double")
    return signals.withColumns(added)


def melt(df: DataFrame, columns: dict, name: str = "signal", value: str = "value") -> DataFrame:
    """Long form: one row per entry of `columns` (label -> column)."""
    pairs = F.array(*[
        F.struct(F.lit(label).alias(name), F.col(column).cast("double").alias(value))
        for label, column in columns.items()
    ])
    return df.select(F.inline(pairs))


def cdf_breakpoints(
    signals: DataFrame, columns: dict, points: int = 1001, exact: bool = False, accuracy: int = 10_000
) -> DataFrame:
    """Evenly spaced quantiles as (signal, idx, value), `points` per signal.

    The default merges one quantile sketch per signal in a single pass, whatever the number of rows.
    `exact` counts equal values and selects from distributed running counts.
    """
    if exact:
        return exact_quantiles(melt(signals, columns), "signal", "value", points)
    probabilities = F.array(*[F.lit(i / (points - 1)) for i in range(points)])
    sketches = signals.agg(*[
        F.percentile_approx(F.col(column).cast("double"), probabilities, accuracy).alias(label)
        for label, column in columns.items()
    ])
    pairs = F.array(*[F.struct(F.lit(label).alias("signal"), F.col(label).alias("_points")) for label in columns])
    return sketches.select(F.inline(pairs)).select("signal", F.posexplode("_points").alias("idx", "value"))


def fit_scaler(signals: DataFrame, params: QueueParams = QueueParams()) -> Scaler:
    """Fit priors and breakpoints. Runs two jobs; only the priors and the breakpoints reach the driver.

    `signals` is read twice: pass a staged table, not the plan that computes it.
    """
    prior = signal_priors(signals).head().asDict()
    shrunk = shrink_signals(signals, prior, params.pseudo_count)
    rows = cdf_breakpoints(
        shrunk, {name: f"s_{name}" for name in SIGNALS}, params.cdf_points, params.exact_quantiles,
        params.quantile_accuracy,
    ).collect()
    found: dict[str, list] = {}
    for row in sorted(rows, key=lambda item: (item.signal, item.idx)):
        found.setdefault(row.signal, []).append(float(row.value))
    return Scaler(
        pseudo_count=float(params.pseudo_count), prior_mean=prior, cdf_breakpoints=found,
        clip_low=params.clip_low, clip_high=params.clip_high,
        min_reviews_per_user=params.min_reviews_per_author,
        min_reviews_per_business=params.min_reviews_per_business,
    ).validate()


def fit_robust_scaler(
    signals: DataFrame, params: QueueParams = QueueParams(), columns: Sequence[str] = SIGNALS
) -> Scaler:
    """Older scaling by median and median absolute deviation, kept to read and repeat old scores.

    Raises `IncompleteScaler` when a deviation is 0, as it is for a signal that is mostly zero.
    """
    prior = signal_priors(signals).head().asDict()
    shrunk = shrink_signals(signals, prior, params.pseudo_count, columns)
    probability, accuracy = F.lit(0.5), params.quantile_accuracy
    medians = shrunk.agg(*[
        F.percentile_approx(f"s_{name}", probability, accuracy).alias(name) for name in columns
    ]).head().asDict()
    spread = shrunk.agg(*[
        F.percentile_approx(F.abs(F.col(f"s_{name}") - F.lit(medians[name])), probability, accuracy).alias(name)
        for name in columns
    ]).head().asDict()
    shrunk_columns = tuple(name for name in SHRUNK_SIGNALS if name in columns)
    return Scaler(
        tuple(columns), shrunk_columns, float(params.pseudo_count), prior, "robust_z", {}, medians, spread,
        params.clip_low, params.clip_high, params.min_reviews_per_author, params.min_reviews_per_business,
    ).validate()

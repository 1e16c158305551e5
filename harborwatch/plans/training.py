"""Training path: logs -> features -> single-feature models -> percentiles of the training scores."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.operators import ensemble, features, kde, ranking, scaling
from harborwatch.schema import MODEL_FEATURES, Params
from harborwatch.session import cut_lineage


@dataclass(frozen=True)
class Models:
    """Tables of one training run."""

    scaler: DataFrame
    bandwidths: DataFrame
    support: DataFrame
    clip: bool = True


def training_features(conns: DataFrame, p: Params, base_day: date, last_day: date) -> DataFrame:
    """Sparse features of the days after ``base_day`` up to ``last_day``, for the modelled ports."""
    _, end = features.f.day_bounds(last_day, p.report_tz)
    table = features.window_features(features.between(conns, None, end, p), p, base_day)
    return table.filter(F.col("port").isin(list(p.model_ports)))


def train(table: DataFrame, p: Params, columns: list[str] = MODEL_FEATURES, bandwidth: float | None = None) -> Models:
    """Scaler, bandwidths (searched unless given) and kernel boxes of every (port, feature).

    Like any fit this runs now: the three tables are of bounded size and are checkpointed, so that scoring does
    not repeat the search.
    """
    scaler = cut_lineage(scaling.scaler_fit(table, p, columns))
    if bandwidth is None:
        bandwidths = cut_lineage(kde.kde_bandwidth_cv(table, scaler, columns))
    else:
        bandwidths = kde.fixed_bandwidth(scaler, bandwidth)
    return Models(scaler, bandwidths, cut_lineage(kde.kde_fit(table, scaler, bandwidths, columns)), p.scaler_bounded)


def training_scores(table: DataFrame, models: Models, importance: DataFrame | None = None,
                    columns: list[str] = MODEL_FEATURES) -> DataFrame:
    return ensemble.ensemble_scores(table, models.scaler, models.support, importance, columns, models.clip)


def training_percentiles(scores: DataFrame) -> DataFrame:
    return ranking.percentile_table(scores)

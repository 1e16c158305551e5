"""The ensemble of single-feature isolation forests: fitted, scored, ranked and thresholded like the densities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from harborwatch.operators import ensemble, forest, ranking, scaling
from harborwatch.plans.detection import detection_counts
from harborwatch.schema import MODEL_FEATURES, Params
from harborwatch.session import cut_lineage


@dataclass(frozen=True)
class Forests:
    """Tables of one training run."""

    scaler: DataFrame
    nodes: DataFrame
    clip: bool = True


def train(table: DataFrame, p: Params, columns: list[str] = MODEL_FEATURES) -> Forests:
    """Scaler and the forests of every (port, feature). The tables are of bounded size and checkpointed."""
    scaler = cut_lineage(scaling.scaler_fit(table, p, columns))
    return Forests(scaler, cut_lineage(forest.iforest_fit_single(table, scaler, p, columns)), p.scaler_bounded)


def scores(table: DataFrame, models: Forests, importance: DataFrame | None = None,
           columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """Score of every window: mean of its features' forest scores, or their weighted mean."""
    parts = forest.iforest_feature_scores(table, models.scaler, models.nodes, columns, models.clip)
    keys = ensemble.window_keys(table)
    return ensemble.mean_score(parts, keys) if importance is None else ensemble.weighted_score(parts, importance, keys)


def detect(table: DataFrame, training: DataFrame, models: Forests, percentile: float, ports: list[int],
           importance: DataFrame | None = None) -> DataFrame:
    """Confusion counts at a percentile of the training windows' own scores."""
    limits = ranking.percentile_table(scores(training, models, importance))
    return detection_counts(table, scores(table, models, importance), limits, percentile, ports)

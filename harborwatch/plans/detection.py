"""Detection path: test features + models + training percentiles -> ranking, metrics and labelled windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.operators import ensemble, evaluation, ranking
from harborwatch.plans.training import Models, training_scores
from harborwatch.schema import MODEL_FEATURES


def test_scores(table: DataFrame, models: Models, importance: DataFrame | None = None,
                columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """Values are cut at the fitted bound where the models' scaler is the bounded one."""
    return ensemble.ensemble_scores(table, models.scaler, models.support, importance, columns, models.clip)


def weighted_detection(table: DataFrame, train: DataFrame, models: Models, importance: DataFrame, percentile: float,
                       ports: list[int]) -> DataFrame:
    """Confusion counts of the weighted ensemble at a percentile of its own training scores."""
    limits = ranking.percentile_table(training_scores(train, models, importance))
    return detection_counts(table, test_scores(table, models, importance), limits, percentile, ports)


def topk_report(scores: DataFrame) -> DataFrame:
    return ranking.topk_metrics(ranking.rank_scores(scores))


def detection_counts(table: DataFrame, scores: DataFrame, percentiles: DataFrame, percentile: float, ports: list[int],
                     lists: bool = False) -> DataFrame:
    """Confusion counts on the given (scored) ports."""
    judged = table.filter(F.col("port").isin(ports))
    return evaluation.confusion(evaluation.detect(judged, scores, percentiles, percentile), lists)

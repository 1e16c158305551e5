"""Tables handed from one stage to the next, written once per session and data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as x
from checks.feature_queries import test_day
from checks.ingest_queries import training_windows, window_features
from harborwatch.plans import detection, training
from harborwatch.plans.training import Models
from harborwatch.session import work_path

_WRITTEN: dict[tuple[str, str, str], str] = {}
_MODELS: dict[tuple[str, str], Models] = {}
BANDWIDTH = 0.1


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = work_path(spark, name)
        build().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def train(spark, sf_dir, p):
    return stage(spark, sf_dir, f"train-{p.tw_seconds}", lambda: training_windows(spark, sf_dir, p))


def train_60(spark, sf_dir):
    return train(spark, sf_dir, x.PARAMS_60)


def last_day(spark, sf_dir, p):
    """Background windows of the day after the training days, on the modelled ports."""
    def build():
        table = window_features(spark, sf_dir, p)
        return table.filter((F.col("day") == F.lit(x.TEST_DAY)) & F.col("port").isin(list(p.model_ports)))

    return stage(spark, sf_dir, f"last-day-{p.tw_seconds}", build)


def test_60(spark, sf_dir):
    return stage(spark, sf_dir, "test", lambda: test_day(spark, sf_dir))


def models(spark, sf_dir) -> Models:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = training.train(train_60(spark, sf_dir), x.PARAMS_60, bandwidth=BANDWIDTH)
    return _MODELS[key]


def scored_ports(spark, sf_dir):
    return test_60(spark, sf_dir).filter(F.col("port").isin(list(x.PARAMS_60.model_ports)))


def scores(spark, sf_dir):
    """Rounded so that near-equal scores tie in both engines."""
    def build():
        raw = detection.test_scores(scored_ports(spark, sf_dir), models(spark, sf_dir))
        return raw.withColumn("score", F.round("score", 9))

    return stage(spark, sf_dir, "scores", build)


def training_scores(spark, sf_dir):
    def build():
        raw = training.training_scores(train_60(spark, sf_dir), models(spark, sf_dir))
        return raw.withColumn("score", F.round("score", 9))

    return stage(spark, sf_dir, "training-scores", build)


def percentiles(spark, sf_dir):
    return stage(spark, sf_dir, "percentiles", lambda: training.training_percentiles(training_scores(spark, sf_dir)))



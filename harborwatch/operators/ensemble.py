"""Single-feature models combined into one score per (port, window)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborwatch.operators.kde import kde_ccdf, kde_score
from harborwatch.operators.scaling import scaled_long
from harborwatch.operators.skew import frequency_split_join
from harborwatch.schema import MODEL_FEATURES
from harborwatch.session import cut_lineage


def window_keys(features: DataFrame) -> list[str]:
    return [c for c in ("variant", "day", "timewindow", "port", "label") if c in features.columns]


def attach_model(long: DataFrame, model: DataFrame) -> DataFrame:
    """Rows with the model of their (port, feature); ports without a model give no rows."""
    return long.join(F.broadcast(model), ["port", "feature"])


def attach_importance(long: DataFrame, importance: DataFrame) -> DataFrame:
    """Rows with their feature weight; features without one are skipped. One weight per (port, feature)."""
    return long.join(F.broadcast(importance), ["port", "feature"])


def _per_value(
    features: DataFrame, scaler: DataFrame, support: DataFrame, columns: list[str], clip: bool,
    score: Callable[[DataFrame, DataFrame, list[str]], DataFrame],
) -> DataFrame:
    """Score each distinct value once and hand the result to its windows.

    Some values belong to nearly all windows (a state that hardly occurs has count 0 in them); these do not meet in a task.
    """
    keys = window_keys(features)
    long = scaled_long(features, scaler, keys, columns, clip)
    values = cut_lineage(long.groupBy("port", "feature", "z").agg(F.count(F.lit(1)).alias("_copies")))
    scored = score(values.drop("_copies"), support, ["port", "z"])
    counted = cut_lineage(values.join(scored, ["port", "feature", "z"]))
    return frequency_split_join(long, counted, ["port", "feature", "z"], "_copies").drop("z", "_copies")


def feature_densities(
    features: DataFrame, scaler: DataFrame, support: DataFrame, columns: list[str] = MODEL_FEATURES, clip: bool = True
) -> DataFrame:
    """(keys, feature, density). A density depends on the value only, so each distinct value is scored once.

    This also gives equal windows exactly equal scores, whatever the order of summation.
    """
    return _per_value(features, scaler, support, columns, clip, kde_score)


def feature_tails(
    features: DataFrame, scaler: DataFrame, support: DataFrame, columns: list[str] = MODEL_FEATURES, clip: bool = True
) -> DataFrame:
    """(keys, feature, tail): probability of a larger value under the fitted density."""
    return _per_value(features, scaler, support, columns, clip, kde_ccdf)


def _ordered_sum(*parts: Column) -> Column:
    """Sum of products in feature order (one entry per feature of a window)."""
    entries = F.sort_array(F.collect_list(F.struct("feature", *[c.alias(f"_{i}") for i, c in enumerate(parts)])))
    return F.aggregate(entries, F.lit(0.0), lambda total, e: total + reduce(mul, [e[f"_{i}"] for i in range(len(parts))]))


def mean_score(parts: DataFrame, keys: list[str], value: str = "density") -> DataFrame:
    return parts.groupBy(*keys).agg((_ordered_sum(F.col(value)) / F.count(F.lit(1))).alias("score"))


def weighted_score(parts: DataFrame, importance: DataFrame, keys: list[str], value: str = "density") -> DataFrame:
    weighted = attach_importance(parts, importance)
    return weighted.groupBy(*keys).agg(
        (_ordered_sum(F.col("weight"), F.col(value)) / _ordered_sum(F.col("weight"))).alias("score"))


def score_spread(parts: DataFrame, keys: list[str], value: str = "density") -> DataFrame:
    return parts.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def ensemble_scores(
    features: DataFrame, scaler: DataFrame, support: DataFrame, importance: DataFrame | None = None,
    columns: list[str] = MODEL_FEATURES, clip: bool = True,
) -> DataFrame:
    """Score of every window: mean of its feature densities, or their weighted mean."""
    keys = window_keys(features)
    parts = feature_densities(features, scaler, support, columns, clip)
    return mean_score(parts, keys) if importance is None else weighted_score(parts, importance, keys)


def ensemble_tails(
    ranked: DataFrame, features: DataFrame, scaler: DataFrame, support: DataFrame,
    importance: DataFrame | None = None, columns: list[str] = MODEL_FEATURES,
) -> DataFrame:
    """Tail probability of the ranked windows, combined like the scores; keeps rank and density score."""
    keys = window_keys(features)
    tails = feature_tails(topk_rows(ranked, features), scaler, support, columns)
    combined = mean_score(tails, keys, "tail") if importance is None else weighted_score(tails, importance, keys, "tail")
    return ranked.join(combined.withColumnRenamed("score", "normalized_score"), keys)


def topk_rows(ranked: DataFrame, features: DataFrame) -> DataFrame:
    """Feature rows of the ranked windows, with their rank."""
    keys = [k for k in window_keys(features) if k != "label"]
    return features.join(ranked.select(*keys, "rank"), keys)

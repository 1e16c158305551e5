"""Feature matrices in long form and min-max scaling fitted per port and feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.schema import MODEL_FEATURES, Params


def select_features(features: DataFrame, columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """Key columns, model features and label, in model order."""
    keys = [c for c in ("variant", "day", "timewindow", "port") if c in features.columns]
    label = ["label"] if "label" in features.columns else []
    return features.select(*keys, *columns, *label)


def unpivot_features(features: DataFrame, keys: list[str], columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """One row (keys, feature, x) per feature value."""
    typed = features.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(keys, columns, "feature", "x")


def scaler_fit(features: DataFrame, p: Params, columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """(port, feature, lo, hi). Bounded form: the range also covers 0 and a multiple of the maximum.

    All features of a port are reduced in one pass before the long form is made.
    """
    aggregates = []
    for c in columns:
        low, high = F.min(c).cast("double"), F.max(c).cast("double")
        if p.scaler_bounded:
            edges = [F.lit(p.scaler_min), high * p.scaler_max_factor]
            low, high = F.least(low, *edges), F.greatest(high, *edges)
        aggregates.append(F.struct(F.lit(c).alias("feature"), low.alias("lo"), high.alias("hi")).alias(c))
    fitted = features.groupBy("port").agg(*aggregates)
    return fitted.select("port", F.inline(F.array(*columns)))


def clip_to_bounds(long: DataFrame) -> DataFrame:
    """Values above the fitted upper bound become the bound (needs column ``hi``)."""
    return long.withColumn("x", F.least("x", "hi"))


def scale(long: DataFrame) -> DataFrame:
    """Add ``z``; a constant feature is only shifted (needs ``lo`` and ``hi``)."""
    width = F.col("hi") - F.col("lo")
    return long.withColumn("z", (F.col("x") - F.col("lo")) / F.when(width == 0, 1.0).otherwise(width))


def scaled_long(
    features: DataFrame, scaler: DataFrame, keys: list[str], columns: list[str] = MODEL_FEATURES, clip: bool = False
) -> DataFrame:
    """(keys, feature, z). Ports or features without a scaler drop out. ``keys`` must contain port.

    The scaler holds one row per (port, feature), a few hundred at most.
    """
    bounded = unpivot_features(features, keys, columns).join(F.broadcast(scaler), ["port", "feature"])
    if clip:
        bounded = clip_to_bounds(bounded)
    return scale(bounded).select(*keys, "feature", "z")


def matrix_profile(features: DataFrame, scaler: DataFrame, columns: list[str] = MODEL_FEATURES) -> DataFrame:
    """min, max, mean and deviation over all feature values of a port, before and after scaling."""
    long = unpivot_features(features, ["port"], columns).join(F.broadcast(scaler), ["port", "feature"])
    stats = [("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop)]
    return scale(long).groupBy("port").agg(
        *[fn("x").alias(f"raw_{name}") for name, fn in stats],
        *[fn("z").alias(f"scaled_{name}") for name, fn in stats])

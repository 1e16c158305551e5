"""Densities over whole feature vectors, computed on pairs of window blocks.

A joint kernel needs every (scored, training) pair. Pairs are never rows: each task receives two blocks of at
most BLOCK windows of a port and reduces them with numpy to one log-sum per scored window.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborwatch.operators.kde import BANDWIDTHS, with_folds
from harborwatch.operators.ordering import window_ordinals
from harborwatch.schema import MODEL_FEATURES
from harborwatch.session import spread

BLOCK = 1024
LOG_SQRT_2PI = 0.5 * math.log(2 * math.pi)
# Two-variable candidates (first, second bandwidth).
PAIR_GRID = [(a / 10, b / 10) for a, b in itertools.product(range(1, 11), repeat=2)]


def scaled_vectors(features: DataFrame, scaler: DataFrame, keys: list[str], columns: list[str] = MODEL_FEATURES,
                   clip: bool = False) -> DataFrame:
    """(keys, v): min-max scaled feature arrays in column order. One scaler array per port is attached."""
    order = {c: i for i, c in enumerate(columns)}
    place = F.create_map(*[F.lit(x) for item in order.items() for x in item])
    arrays = (
        scaler.filter(F.col("feature").isin(columns))
        .groupBy("port").agg(F.sort_array(F.collect_list(
            F.struct(place[F.col("feature")].alias("i"), "lo", "hi"))).alias("bounds"))
    )
    raw = features.select(*keys, F.array(*[F.col(c).cast("double") for c in columns]).alias("raw"))

    def one(x, b):
        x = F.least(x, b["hi"]) if clip else x
        width = b["hi"] - b["lo"]
        return (x - b["lo"]) / F.when(width == 0, 1.0).otherwise(width)

    return raw.join(F.broadcast(arrays), "port").select(*keys, F.zip_with("raw", "bounds", one).alias("v"))


def log_kernel_sums(left: np.ndarray, right: np.ndarray, allowed: np.ndarray | None, grid: list[tuple]) -> np.ndarray:
    """log sum over right rows of the product Gaussian kernel, per left row and bandwidth tuple.

    A bandwidth tuple has one entry (all columns) or one per column. Rows without an allowed pair give -inf.
    """
    squares = np.zeros((len(grid[0]), len(left), len(right)))
    for j in range(left.shape[1]):
        squares[j if len(grid[0]) > 1 else 0] += (left[:, j, None] - right[None, :, j]) ** 2
    out = np.empty((len(left), len(grid)))
    for g, h in enumerate(grid):
        e = -sum(s / (2 * b * b) for s, b in zip(squares, h))
        if allowed is not None:
            e = np.where(allowed, e, -np.inf)
        top = e.max(axis=1)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            out[:, g] = safe + np.log(np.exp(e - safe[:, None]).sum(axis=1))
    return out


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, for pairing a table with itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def blocked(vectors: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """Number the windows of each port (and variant) and cut them into blocks of ``size`` (BLOCK)."""
    group = [c for c in ("variant", "port") if c in vectors.columns]
    numbered = window_ordinals(vectors, group, ["timewindow"], "day", "_at")
    return numbered.withColumn(name, F.floor((F.col("_at") - 1) / (size or BLOCK))).drop("_at")


def _block_pairs(scored: DataFrame, training: DataFrame, keys: list[str], grid: list[tuple] | None, mask: str) -> DataFrame:
    """(keys, g, log_sum) per training block. Without a grid, the training rows carry their own bandwidths.

    ``mask``: 'none' uses all pairs, 'fold' pairs of different folds, 'other' all but the window itself.
    """
    window_id = F.unix_date("day").cast("long") * 100000 + F.col("timewindow")
    left = blocked(scored, "a").withColumn("_id", window_id)
    right = blocked(training, "b").withColumn("_id", window_id).drop("day", "timewindow", "variant")
    groups = [c for c in ("variant", "port", "a") if c in left.columns]
    # Every block is sent once to each block of the other side on its port.
    targets = left.join(fresh(right.select("port", "b").distinct()), "port")
    copies = right.join(fresh(left.select(*groups).distinct()), "port")
    carried = [f for f in scored.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + ", g int, log_sum double"

    def reduce_blocks(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({**{k: left[k].iloc[:0] for k in keys}, "g": np.int32([]), "log_sum": np.float64([])})
        allowed = None
        if mask != "none":
            column = "fold" if mask == "fold" else "_id"
            allowed = left[column].to_numpy()[:, None] != right[column].to_numpy()[None, :]
        steps = grid if grid is not None else [tuple(right["h"].iloc[0])]
        sums = log_kernel_sums(np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy()), allowed, steps)
        out = left[keys].loc[left.index.repeat(len(steps))].reset_index(drop=True)
        out["g"] = np.tile(np.arange(len(steps), dtype=np.int32), len(left))
        out["log_sum"] = sums.ravel()
        return out[np.isfinite(out["log_sum"])]

    by = [*groups, "b"]
    pairs = spread(targets, *by).groupBy(*by).cogroup(spread(fresh(copies), *by).groupBy(*by))
    return pairs.applyInPandas(reduce_blocks, schema)


def _log_sum_exp(parts: DataFrame, keys: list[str]) -> DataFrame:
    top = F.max("log_sum").over(W.partitionBy(*keys))
    return parts.withColumn("_top", top).groupBy(*keys).agg(
        (F.max("_top") + F.ln(F.sum(F.exp(F.col("log_sum") - F.col("_top"))))).alias("log_sum"))


def vector_bandwidth_cv(features: DataFrame, scaler: DataFrame, columns: list[str] = MODEL_FEATURES,
                        candidates: list[float] = BANDWIDTHS) -> DataFrame:
    """(port, bandwidth, score): joint kernel over all columns, two folds, best mean held-out log-likelihood."""
    keys = ["day", "timewindow", "port", "fold"]
    folded = scaled_vectors(with_folds(features), scaler, keys, columns)
    grid = [(h,) for h in candidates]
    sums = _log_sum_exp(_block_pairs(folded, folded, keys, grid, "fold"), [*keys, "g"])
    sizes = folded.groupBy("port", "fold").agg(F.count(F.lit(1)).alias("n")).select(
        "port", (1 - F.col("fold")).alias("fold"), "n")
    h = F.element_at(F.array(*[F.lit(x) for x in candidates]), F.col("g") + 1)
    d = float(len(columns))
    log_density = F.col("log_sum") - F.ln("n") - d * (F.ln("bandwidth") + LOG_SQRT_2PI)
    per_fold = sums.join(F.broadcast(sizes), ["port", "fold"]).withColumn("bandwidth", h).groupBy(
        "port", "bandwidth", "fold").agg(F.sum(log_density).alias("score"))
    means = per_fold.groupBy("port", "bandwidth").agg(F.avg("score").alias("score"))
    best = F.max(F.struct("score", (-F.col("bandwidth")).alias("neg"))).alias("best")
    return means.groupBy("port").agg(best).select(
        "port", (-F.col("best.neg")).alias("bandwidth"), F.col("best.score").alias("score"))


def vector_kde_score(test: DataFrame, train: DataFrame, scaler: DataFrame, bandwidths: DataFrame,
                     columns: list[str] = MODEL_FEATURES, clip: bool = False) -> DataFrame:
    """(keys, log_density, score) of the joint Gaussian kernel. ``bandwidths``: (port, h array of 1 or all columns)."""
    keys = [c for c in ("variant", "day", "timewindow", "port", "label") if c in test.columns]
    scored = scaled_vectors(test, scaler, keys, columns, clip)
    training = scaled_vectors(train, scaler, ["day", "timewindow", "port"], columns).join(
        F.broadcast(bandwidths.select("port", "h")), "port")
    sums = _log_sum_exp(_block_pairs(scored, training, keys, None, "none"), keys)
    sizes = train.groupBy("port").agg(F.count(F.lit(1)).alias("n"))
    d = len(columns)
    log_h = F.when(F.size("h") == 1, F.ln(F.col("h")[0]) * d).otherwise(
        F.aggregate("h", F.lit(0.0), lambda acc, x: acc + F.ln(x)))
    log_density = F.col("log_sum") - F.ln("n") - log_h - d * LOG_SQRT_2PI
    return (
        sums.join(F.broadcast(sizes), "port").join(F.broadcast(bandwidths.select("port", "h")), "port")
        .withColumn("log_density", log_density)
        .select(*keys, "log_density", F.exp("log_density").alias("score"))
    )


def pair_bandwidth_ml(features: DataFrame, scaler: DataFrame, columns: list[str], grid: list[tuple] = PAIR_GRID) -> DataFrame:
    """(port, h, score): two-variable product kernel, best leave-one-out log-likelihood over the grid.

    A candidate under which some window has no support at all (log 0) is not eligible.
    """
    if len(columns) != 2:
        raise ValueError("the product kernel takes two variables")
    keys = ["day", "timewindow", "port"]
    vectors = scaled_vectors(features, scaler, keys, columns)
    sums = _log_sum_exp(_block_pairs(vectors, vectors, keys, grid, "other"), [*keys, "g"])
    sizes = vectors.groupBy("port").agg(F.count(F.lit(1)).alias("n"))
    hs = F.element_at(F.array(*[F.array(*[F.lit(x) for x in h]) for h in grid]), F.col("g") + 1)
    loo = F.col("log_sum") - F.ln(F.col("h")[0]) - F.ln(F.col("h")[1])
    totals = sums.withColumn("h", hs).groupBy("port", "g", "h").agg(
        F.sum(loo).alias("score"), F.count(F.lit(1)).alias("used"))
    whole = totals.join(F.broadcast(sizes), "port").filter(F.col("used") == F.col("n"))
    best = F.max(F.struct("score", (-F.col("g")).alias("neg"), "h")).alias("best")
    return whole.groupBy("port").agg(best).select("port", F.col("best.h").alias("h"), F.col("best.score").alias("score"))

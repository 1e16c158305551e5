"""One-dimensional Gaussian kernel densities per (port, feature).

A density at z is a sum over all training values. Training values are grouped into boxes of width h*h, and a
box is kept as the power sums of the offsets d = (x - centre) / h:

    sum exp(-(s - d)^2 / 2) = exp(-s^2 / 2) * sum_j s^j * [sum exp(-d^2 / 2) d^j / j!],   s = (z - centre) / h

A box is min(h*h, h / REACH) wide. For x in [0, 1] and any z within REACH bandwidths of a centre we have |s*d| <= 0.5,
so the first 14 terms leave a relative error below 1e-15: the result is the exact sum to double precision, also for
scored values off the fitted scale; beyond REACH bandwidths the kernel is below the smallest double. The number of boxes
is at most max(1/h^2, REACH/h) + 1 (2,402 at the smallest bandwidth) whatever the number of training windows, so fitting
and scoring are linear in the data.
"""

from __future__ import annotations

import math

from numpy.polynomial.hermite_e import herme2poly
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborwatch.functions.normal import SQRT_2PI, horner, normal_cdf
from harborwatch.operators.ordering import window_ordinals
from harborwatch.operators.scaling import scaled_long
from harborwatch.schema import MODEL_FEATURES
from harborwatch.session import cut_lineage, spread

TERMS = 14
# exp(-REACH^2 / 2) is 0 as a double.
REACH = 39
# Bandwidth candidates: 50 even steps over [0, 1] without 0, which is no kernel.
GRID_STEPS = 49
BANDWIDTHS = [i / GRID_STEPS for i in range(1, GRID_STEPS + 1)]
MIN_BANDWIDTH = BANDWIDTHS[0]
# exp() of anything below is handled in a second sum that is shifted by DEEP_SHIFT.
DEEP = -600.0
# Boxes of about 200 bytes that a search may send to every task, and the salts of its values beyond that.
BROADCAST_BOXES = 600_000
SALTS = 32
DEEP_SHIFT = 650.0


def kde_support(values: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Boxes of the training values. ``values`` has keys, z in [0, 1] and bandwidth.

    Output: keys, bandwidth, centre, n_box, n (all values of the key), terms[14], moments[14].
    """
    weight = F.lit(1.0) if weight is None else weight
    h = F.col("bandwidth")
    slack = 1e-9
    checked = (
        F.when(h < MIN_BANDWIDTH - slack, F.raise_error(F.lit("bandwidth below the candidate grid")).cast("double"))
        .when((F.col("z") < -slack) | (F.col("z") > 1 + slack),
              F.raise_error(F.lit("training value outside the fitted scale")).cast("double"))
        .otherwise(h)
    )
    boxed = (
        values.withColumn("_w", weight).withColumn("bandwidth", checked)
        .withColumn("_width", F.least(h * h, h / REACH))
        .withColumn("centre", (F.floor(F.col("z") / F.col("_width")) + 0.5) * F.col("_width"))
        .withColumn("_d", (F.col("z") - F.col("centre")) / h)
        .withColumn("_g", F.exp(-F.col("_d") * F.col("_d") / 2) * F.col("_w"))
        .withColumn("_d2", F.col("_d") * F.col("_d"))
        .withColumn("_d4", F.col("_d2") * F.col("_d2"))
        .withColumn("_d8", F.col("_d4") * F.col("_d4"))
    )
    power = [_power(j) * (1.0 / math.factorial(j)) for j in range(TERMS)]
    boxes = boxed.groupBy(*keys, "bandwidth", "centre").agg(
        F.sum("_w").alias("n_box"),
        F.array(*[F.sum(F.col("_g") * x) for x in power]).alias("terms"),
        F.array(*[F.sum(F.col("_w") * x) for x in power]).alias("moments"),
    )
    per_key = W.partitionBy(*keys, "bandwidth")
    return boxes.withColumn("n", F.sum("n_box").over(per_key))


def _power(j: int) -> Column:
    """d^j from the squared columns."""
    result = F.lit(1.0)
    for bit, name in ((8, "_d8"), (4, "_d4"), (2, "_d2"), (1, "_d")):
        if j & bit:
            result = result * F.col(name)
    return result


def _distance() -> Column:
    return (F.col("z") - F.col("centre")) / F.col("bandwidth")


def _box_sum(s: Column) -> Column:
    """sum_j s^j * terms[j]; multiply by exp(-s^2 / 2)."""
    return horner(s, [F.col("terms")[j] for j in reversed(range(TERMS))])


def kernel_sum() -> Column:
    s = F.col("_s")
    return F.when(s * s < 1500, F.exp(-s * s / 2) * _box_sum(s)).otherwise(0.0)


def kde_score(targets: DataFrame, support: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, density) for long rows (keys, feature, z); keys contain port."""
    contributions = _meet(targets, support, ["port", "feature"]).withColumn("_s", _distance())
    norm = F.col("n") * F.col("bandwidth") * SQRT_2PI
    return contributions.groupBy(*keys, "feature").agg(F.sum(kernel_sum() / norm).alias("density"))


def kde_pairs(targets: DataFrame, support: DataFrame, keys: list[str]) -> DataFrame:
    """Unnormalised kernel sum and number of training values behind it, per scored value."""
    contributions = _meet(targets, support, ["port", "feature"]).withColumn("_s", _distance())
    return contributions.groupBy(*keys, "feature").agg(
        F.sum(kernel_sum()).alias("kernel_sum"), F.sum("n_box").cast("long").alias("pairs"))


def kde_ccdf(targets: DataFrame, support: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, feature, tail): 1 - CDF of the density, 0 where rounding lifts the CDF above 1.

    Phi(s - d) is expanded in d around each box centre (Hermite polynomials).
    """
    s = F.col("_s")
    powers: list[Column] = [F.lit(0.0)] * (TERMS - 1)
    for k in range(1, TERMS):
        for j, c in enumerate(herme2poly([0] * (k - 1) + [1])):
            if c:
                powers[j] = powers[j] + F.col("moments")[k] * float(c)
    slope = F.when(s * s < 1500, F.exp(-s * s / 2) / SQRT_2PI * horner(s, list(reversed(powers)))).otherwise(0.0)
    below = F.col("n_box") * normal_cdf(s) - slope
    joined = _meet(targets, support, ["port", "feature"]).withColumn("_s", _distance())
    cdf = joined.groupBy(*keys, "feature").agg(F.sum(below / F.col("n")).alias("cdf"))
    return cdf.select(*keys, "feature", F.when(F.col("cdf") > 1, 0.0).otherwise(1 - F.col("cdf")).alias("tail"))


def with_folds(features: DataFrame) -> DataFrame:
    """fold 0 = the first half of a port's windows in (day, window) order, fold 1 = the rest."""
    numbered = window_ordinals(features, ["port"], ["timewindow"], "day", "_at")
    sizes = features.groupBy("port").agg(F.count(F.lit(1)).alias("_n"))
    return (
        numbered.join(F.broadcast(sizes), "port")
        .withColumn("fold", F.when(F.col("_at") <= F.ceil(F.col("_n") / 2), 0).otherwise(1))
        .drop("_at", "_n")
    )


def bandwidth_scores(
    features: DataFrame, scaler: DataFrame, columns: list[str] = MODEL_FEATURES, candidates: list[float] = BANDWIDTHS
) -> DataFrame:
    """(port, feature, bandwidth, score): mean over two folds of the held-out log-likelihood.

    Equal values are scored once. A value far from all training values keeps its log-density through the
    shifted second sum, so no point is lost to underflow.
    """
    folded = scaled_long(with_folds(features), scaler, ["port", "fold"], columns)
    values = cut_lineage(
        folded.groupBy("port", "feature", "fold", "z").agg(F.count(F.lit(1)).cast("double").alias("copies")))
    grid = F.explode(F.array(*[F.lit(h) for h in candidates])).alias("bandwidth")
    support = kde_support(values.select("*", grid), ["port", "feature", "fold"], F.col("copies")).select(
        "port", "feature", (1 - F.col("fold")).alias("fold"), "bandwidth", "centre", "n", "terms")

    keys = ["port", "feature", "fold"]
    joined = _meet(values, cut_lineage(support), keys).withColumn("_s", _distance())
    joined = joined.withColumns({"_e": -F.col("_s") * F.col("_s") / 2, "_p": _box_sum(F.col("_s"))})
    near = F.when(F.col("_e") >= DEEP, F.exp("_e") * F.col("_p")).otherwise(0.0)
    deep = F.when(F.col("_e") < DEEP, F.exp(F.col("_e") + DEEP_SHIFT) * F.col("_p")).otherwise(0.0)
    sums = joined.groupBy("port", "feature", "fold", "z", "copies", "bandwidth", "n").agg(
        F.sum(near).alias("near"), F.sum(deep).alias("deep"))
    total = F.col("near") + F.col("deep") * math.exp(-DEEP_SHIFT)
    log_sum = F.when(total > 1e-290, F.ln(total)).otherwise(F.ln("deep") - DEEP_SHIFT)
    log_density = log_sum - F.ln(F.col("n") * F.col("bandwidth") * SQRT_2PI)
    per_fold = sums.groupBy("port", "feature", "bandwidth", "fold").agg(
        F.sum(F.col("copies") * log_density).alias("score"))
    return per_fold.groupBy("port", "feature", "bandwidth").agg(F.avg("score").alias("score"))


def _meet(values: DataFrame, support: DataFrame, keys: list[str]) -> DataFrame:
    """Every value with all boxes of its keys, values spread over all cores whatever their keys.

    The boxes go to every task where their number allows; else they are repeated for each salt of the values.
    """
    if support.count() <= BROADCAST_BOXES:
        return spread(values, *keys, "z").join(F.broadcast(support), keys)
    salted = values.withColumn("_salt", F.pmod(F.xxhash64("z"), F.lit(SALTS)).cast("int"))
    repeated = support.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread(salted, *keys, "_salt").join(spread(repeated, *keys, "_salt"), [*keys, "_salt"]).drop("_salt")


def kde_bandwidth_cv(
    features: DataFrame, scaler: DataFrame, columns: list[str] = MODEL_FEATURES, candidates: list[float] = BANDWIDTHS
) -> DataFrame:
    """(port, feature, bandwidth, score) of the best candidate; the smaller bandwidth wins a tie."""
    best = F.max(F.struct(F.col("score"), (-F.col("bandwidth")).alias("neg"))).alias("best")
    scores = bandwidth_scores(features, scaler, columns, candidates)
    return scores.groupBy("port", "feature").agg(best).select(
        "port", "feature", (-F.col("best.neg")).alias("bandwidth"), F.col("best.score").alias("score"))


def fixed_bandwidth(scaler: DataFrame, bandwidth: float) -> DataFrame:
    return scaler.select("port", "feature", F.lit(bandwidth).alias("bandwidth"))


def kde_fit(
    features: DataFrame, scaler: DataFrame, bandwidths: DataFrame, columns: list[str] = MODEL_FEATURES
) -> DataFrame:
    """Support boxes of all (port, feature) models at their bandwidths."""
    values = scaled_long(features, scaler, ["port"], columns)
    chosen = bandwidths.select("port", "feature", "bandwidth")
    return kde_support(values.join(F.broadcast(chosen), ["port", "feature"]), ["port", "feature"])

"""Thresholding at a training percentile, confusion counts, ROC and precision-recall curves.

Low scores are anomalous: a window is flagged when its score is at or below the threshold. Curves and sweeps are made per
test day, variant and port (the columns that are there) unless a group is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborwatch.operators.ordering import running_totals
from harborwatch.operators.ranking import day_group


# --- detection -------------------------------------------------------------------

def threshold_at_percentile(percentiles: DataFrame, percentile: float) -> DataFrame:
    return percentiles.filter(F.col("percentile") == percentile).select("port", F.col("score").alias("threshold"))


def flagged_windows(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Windows scored at or below the threshold of their port (one threshold per port)."""
    keys = [*day_group(scores), "timewindow"]
    return scores.join(F.broadcast(thresholds), "port").filter(F.col("score") <= F.col("threshold")).select(*keys)


def with_predictions(features: DataFrame, flagged: DataFrame) -> DataFrame:
    keys = [*day_group(features), "timewindow"]
    marks = flagged.select(*keys).distinct().withColumn("_flag", F.lit(True))
    return features.join(marks, keys, "left").withColumn("predicted", F.col("_flag").isNotNull()).drop("_flag")


def relabel(features: DataFrame, flagged: DataFrame) -> DataFrame:
    """Feature rows with label = flagged."""
    return with_predictions(features, flagged).withColumn("label", F.col("predicted")).drop("predicted")


def _outcomes(predicted: Column, label: Column) -> dict[str, Column]:
    return {"tp": predicted & label, "tn": ~predicted & ~label, "fp": predicted & ~label, "fn": ~predicted & label}


def confusion(predictions: DataFrame, lists: bool = False) -> DataFrame:
    """tp, tn, fp, fn per test day and port; optionally the window numbers of each outcome."""
    outcomes = _outcomes(F.col("predicted"), F.col("label"))
    aggregates = [F.count_if(c).alias(n) for n, c in outcomes.items()]
    if lists:  # a group is one day of windows
        aggregates += [F.sort_array(F.collect_list(F.when(c, F.col("timewindow")))).alias(f"{n}_windows")
                       for n, c in outcomes.items()]
    return predictions.groupBy(*day_group(predictions)).agg(*aggregates)


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def classification_scores(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    })


def rates_at_threshold(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({
        "fpr": _ratio(fp, fp + tn), "tpr": _ratio(tp, tp + fn),
        "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
    })


def detect(features: DataFrame, scores: DataFrame, percentiles: DataFrame, percentile: float) -> DataFrame:
    """Feature rows with the truth (label) and the decision (predicted) at a training percentile."""
    thresholds = threshold_at_percentile(percentiles, percentile)
    return with_predictions(features, flagged_windows(scores, thresholds))


# --- curves ----------------------------------------------------------------------

def score_steps(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Per distinct score, ascending: hits at the score and running totals (previous and current).

    Equal scores collapse first; totals then run over spread range partitions. ROC points, precision-recall points and
    areas of the same group can share one result.
    """
    group = group or day_group(scores)
    steps = scores.groupBy(*group, "score").agg(
        F.count_if("label").alias("step_tp"), F.count_if(~F.col("label")).alias("step_fp"))
    one = F.lit(1).cast("long")
    run = running_totals(steps, ["score", *group], {
        "tp": (group, F.col("step_tp")), "fp": (group, F.col("step_fp")), "step": (group, one)})
    totals = scores.groupBy(*group).agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"),
                                        F.count_distinct("score").alias("steps"))
    return run.join(totals, group).withColumns({
        "prev_tp": F.col("tp") - F.col("step_tp"), "prev_fp": F.col("fp") - F.col("step_fp")})


def _roc(steps: DataFrame) -> DataFrame:
    return steps.withColumns({
        "x": _ratio(F.col("fp"), F.col("neg")), "y": _ratio(F.col("tp"), F.col("pos")),
        "prev_x": _ratio(F.col("prev_fp"), F.col("neg")), "prev_y": _ratio(F.col("prev_tp"), F.col("pos")),
    })


def _pr(steps: DataFrame) -> DataFrame:
    tp, fp, ptp, pfp = (F.col(c) for c in ("tp", "fp", "prev_tp", "prev_fp"))
    return steps.withColumns({
        "x": _ratio(tp, F.col("pos")), "y": tp / (tp + fp),
        "prev_x": _ratio(ptp, F.col("pos")), "prev_y": F.when(F.col("step") == 1, 1.0).otherwise(_ratio(ptp, ptp + pfp)),
    })


def roc_points(
    scores: DataFrame, group: list[str] | None = None, drop_collinear: bool = True, steps: DataFrame | None = None
) -> DataFrame:
    """(group, threshold, fpr, tpr), starting at (0, 0) with a NULL threshold.

    A point is collinear when the next step adds the same hits as its own; the first and last step stay.
    """
    group = group or day_group(scores)
    steps = score_steps(scores, group) if steps is None else steps
    if drop_collinear:
        following = steps.select(*group, (F.col("step") - 1).alias("step"), F.col("step_tp").alias("_next_tp"),
                                 F.col("step_fp").alias("_next_fp"))
        same = (F.col("step_tp") == F.col("_next_tp")) & (F.col("step_fp") == F.col("_next_fp"))
        inner = (F.col("step") > 1) & (F.col("step") < F.col("steps"))
        steps = steps.join(following, [*group, "step"], "left").filter(~(inner & F.coalesce(same, F.lit(False))))
    points = _roc(steps).select(*group, F.col("score").alias("threshold"), F.col("x").alias("fpr"), F.col("y").alias("tpr"))
    origin = scores.select(*group).distinct().select(
        *group, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def pr_points(
    scores: DataFrame, group: list[str] | None = None, stop_at_full_recall: bool = True, steps: DataFrame | None = None
) -> DataFrame:
    """(group, threshold, precision, recall), ending at (1, 0) with a NULL threshold."""
    group = group or day_group(scores)
    steps = score_steps(scores, group) if steps is None else steps
    if stop_at_full_recall:
        steps = steps.filter(F.col("prev_tp") < F.col("pos"))
    points = _pr(steps).select(*group, F.col("score").alias("threshold"), F.col("y").alias("precision"),
                               F.col("x").alias("recall"))
    end = scores.select(*group).distinct().select(
        *group, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def _trapezoids(points: DataFrame, group: list[str], name: str) -> DataFrame:
    width, height = F.col("x") - F.col("prev_x"), (F.col("y") + F.col("prev_y")) / 2
    return points.groupBy(*group).agg(F.sum(width * height).alias(name))


def auc(scores: DataFrame, group: list[str] | None = None, steps: DataFrame | None = None) -> DataFrame:
    """Trapezoid areas under the ROC and the precision-recall curve.

    Each step knows its predecessor from the running totals, so the areas are plain sums.
    """
    group = group or day_group(scores)
    steps = score_steps(scores, group) if steps is None else steps
    return _trapezoids(_roc(steps), group, "roc_auc").join(_trapezoids(_pr(steps), group, "pr_auc"), group)


# --- threshold sweeps --------------------------------------------------------------

def _sweep(scores: DataFrame, group: list[str], thresholds: DataFrame, strict: bool) -> DataFrame:
    """Outcome counts at each threshold. ``thresholds``: (group, cuts = ascending array).

    An as-of merge: collapsed scores and cuts run in one order, by value and with those scores first that a cut of equal
    value flags, and each cut takes the running totals at its place. The order is cut into ranges, so neither a group with
    very many scores nor very many groups meet in one task, and no cuts are sent to all tasks.
    """
    steps = scores.filter(F.col("score").isNotNull()).groupBy(*group, "score").agg(
        F.count_if("label").alias("_tp"), F.count_if(~F.col("label")).alias("_fp")).withColumns({
            "_kind": F.lit(int(strict)), "at": F.lit(-1)})
    none = F.lit(0).cast("long")
    cuts = thresholds.select(*group, F.posexplode("cuts").alias("at", "score")).withColumns({
        "_kind": F.lit(int(not strict)), "_tp": none, "_fp": none})
    run = running_totals(steps.unionByName(cuts), ["score", "_kind", "at", *group], {
        "tp": (group, F.col("_tp")), "fp": (group, F.col("_fp"))}).filter("at >= 0")
    totals = scores.groupBy(*group).agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    return rates_at_threshold(run.join(totals, group).select(
        *group, "at", F.col("score").alias("threshold"), (F.col("neg") - F.col("fp")).alias("tn"), "fp",
        (F.col("pos") - F.col("tp")).alias("fn"), "tp"))


def threshold_sweep(scores: DataFrame, relative: list[float], group: list[str] | None = None) -> DataFrame:
    """Counts and rates for scores <= min + t * (max - min), for each t."""
    group = group or day_group(scores)
    edges = scores.groupBy(*group).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    ts = sorted(relative)
    cuts = F.array(*[F.col("lo") + t * (F.col("hi") - F.col("lo")) for t in ts])
    swept = _sweep(scores, group, edges.select(*group, cuts.alias("cuts")), strict=False)
    names = F.array(*[F.lit(float(t)) for t in ts])
    return swept.withColumn("t", F.element_at(names, F.col("at") + 1)).drop("at")


def sweep_curves(swept: DataFrame, group: list[str] | None = None) -> DataFrame:
    """ROC list from (0, 0) and precision-recall list from (1, 0), as rows (group, curve, t, a, b)."""
    group = group or day_group(swept)
    start = swept.select(*group).distinct()
    none = F.lit(None).cast("double").alias("t")

    def curve(name: str, a: str, b: str, a0: float, b0: float) -> DataFrame:
        head = start.select(*group, F.lit(name).alias("curve"), none, F.lit(a0).alias("a"), F.lit(b0).alias("b"))
        return head.unionByName(swept.select(*group, F.lit(name).alias("curve"), "t", F.col(a).alias("a"), F.col(b).alias("b")))

    return curve("roc", "fpr", "tpr", 0.0, 0.0).unionByName(curve("pr", "precision", "recall", 1.0, 0.0))


def adaptive_thresholds(scores: DataFrame, group: list[str] | None = None, steps: int = 100, nudge: float = 1e-5) -> DataFrame:
    """(group, cuts): three evenly cut segments min..first attack..last attack..max.

    Segments that would be empty are widened by ``nudge``.
    """
    group = group or day_group(scores)
    attack = F.when(F.col("label"), F.col("score"))
    e = scores.groupBy(*group).agg(F.min("score").alias("lo"), F.max("score").alias("hi"),
                                   F.min(attack).alias("first"), F.max(attack).alias("last"))
    e = e.filter(F.col("first").isNotNull())
    e = e.withColumn("hi", F.when(F.col("last") >= F.col("hi"), F.col("last") + nudge).otherwise(F.col("hi")))
    e = e.withColumn("first", F.when(F.col("first") == F.col("last"), F.col("first") - nudge).otherwise(F.col("first")))
    e = e.withColumn("lo", F.when(F.col("first") <= F.col("lo"), F.col("first") - nudge).otherwise(F.col("lo")))
    index = F.sequence(F.lit(0), F.lit(steps - 1))

    def segment(a: str, b: str) -> Column:
        return F.transform(index, lambda i: F.col(a) + i * ((F.col(b) - F.col(a)) / steps))

    return e.select(*group, F.concat(segment("lo", "first"), segment("first", "last"), segment("last", "hi")).alias("cuts"))


def adaptive_roc(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """fpr and tpr of ``score < threshold`` at the adaptive thresholds, closed by (1, 1)."""
    group = group or day_group(scores)
    cuts = adaptive_thresholds(scores, group)
    swept = _sweep(scores, group, cuts, strict=True).select(*group, "threshold", "fpr", "tpr")
    end = cuts.select(*group, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"))
    return swept.unionByName(end)

"""Ranked scores, cumulative hits in the first k, and score percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborwatch.operators.ordering import ordinals
from harborwatch.schema import PERCENTILES, TOP_K, Params


def day_group(df: DataFrame, port: bool = True) -> list[str]:
    """Columns that name one test day of one variant (and port)."""
    return [c for c in ("variant", "day") + (("port",) if port else ()) if c in df.columns]


def rank_scores(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Ascending rank by (score, window) within a test day and port: at most one day of windows per group."""
    w = W.partitionBy(*day_group(scores)).orderBy("score", "timewindow")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def rank_all_ports(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Ascending rank over all ports of a test day (windows per day times ports rows per group)."""
    w = W.partitionBy(*day_group(scores, port=False)).orderBy("score", "port", "timewindow")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def rank_training_scores(scores: DataFrame) -> DataFrame:
    """Ascending rank per port over any number of days."""
    return ordinals(scores, ["score", "day", "timewindow", "port"], {"rank": ["port"]})


def percentile_table(scores: DataFrame, points: list[float] = PERCENTILES) -> DataFrame:
    """(port, percentile, score), linearly interpolated between ranked scores of all training days.

    The ranks come from spread range partitions and only the rows next to a wanted position are kept, so no
    port's scores meet in one buffer.
    """
    ranked = rank_training_scores(scores.select("port", "day", "timewindow", "score"))
    percentile = F.explode(F.array(*[F.lit(float(x)) for x in points])).alias("percentile")
    wanted = (
        ranked.groupBy("port").agg(F.max("rank").alias("n")).select("port", "n", percentile)
        .withColumn("_at", (F.col("n") - 1) * (F.col("percentile") / 100))
        .withColumn("_low", F.floor("_at").cast("long"))
        .withColumn("_part", F.col("_at") - F.col("_low"))
        .select("port", "percentile", F.explode(F.array(
            F.struct((F.col("_low") + 1).alias("rank"), (1 - F.col("_part")).alias("share")),
            F.struct(F.least(F.col("_low") + 2, F.col("n")).alias("rank"), F.col("_part").alias("share")),
        )).alias("_pick")).select("port", "percentile", "_pick.*")
    )
    # Two rows per (port, percentile).
    picked = ranked.select("port", "rank", "score").join(F.broadcast(wanted), ["port", "rank"])
    return picked.groupBy("port", "percentile").agg(F.sum(F.col("score") * F.col("share")).alias("score"))


def _first_k(ks: list[int]) -> F.Column:
    return F.element_at(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank")), 1)


def _cumulative(ranked: DataFrame, group: list[str], ks: list[int], sums: dict) -> DataFrame:
    """Sums over ranks <= k for every k; a k beyond the last rank shows the totals."""
    hits = ranked.filter(F.col("rank") <= max(ks)).withColumn("k", _first_k(ks))
    by_k = hits.groupBy(*group, "k").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    grid = ranked.select(*group).distinct().select(*group, F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    up_to = W.partitionBy(*group).orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    return grid.join(by_k, [*group, "k"], "left").select(
        *group, "k", *[F.sum(F.coalesce(n, F.lit(0))).over(up_to).cast("long").alias(n) for n in sums])


def topk_metrics(ranked: DataFrame, ks: list[int] = TOP_K) -> DataFrame:
    """tp_total and fp_total within the first k windows of each test day and port."""
    hit = F.col("label").cast("int")
    return _cumulative(ranked, day_group(ranked), ks, {"tp_total": hit, "fp_total": 1 - hit})


def topk_metrics_all_ports(ranked: DataFrame, p: Params, ks: list[int] = TOP_K) -> DataFrame:
    """Totals over ports ranked together, and one false-positive column per port."""
    hit = F.col("label").cast("int")
    sums = {"tp_total": hit, "fp_total": 1 - hit}
    sums |= {f"fp_{x}": F.when(F.col("port") == x, 1 - hit).otherwise(0) for x in p.model_ports}
    return _cumulative(ranked, day_group(ranked, port=False), ks, sums)


def recall_at_k(metrics: DataFrame, ranked: DataFrame) -> DataFrame:
    """Share of attack windows found and share of false alarms in the first k."""
    group = day_group(metrics)
    attacks = ranked.groupBy(*group).agg(F.count_if("label").alias("_attacks"))
    k, tp = F.col("k"), F.col("tp_total")
    return metrics.join(attacks, group).select(
        *group, "k", (tp / F.nullif("_attacks", F.lit(0))).alias("tp_by_k"), ((k - tp) / k).alias("fp_by_k"))

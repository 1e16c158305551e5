"""Scaling, densities, ensembles, forests, ranking, thresholds and curves (M*, J8-J14, A17-A25, W4-W11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as x
from checks import sql as q
from checks import stages as st
from checks.feature_queries import test_day
from checks.ingest_queries import window_features
from checks.registry import query, rounded
from harborwatch.operators import ensemble, evaluation, importance, kde, ranking, scaling, vectors
from harborwatch.plans import detection, training
from harborwatch.schema import MODEL_FEATURES, PERCENTILES, TOP_K, Params

H = st.BANDWIDTH
P_DAYPART = Params(tw_seconds=14400)
PAIR = ["num_conns", "external_ips"]
VECTOR_H = 0.5

_TRAIN = q.train(60)
_TEST = [*_TRAIN, *q.overlay(60), ("scored", f"SELECT * FROM test WHERE port IN {q.MODEL_PORTS}")]
_TEST_Z = [*_TEST, *q.test_z(source="scored")]
_DENSITIES = [*_TEST_Z, *q.densities(H)]
_SCORES = [*_DENSITIES, ("scores", """
    SELECT t.variant, t.day, t.timewindow, t.port, t.label, round(avg(d.density), 9) AS score
    FROM test_z t JOIN densities d ON t.port = d.port AND t.feature = d.feature AND t.z = d.z
    GROUP BY t.variant, t.day, t.timewindow, t.port, t.label""")]
_TRAIN_SCORES = [*_TRAIN, *q.densities(H, "train_z", "train_densities"), ("training_scores", """
    SELECT t.day, t.timewindow, t.port, round(avg(d.density), 9) AS score
    FROM train_z t JOIN train_densities d ON t.port = d.port AND t.feature = d.feature AND t.z = d.z
    GROUP BY t.day, t.timewindow, t.port""")]
_POINTS = ", ".join(f"({p}e0)" for p in PERCENTILES)
_PERCENTILES = [*_TRAIN_SCORES, ("percentiles", f"""
    SELECT r.port, p.percentile, sum(r.score * CASE WHEN r.place = floor((n - 1) * (percentile / 100)) + 1
             THEN 1 - ((n - 1) * (percentile / 100) - floor((n - 1) * (percentile / 100)))
             ELSE (n - 1) * (percentile / 100) - floor((n - 1) * (percentile / 100)) END) AS score
    FROM (SELECT port, score, row_number() OVER (PARTITION BY port ORDER BY score, day, timewindow) AS place,
                 count(*) OVER (PARTITION BY port) AS n FROM training_scores) r
    JOIN (VALUES {_POINTS}) p(percentile)
      ON r.place IN (floor((n - 1) * (percentile / 100)) + 1, floor((n - 1) * (percentile / 100)) + 2)
    GROUP BY r.port, p.percentile""")]
_KEY = "variant, day, timewindow, port"


# --- scaling -------------------------------------------------------------------------

@query("scaler_fit", q.with_(_TRAIN, "SELECT port, feature, round(lo, 6) AS lo, round(hi, 6) AS hi FROM scaler"))
def scaler_fit(spark, sf_dir):
    return rounded(scaling.scaler_fit(st.train_60(spark, sf_dir), x.PARAMS_60))


@query("scaler_fit_plain", q.with_(_TRAIN, """
    SELECT port, feature, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM train_long GROUP BY port, feature"""))
def scaler_fit_plain(spark, sf_dir):
    return rounded(scaling.scaler_fit(st.train_60(spark, sf_dir), Params(scaler_bounded=False)))


@query("scale", q.with_(_TRAIN, "SELECT day, timewindow, port, feature, round(z, 6) AS z FROM train_z"))
def scale(spark, sf_dir):
    train = st.train_60(spark, sf_dir)
    scaler = scaling.scaler_fit(train, x.PARAMS_60)
    return rounded(scaling.scaled_long(train, scaler, ["day", "timewindow", "port"]))


@query("clip_to_bounds", q.with_(_TEST_Z, "SELECT timewindow, port, feature, round(z, 6) AS z FROM test_z"))
def clip_to_bounds(spark, sf_dir):
    scaler = st.models(spark, sf_dir).scaler
    return rounded(scaling.scaled_long(st.scored_ports(spark, sf_dir), scaler, ["timewindow", "port"], clip=True))


@query("matrix_profile", q.with_([*_TEST, *q.test_z(clip=False, source="scored")], """
    SELECT t.port, round(min(x), 6) AS raw_min, round(max(x), 6) AS raw_max, round(avg(x), 6) AS raw_mean, round(stddev_pop(x), 5) AS raw_std,
           round(min(z), 6) AS scaled_min, round(max(z), 6) AS scaled_max, round(avg(z), 6) AS scaled_mean, round(stddev_pop(z), 6) AS scaled_std
    FROM test_long t JOIN test_z z ON t.port = z.port AND t.timewindow = z.timewindow AND t.feature = z.feature GROUP BY t.port"""))
def matrix_profile(spark, sf_dir):
    profile = scaling.matrix_profile(st.scored_ports(spark, sf_dir), st.models(spark, sf_dir).scaler)
    return rounded(profile.withColumn("raw_std", F.round("raw_std", 5)))


# --- one-dimensional densities ---------------------------------------------------------

_FOLDS = [*q.train(14400), ("folded", """
    SELECT z.port, z.feature, z.z, CASE WHEN f.place <= ceil(f.n / 2e0) THEN 0 ELSE 1 END AS fold FROM train_z z
    JOIN (SELECT day, timewindow, port, row_number() OVER (PARTITION BY port ORDER BY day, timewindow) AS place,
                 count(*) OVER (PARTITION BY port) AS n FROM train) f
      ON z.day = f.day AND z.timewindow = f.timewindow AND z.port = f.port"""),
    ("vals", "SELECT port, feature, fold, z, cast(count(*) AS double) AS w FROM folded GROUP BY ALL"),
    ("fold_n", "SELECT port, feature, fold, sum(w) AS n FROM vals GROUP BY ALL"),
    ("near", """SELECT v.port, v.feature, v.fold, v.z, v.w, min((v.z - s.z) * (v.z - s.z)) AS d0
                FROM vals v JOIN vals s ON v.port = s.port AND v.feature = s.feature AND s.fold = 1 - v.fold GROUP BY ALL"""),
    ("grid", "SELECT i / 49e0 AS h FROM range(1, 50) r(i)"),
    ("held_out", """SELECT v.port, v.feature, v.fold, h,
                      v.w * (-max(v.d0) / (2 * h * h) + ln(sum(s.w * exp(-((v.z - s.z) * (v.z - s.z) - v.d0) / (2 * h * h))))
                             - ln(max(n.n) * h * sqrt(2 * pi()))) AS ll
                    FROM near v JOIN vals s ON v.port = s.port AND v.feature = s.feature AND s.fold = 1 - v.fold
                    JOIN fold_n n ON n.port = v.port AND n.feature = v.feature AND n.fold = 1 - v.fold CROSS JOIN grid
                    GROUP BY v.port, v.feature, v.fold, v.z, v.w, h"""),
    ("cv", """SELECT port, feature, h AS bandwidth, avg(score) AS score FROM (
                SELECT port, feature, fold, h, sum(ll) AS score FROM held_out GROUP BY ALL) f GROUP BY port, feature, h""")]


@query("kde_bandwidth_cv_60s")
def kde_bandwidth_cv_60s(spark, sf_dir):
    """The search at the default grain; its sums over pairs take minutes in SQL, so the same SQL is kept at a coarser one."""
    train = st.train_60(spark, sf_dir)
    return rounded(kde.kde_bandwidth_cv(train, scaling.scaler_fit(train, x.PARAMS_60)))


def _cv_inputs(spark, sf_dir):
    train = st.train(spark, sf_dir, P_DAYPART)
    return train, scaling.scaler_fit(train, P_DAYPART)


@query("kde_bandwidth_scores", q.with_(_FOLDS, "SELECT port, feature, bandwidth, round(score, 6) AS score FROM cv"))
def kde_bandwidth_scores(spark, sf_dir):
    return rounded(kde.bandwidth_scores(*_cv_inputs(spark, sf_dir))).select("port", "feature", "bandwidth", "score").withColumn(
        "bandwidth", F.round(F.col("bandwidth") * 49) / 49)


@query("kde_bandwidth_cv", q.with_(_FOLDS, """
    SELECT port, feature, round(bandwidth, 6) AS bandwidth, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY port, feature ORDER BY score DESC, bandwidth) AS place FROM cv) c WHERE place = 1"""))
def kde_bandwidth_cv(spark, sf_dir):
    return rounded(kde.kde_bandwidth_cv(*_cv_inputs(spark, sf_dir)))


def _values(spark, sf_dir):
    """Distinct scored values (port, feature, z)."""
    long = scaling.scaled_long(st.scored_ports(spark, sf_dir), st.models(spark, sf_dir).scaler, ["port"], clip=True)
    return long.select("port", "feature", "z").distinct()


@query("kde_score", q.with_(_DENSITIES, "SELECT DISTINCT port, feature, round(z, 9) AS z, round(density, 6) AS density FROM densities"))
def kde_score(spark, sf_dir):
    scored = kde.kde_score(_values(spark, sf_dir), st.models(spark, sf_dir).support, ["port", "z"])
    return scored.select("port", "feature", F.round("z", 9).alias("z"), F.round("density", 6).alias("density")).distinct()


@query("kde_pairs", q.with_(_DENSITIES, f"""
    SELECT DISTINCT d.port, d.feature, round(z, 9) AS z, round(density * n.n * {H} * sqrt(2 * pi()), 5) AS kernel_sum, cast(n.n AS bigint) AS pairs
    FROM densities d JOIN sizes_train n ON n.port = d.port"""))
def kde_pairs(spark, sf_dir):
    pairs = kde.kde_pairs(_values(spark, sf_dir), st.models(spark, sf_dir).support, ["port", "z"])
    return pairs.select("port", "feature", F.round("z", 9).alias("z"), F.round("kernel_sum", 5).alias("kernel_sum"),
                        "pairs").distinct()


# --- models attached, ensembles ----------------------------------------------------------

@query("attach_model", q.with_(_TEST_Z, """
    SELECT t.timewindow, t.port, t.feature, round(s.hi, 6) AS hi FROM test_long t
    JOIN scaler s ON t.port = s.port AND t.feature = s.feature"""))
def attach_model(spark, sf_dir):
    """All test ports, modelled or not: the ones without a model drop out."""
    long = scaling.unpivot_features(st.test_60(spark, sf_dir), ["timewindow", "port"])
    return rounded(ensemble.attach_model(long, st.models(spark, sf_dir).scaler).select("timewindow", "port", "feature", "hi"))


@query("attach_importance", q.with_([*_TEST_Z, *q.importance()], """
    SELECT t.timewindow, t.port, t.feature, i.weight FROM test_long t JOIN importance i ON t.port = i.port AND t.feature = i.feature"""))
def attach_importance(spark, sf_dir):
    long = scaling.unpivot_features(st.scored_ports(spark, sf_dir), ["timewindow", "port"])
    return ensemble.attach_importance(long, x.importance(spark)).select("timewindow", "port", "feature", "weight")


def _densities(spark, sf_dir):
    m = st.models(spark, sf_dir)
    return ensemble.feature_densities(st.scored_ports(spark, sf_dir), m.scaler, m.support)


_KEYS = ["variant", "day", "timewindow", "port", "label"]


@query("ensemble_mean", q.with_(_SCORES, "SELECT variant, day, timewindow, port, label, round(score, 6) AS score FROM scores"))
def ensemble_mean(spark, sf_dir):
    m = st.models(spark, sf_dir)
    scores = detection.test_scores(st.scored_ports(spark, sf_dir), m)
    return rounded(scores.withColumn("score", F.round("score", 9)))


_WEIGHTED = [*_DENSITIES, *q.importance(), ("weighted", """
    SELECT t.variant, t.day, t.timewindow, t.port, t.label, round(sum(i.weight * d.density) / sum(i.weight), 6) AS score
    FROM test_z t JOIN densities d ON t.port = d.port AND t.feature = d.feature AND t.z = d.z
    JOIN importance i ON i.port = t.port AND i.feature = t.feature
    GROUP BY t.variant, t.day, t.timewindow, t.port, t.label""")]


@query("ensemble_weighted", q.with_(_WEIGHTED, "SELECT * FROM weighted"))
def ensemble_weighted(spark, sf_dir):
    m = st.models(spark, sf_dir)
    return rounded(detection.test_scores(st.scored_ports(spark, sf_dir), m, x.importance(spark)))


@query("mean_score", q.with_(_TRAIN_SCORES, "SELECT day, timewindow, port, round(score, 6) AS score FROM training_scores"))
def mean_score(spark, sf_dir):
    scores = training.training_scores(st.train_60(spark, sf_dir), st.models(spark, sf_dir))
    return rounded(scores.withColumn("score", F.round("score", 9)))


@query("weighted_score", q.with_([*_TRAIN, *q.densities(H, "train_z", "train_densities"), *q.importance()], """
    SELECT t.day, t.timewindow, t.port, round(sum(i.weight * d.density) / sum(i.weight), 6) AS score
    FROM train_z t JOIN train_densities d ON t.port = d.port AND t.feature = d.feature AND t.z = d.z
    JOIN importance i ON i.port = t.port AND i.feature = t.feature GROUP BY t.day, t.timewindow, t.port"""))
def weighted_score(spark, sf_dir):
    return rounded(training.training_scores(st.train_60(spark, sf_dir), st.models(spark, sf_dir), x.importance(spark)))


@query("score_spread", q.with_(_DENSITIES, """
    SELECT t.timewindow, t.port, round(avg(d.density), 6) AS mean, round(stddev_samp(d.density), 6) AS std
    FROM test_z t JOIN densities d ON t.port = d.port AND t.feature = d.feature AND t.z = d.z GROUP BY t.timewindow, t.port"""))
def score_spread(spark, sf_dir):
    return rounded(ensemble.score_spread(_densities(spark, sf_dir), ["timewindow", "port"]))


@query("kde_ccdf", q.with_([*_TEST_Z, ("tail_v", "SELECT DISTINCT port, feature, z FROM test_z"), ("tails", f"""
    SELECT v.port, v.feature, v.z, sum(s.w * ({q.normal_cdf(f'((v.z - s.z) / {H})')})) / max(n.n) AS cdf
    FROM tail_v v JOIN support s ON v.port = s.port AND v.feature = s.feature JOIN sizes_train n ON n.port = v.port
    GROUP BY v.port, v.feature, v.z""")], """
    SELECT t.timewindow, t.port, round(avg(CASE WHEN cdf > 1 THEN 0 ELSE 1 - cdf END), 6) AS normalized_score
    FROM test_z t JOIN tails d ON t.port = d.port AND t.feature = d.feature AND t.z = d.z GROUP BY t.timewindow, t.port"""))
def kde_ccdf(spark, sf_dir):
    """Every window of the test day is ranked, so every window gets its tail probability."""
    m = st.models(spark, sf_dir)
    ranked = ranking.rank_scores(st.scores(spark, sf_dir))
    tails = ensemble.ensemble_tails(ranked, st.scored_ports(spark, sf_dir), m.scaler, m.support)
    return tails.select("timewindow", "port", F.round("normalized_score", 6).alias("normalized_score"))


@query("ranked_report_weighted", q.with_([*_TEST_Z, *q.importance(), ("tail_v", "SELECT DISTINCT port, feature, z FROM test_z"), ("tails", f"""
    SELECT v.port, v.feature, v.z, sum(s.w * ({q.normal_cdf(f'((v.z - s.z) / {H})')})) / max(n.n) AS cdf
    FROM tail_v v JOIN support s ON v.port = s.port AND v.feature = s.feature JOIN sizes_train n ON n.port = v.port
    GROUP BY v.port, v.feature, v.z""")], """
    SELECT t.timewindow, t.port, round(sum(i.weight * CASE WHEN cdf > 1 THEN 0 ELSE 1 - cdf END) / sum(i.weight), 6) AS normalized_score
    FROM test_z t JOIN tails d ON t.port = d.port AND t.feature = d.feature AND t.z = d.z
    JOIN importance i ON i.port = t.port AND i.feature = t.feature GROUP BY t.timewindow, t.port"""))
def ranked_report_weighted(spark, sf_dir):
    """Weighted scores, ranked, with the weighted tail probability of every window."""
    m, weights = st.models(spark, sf_dir), x.importance(spark)
    ranked = ranking.rank_scores(detection.test_scores(st.scored_ports(spark, sf_dir), m, weights))
    tails = ensemble.ensemble_tails(ranked, st.scored_ports(spark, sf_dir), m.scaler, m.support, weights)
    return tails.select("timewindow", "port", F.round("normalized_score", 6).alias("normalized_score"))


# --- whole-vector densities and forests ----------------------------------------------------

_VECTOR = [*q.train(3600), ("day30", f"SELECT * FROM features WHERE day = DATE '2024-01-30' AND port IN {q.MODEL_PORTS}"),
           ("day30_long", q.long("day30", "day, timewindow, port")),
           ("day30_z", """SELECT t.timewindow, t.port, t.feature, (t.x - s.lo) / CASE WHEN s.hi = s.lo THEN 1e0 ELSE s.hi - s.lo END AS z
                          FROM day30_long t JOIN scaler s ON t.port = s.port AND t.feature = s.feature"""),
           ("distances", """SELECT t.timewindow, t.port, r.day, r.timewindow AS tw, sum((t.z - r.z) * (t.z - r.z)) AS d2
                            FROM day30_z t JOIN train_z r ON t.port = r.port AND t.feature = r.feature GROUP BY ALL""")]


@query("kde_score_multi", q.with_(_VECTOR, f"""
    SELECT d.timewindow, d.port, round(ln(sum(exp(-d2 / (2 * {VECTOR_H} * {VECTOR_H})))) - ln(max(n.n))
             - 35 * ln({VECTOR_H} * sqrt(2 * pi())), 6) AS log_density
    FROM distances d JOIN sizes_train n ON n.port = d.port GROUP BY d.timewindow, d.port"""))
def kde_score_multi(spark, sf_dir):
    train = st.train(spark, sf_dir, x.PARAMS_3600)
    scaler = scaling.scaler_fit(train, x.PARAMS_3600)
    bandwidths = scaler.select("port").distinct().withColumn("h", F.array(F.lit(VECTOR_H)))
    test = _last_day(spark, sf_dir)
    scored = vectors.vector_kde_score(test, train, scaler, bandwidths)
    return scored.select("timewindow", "port", F.round("log_density", 6).alias("log_density"))


def _last_day(spark, sf_dir):
    return st.last_day(spark, sf_dir, x.PARAMS_3600)


_JOINT_CV = [*q.train(14400), ("folded", """
    SELECT day, timewindow, port, CASE WHEN place <= ceil(n / 2e0) THEN 0 ELSE 1 END AS fold FROM (
      SELECT day, timewindow, port, row_number() OVER (PARTITION BY port ORDER BY day, timewindow) AS place,
             count(*) OVER (PARTITION BY port) AS n FROM train) f"""),
    ("fz", """SELECT z.*, f.fold FROM train_z z JOIN folded f ON z.day = f.day AND z.timewindow = f.timewindow AND z.port = f.port"""),
    ("d", """SELECT a.port, a.fold, a.day, a.timewindow, b.day AS bd, b.timewindow AS bt, sum((a.z - b.z) * (a.z - b.z)) AS d2
             FROM fz a JOIN fz b ON a.port = b.port AND a.feature = b.feature AND b.fold = 1 - a.fold GROUP BY ALL"""),
    ("d0", "SELECT port, fold, day, timewindow, min(d2) AS d0, count(*) AS n FROM d GROUP BY ALL"),
    ("ll", """SELECT d.port, d.fold, h, -max(d0.d0) / (2 * h * h) + ln(sum(exp(-(d.d2 - d0.d0) / (2 * h * h)))) - ln(max(d0.n))
                - 35 * ln(h * sqrt(2 * pi())) AS ll
              FROM d JOIN d0 ON d.port = d0.port AND d.fold = d0.fold AND d.day = d0.day AND d.timewindow = d0.timewindow
              CROSS JOIN (SELECT i / 49e0 AS h FROM range(1, 50) r(i)) g GROUP BY d.port, d.fold, d.day, d.timewindow, h"""),
    ("jcv", "SELECT port, h, avg(s) AS score FROM (SELECT port, fold, h, sum(ll) AS s FROM ll GROUP BY ALL) f GROUP BY port, h")]


@query("kde_bandwidth_cv_multi", q.with_(_JOINT_CV, """
    SELECT port, round(h, 6) AS bandwidth, round(score, 5) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY port ORDER BY score DESC, h) AS place FROM jcv) c WHERE place = 1"""))
def kde_bandwidth_cv_multi(spark, sf_dir):
    best = vectors.vector_bandwidth_cv(*_cv_inputs(spark, sf_dir))
    return best.select("port", F.round("bandwidth", 6).alias("bandwidth"), F.round("score", 5).alias("score"))


_LOO = [*q.train(14400), ("xy", """
    SELECT a.day, a.timewindow, a.port, a.z AS x, b.z AS y FROM train_z a JOIN train_z b
      ON a.day = b.day AND a.timewindow = b.timewindow AND a.port = b.port
    WHERE a.feature = 'num_conns' AND b.feature = 'external_ips'"""),
    ("loo", """SELECT a.port, h1, h2, ln(sum(exp(-(a.x - b.x) * (a.x - b.x) / (2 * h1 * h1) - (a.y - b.y) * (a.y - b.y) / (2 * h2 * h2))))
                 - ln(h1) - ln(h2) AS ll
               FROM xy a JOIN xy b ON a.port = b.port AND (a.day <> b.day OR a.timewindow <> b.timewindow)
               CROSS JOIN (SELECT i / 10e0 AS h1, j / 10e0 AS h2 FROM range(1, 11) r(i) CROSS JOIN range(1, 11) s(j)) g
               GROUP BY a.port, a.day, a.timewindow, h1, h2"""),
    ("lcv", "SELECT port, h1, h2, sum(ll) AS score FROM loo GROUP BY ALL")]


@query("kde_multivariate", q.with_(_LOO, """
    SELECT port, h1, h2, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY port ORDER BY score DESC, h1, h2) AS place FROM lcv) c WHERE place = 1"""))
def kde_multivariate(spark, sf_dir):
    train, _ = _cv_inputs(spark, sf_dir)
    scaler = scaling.scaler_fit(train, P_DAYPART, PAIR)
    best = vectors.pair_bandwidth_ml(train, scaler, PAIR)
    return rounded(best.select("port", F.col("h")[0].alias("h1"), F.col("h")[1].alias("h2"), "score"))


def _forest_inputs(spark, sf_dir):
    train = st.train(spark, sf_dir, x.PARAMS_3600)
    return train, scaling.scaler_fit(train, x.PARAMS_3600)


@query("rf_importance")
def rf_importance(spark, sf_dir):
    return importance.rf_importance(st.test_60(spark, sf_dir), list(x.PARAMS_60.ports))


def _labelled_hours(spark, sf_dir):
    p = Params(tw_seconds=3600, attackers=x.PARAMS_OVERLAY.attackers)
    day = st.stage(spark, sf_dir, "test-3600", lambda: test_day(spark, sf_dir, p))
    return day.filter(F.col("port").isin(list(p.model_ports)))


@query("joint_density_evaluation")
def joint_density_evaluation(spark, sf_dir):
    """Areas under the curves of the joint density of all features, on labelled hours."""
    train, scaler = _forest_inputs(spark, sf_dir)
    bandwidths = scaler.select("port").distinct().withColumn("h", F.array(F.lit(VECTOR_H)))
    scored = vectors.vector_kde_score(_labelled_hours(spark, sf_dir), train, scaler, bandwidths)
    return rounded(evaluation.auc(scored.withColumn("score", F.col("log_density"))))


# --- ranking and percentiles ------------------------------------------------------------------

_RANKED = [*_SCORES, ("ranked", """
    SELECT *, row_number() OVER (PARTITION BY port ORDER BY score, timewindow) AS rank FROM scores""")]


@query("rank_scores", q.with_(_RANKED, "SELECT port, timewindow, label, rank, round(score, 6) AS score FROM ranked"))
def rank_scores(spark, sf_dir):
    ranked = ranking.rank_scores(st.scores(spark, sf_dir))
    return rounded(ranked.select("port", "timewindow", "label", F.col("rank").cast("long").alias("rank"), "score"))


@query("rank_training_scores", q.with_(_TRAIN_SCORES, """
    SELECT port, day, timewindow, row_number() OVER (PARTITION BY port ORDER BY score, day, timewindow) AS rank FROM training_scores"""))
def rank_training_scores(spark, sf_dir):
    return ranking.rank_training_scores(st.training_scores(spark, sf_dir)).select("port", "day", "timewindow", "rank")


@query("topk_slice", q.with_(_RANKED, "SELECT port, timewindow, rank FROM ranked WHERE rank <= 100"))
def topk_slice(spark, sf_dir):
    ranked = ranking.rank_scores(st.scores(spark, sf_dir), k=100)
    return ranked.select("port", "timewindow", F.col("rank").cast("long").alias("rank"))


@query("topk_rows", q.with_(_RANKED, """
    SELECT r.port, r.timewindow, r.rank, t.num_conns, round(t.mean_duration, 6) AS mean_duration
    FROM ranked r JOIN scored t ON r.port = t.port AND r.timewindow = t.timewindow WHERE r.rank <= 100"""))
def topk_rows(spark, sf_dir):
    rows = ensemble.topk_rows(ranking.rank_scores(st.scores(spark, sf_dir), k=100), st.scored_ports(spark, sf_dir))
    return rounded(rows.select("port", "timewindow", F.col("rank").cast("long").alias("rank"), "num_conns", "mean_duration"))


_KS = ", ".join(f"({k})" for k in TOP_K)
_TOPK = [*_RANKED, ("topk", f"""
    SELECT variant, day, port, k, cast(sum(CASE WHEN label THEN 1 ELSE 0 END) AS bigint) AS tp_total,
           cast(sum(CASE WHEN label THEN 0 ELSE 1 END) AS bigint) AS fp_total
    FROM ranked JOIN (VALUES {_KS}) t(k) ON rank <= k GROUP BY variant, day, port, k""")]


@query("topk_metrics", q.with_(_TOPK, "SELECT * FROM topk"))
def topk_metrics(spark, sf_dir):
    return detection.topk_report(st.scores(spark, sf_dir))


@query("topk_metrics_all_ports", q.with_(_SCORES, f"""
    SELECT k, cast(sum(CASE WHEN label THEN 1 ELSE 0 END) AS bigint) AS tp_total,
           cast(sum(CASE WHEN label THEN 0 ELSE 1 END) AS bigint) AS fp_total,
           {', '.join(f'cast(sum(CASE WHEN NOT label AND port = {p} THEN 1 ELSE 0 END) AS bigint) AS fp_{p}' for p in q.MODEL_PORTS)}
    FROM (SELECT *, row_number() OVER (ORDER BY score, port, timewindow) AS rank FROM scores) r
    JOIN (VALUES {_KS}) t(k) ON rank <= k GROUP BY k"""))
def topk_metrics_all_ports(spark, sf_dir):
    ranked = ranking.rank_all_ports(st.scores(spark, sf_dir))
    return ranking.topk_metrics_all_ports(ranked, x.PARAMS_60).drop("variant", "day")


@query("recall_at_k", q.with_(_TOPK, """
    SELECT t.port, t.k, round(tp_total / a.n, 6) AS tp_by_k, round((t.k - tp_total) / cast(t.k AS double), 6) AS fp_by_k
    FROM topk t JOIN (SELECT port, cast(sum(CASE WHEN label THEN 1 ELSE 0 END) AS double) AS n FROM scores GROUP BY port) a ON a.port = t.port"""))
def recall_at_k(spark, sf_dir):
    ranked = ranking.rank_scores(st.scores(spark, sf_dir))
    return rounded(ranking.recall_at_k(ranking.topk_metrics(ranked), ranked).select("port", "k", "tp_by_k", "fp_by_k"))


@query("percentile_table", q.with_(_PERCENTILES, "SELECT port, percentile, round(score, 6) AS score FROM percentiles"))
def percentile_table(spark, sf_dir):
    return rounded(ranking.percentile_table(st.training_scores(spark, sf_dir)))


# --- detection -----------------------------------------------------------------------------------

PERCENTILE = 10.0
_FLAGGED = [*_SCORES, *_PERCENTILES, ("judged", f"""
    SELECT s.*, round(s.score, 9) <= round(p.score, 9) AS predicted FROM scores s
    JOIN percentiles p ON p.port = s.port WHERE p.percentile = {PERCENTILE}e0""")]


def _percentiles(spark, sf_dir):
    return st.percentiles(spark, sf_dir).withColumn("score", F.round("score", 9))


def _judged(spark, sf_dir):
    return evaluation.detect(st.scored_ports(spark, sf_dir), st.scores(spark, sf_dir), _percentiles(spark, sf_dir), PERCENTILE)


@query("threshold_at_percentile", q.with_(_PERCENTILES, f"SELECT port, round(score, 6) AS threshold FROM percentiles WHERE percentile = {PERCENTILE}e0"))
def threshold_at_percentile(spark, sf_dir):
    return rounded(evaluation.threshold_at_percentile(_percentiles(spark, sf_dir), PERCENTILE))


@query("flagged_windows", q.with_(_FLAGGED, "SELECT variant, day, port, timewindow FROM judged WHERE predicted"))
def flagged_windows(spark, sf_dir):
    thresholds = evaluation.threshold_at_percentile(_percentiles(spark, sf_dir), PERCENTILE)
    return evaluation.flagged_windows(st.scores(spark, sf_dir), thresholds)


@query("relabel", q.with_(_FLAGGED, """
    SELECT t.port, t.timewindow, t.num_conns, j.predicted AS label FROM scored t
    JOIN judged j ON j.port = t.port AND j.timewindow = t.timewindow"""))
def relabel(spark, sf_dir):
    thresholds = evaluation.threshold_at_percentile(_percentiles(spark, sf_dir), PERCENTILE)
    flagged = evaluation.flagged_windows(st.scores(spark, sf_dir), thresholds)
    return evaluation.relabel(st.scored_ports(spark, sf_dir), flagged).select("port", "timewindow", "num_conns", "label")


_COUNTS = [*_FLAGGED, ("counts", """
    SELECT variant, day, port, cast(sum(CASE WHEN predicted AND label THEN 1 ELSE 0 END) AS bigint) AS tp,
           cast(sum(CASE WHEN NOT predicted AND NOT label THEN 1 ELSE 0 END) AS bigint) AS tn,
           cast(sum(CASE WHEN predicted AND NOT label THEN 1 ELSE 0 END) AS bigint) AS fp,
           cast(sum(CASE WHEN NOT predicted AND label THEN 1 ELSE 0 END) AS bigint) AS fn
    FROM judged GROUP BY variant, day, port""")]


@query("confusion", q.with_(_COUNTS, "SELECT * FROM counts"))
def confusion(spark, sf_dir):
    return evaluation.confusion(_judged(spark, sf_dir))


@query("confusion_windows", q.with_(_FLAGGED, """
    SELECT port, outcome, count(*) AS n, string_agg(cast(timewindow AS varchar), ',' ORDER BY timewindow) AS windows FROM (
      SELECT port, timewindow, CASE WHEN predicted AND label THEN 'tp' WHEN predicted THEN 'fp' WHEN label THEN 'fn' ELSE 'tn' END AS outcome
      FROM judged) o GROUP BY port, outcome"""))
def confusion_windows(spark, sf_dir):
    counts = evaluation.confusion(_judged(spark, sf_dir), lists=True)
    outcomes = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("n"), F.col(f"{o}_windows").alias("w"))
                                   for o in ("tp", "tn", "fp", "fn")])).alias("o")
    rows = counts.select("port", outcomes).select("port", "o.*").filter(F.col("n") > 0)
    return rows.select("port", "outcome", "n", F.array_join("w", ",").alias("windows"))


@query("detect", q.with_(_COUNTS, "SELECT variant, day, port, tp, tn, fp, fn FROM counts"))
def detect(spark, sf_dir):
    return detection.detection_counts(st.test_60(spark, sf_dir), st.scores(spark, sf_dir), _percentiles(spark, sf_dir),
                                      PERCENTILE, list(x.PARAMS_60.model_ports))


_WEIGHTED_COUNTS = [*_DENSITIES, *q.densities(H, "train_z", "train_densities"), *q.importance(), ("scores", """
    SELECT t.variant, t.day, t.timewindow, t.port, t.label, round(sum(i.weight * d.density) / sum(i.weight), 9) AS score
    FROM test_z t JOIN densities d ON t.port = d.port AND t.feature = d.feature AND t.z = d.z
    JOIN importance i ON i.port = t.port AND i.feature = t.feature GROUP BY t.variant, t.day, t.timewindow, t.port, t.label"""),
    ("training_scores", """
    SELECT t.day, t.timewindow, t.port, round(sum(i.weight * d.density) / sum(i.weight), 9) AS score
    FROM train_z t JOIN train_densities d ON t.port = d.port AND t.feature = d.feature AND t.z = d.z
    JOIN importance i ON i.port = t.port AND i.feature = t.feature GROUP BY t.day, t.timewindow, t.port"""), *_COUNTS]


@query("detect_weighted", q.with_(_WEIGHTED_COUNTS, "SELECT variant, day, port, tp, tn, fp, fn FROM counts"))
def detect_weighted(spark, sf_dir):
    """Weighted training scores -> percentiles -> weighted detection; rounded, so that near-equal scores tie in both engines."""
    m, weights = st.models(spark, sf_dir), x.importance(spark)
    nine = lambda scores: scores.withColumn("score", F.round("score", 9))
    limits = training.training_percentiles(nine(training.training_scores(st.train_60(spark, sf_dir), m, weights)))
    scored = nine(detection.test_scores(st.scored_ports(spark, sf_dir), m, weights))
    return detection.detection_counts(st.test_60(spark, sf_dir), scored, nine(limits), PERCENTILE, list(x.PARAMS_60.model_ports))


@query("detect_searched_bandwidth")
def detect_searched_bandwidth(spark, sf_dir):
    """Training, scoring and thresholding with bandwidths searched per (port, feature) on one-minute windows."""
    train, test = st.train_60(spark, sf_dir), st.scored_ports(spark, sf_dir)
    m = training.train(train, x.PARAMS_60)
    percentiles = training.training_percentiles(training.training_scores(train, m))
    return detection.detection_counts(test, detection.test_scores(test, m), percentiles, PERCENTILE,
                                      list(x.PARAMS_60.model_ports))


def _confusion_counts(spark, sf_dir):
    return evaluation.confusion(_judged(spark, sf_dir)).drop("variant", "day")


@query("classification_scores", q.with_(_COUNTS, """
    SELECT port, tp, tn, fp, fn, round((tp + tn) / cast(tp + tn + fp + fn AS double), 6) AS accuracy,
           round(tp / nullif(cast(tp + fp AS double), 0), 6) AS precision, round(tp / nullif(cast(tp + fn AS double), 0), 6) AS recall,
           round(2 * tp / nullif(cast(2 * tp + fp + fn AS double), 0), 6) AS f1 FROM counts"""))
def classification_scores(spark, sf_dir):
    return rounded(evaluation.classification_scores(_confusion_counts(spark, sf_dir)))


@query("rates_at_threshold", q.with_(_COUNTS, """
    SELECT port, tp, tn, fp, fn, round(fp / nullif(cast(fp + tn AS double), 0), 6) AS fpr, round(tp / nullif(cast(tp + fn AS double), 0), 6) AS tpr,
           round(tp / nullif(cast(tp + fp AS double), 0), 6) AS precision, round(tp / nullif(cast(tp + fn AS double), 0), 6) AS recall FROM counts"""))
def rates_at_threshold(spark, sf_dir):
    return rounded(evaluation.rates_at_threshold(_confusion_counts(spark, sf_dir)))


# --- curves and sweeps ------------------------------------------------------------------------------

_STEPS = [*_SCORES, ("steps", """
    SELECT *, sum(stp) OVER w AS tp, sum(sfp) OVER w AS fp, row_number() OVER w AS step,
           lead(stp) OVER w AS next_tp, lead(sfp) OVER w AS next_fp, sum(stp) OVER (PARTITION BY port) AS pos,
           sum(sfp) OVER (PARTITION BY port) AS neg, count(*) OVER (PARTITION BY port) AS steps
    FROM (SELECT port, score, cast(sum(CASE WHEN label THEN 1 ELSE 0 END) AS double) AS stp,
                 cast(sum(CASE WHEN label THEN 0 ELSE 1 END) AS double) AS sfp FROM scores GROUP BY port, score) s
    WINDOW w AS (PARTITION BY port ORDER BY score)""")]


@query("roc_points", q.with_(_STEPS, """
    SELECT port, round(score, 6) AS threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM steps
    WHERE step = 1 OR step = steps OR stp <> next_tp OR sfp <> next_fp
    UNION ALL SELECT DISTINCT port, cast(NULL AS double), 0e0, 0e0 FROM steps"""))
def roc_points(spark, sf_dir):
    return rounded(evaluation.roc_points(st.scores(spark, sf_dir), ["port"]))


@query("pr_points", q.with_(_STEPS, """
    SELECT port, round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM steps WHERE tp - stp < pos
    UNION ALL SELECT DISTINCT port, cast(NULL AS double), 1e0, 0e0 FROM steps"""))
def pr_points(spark, sf_dir):
    return rounded(evaluation.pr_points(st.scores(spark, sf_dir), ["port"]))


@query("auc", q.with_(_STEPS, """
    SELECT port, round(sum(sfp / neg * (tp - stp + tp) / 2 / pos), 6) AS roc_auc,
           round(sum(stp / pos * (tp / (tp + fp) + CASE WHEN step = 1 THEN 1 ELSE (tp - stp) / nullif(tp - stp + fp - sfp, 0) END) / 2), 6) AS pr_auc
    FROM steps GROUP BY port"""))
def auc(spark, sf_dir):
    return rounded(evaluation.auc(st.scores(spark, sf_dir), ["port"]))


def _two_variants(spark, sf_dir):
    """The windows of the test day as two variants, even and odd."""
    return st.scores(spark, sf_dir).withColumn("variant", F.when(F.col("timewindow") % 2 == 0, "even").otherwise("odd"))


_DAY = "variant, day, port"
_STEPS_BY_DAY = [*_SCORES, ("steps", f"""
    SELECT *, sum(stp) OVER w AS tp, sum(sfp) OVER w AS fp, row_number() OVER w AS step, lead(stp) OVER w AS next_tp,
           lead(sfp) OVER w AS next_fp, nullif(sum(stp) OVER (PARTITION BY {_DAY}), 0) AS pos,
           nullif(sum(sfp) OVER (PARTITION BY {_DAY}), 0) AS neg, count(*) OVER (PARTITION BY {_DAY}) AS steps
    FROM (SELECT CASE WHEN timewindow % 2 = 0 THEN 'even' ELSE 'odd' END AS variant, day, port, score,
                 cast(sum(CASE WHEN label THEN 1 ELSE 0 END) AS double) AS stp,
                 cast(sum(CASE WHEN label THEN 0 ELSE 1 END) AS double) AS sfp FROM scores GROUP BY ALL) s
    WINDOW w AS (PARTITION BY {_DAY} ORDER BY score)""")]


@query("roc_points_by_day", q.with_(_STEPS_BY_DAY, f"""
    SELECT {_DAY}, round(score, 6) AS threshold, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM steps
    WHERE step = 1 OR step = steps OR stp <> next_tp OR sfp <> next_fp
    UNION ALL SELECT DISTINCT {_DAY}, cast(NULL AS double), 0e0, 0e0 FROM steps"""))
def roc_points_by_day(spark, sf_dir):
    return rounded(evaluation.roc_points(_two_variants(spark, sf_dir)))


@query("auc_by_day", q.with_(_STEPS_BY_DAY, f"""
    SELECT {_DAY}, round(sum(sfp / neg * (tp - stp + tp) / 2 / pos), 6) AS roc_auc,
           round(sum(stp / pos * (tp / (tp + fp) + CASE WHEN step = 1 THEN 1 ELSE (tp - stp) / nullif(tp - stp + fp - sfp, 0) END) / 2), 6) AS pr_auc
    FROM steps GROUP BY {_DAY}"""))
def auc_by_day(spark, sf_dir):
    return rounded(evaluation.auc(_two_variants(spark, sf_dir)))


RELATIVE = [i / 20 for i in range(21)]
_SWEEP = [*_SCORES, ("edges", "SELECT port, min(score) AS lo, max(score) AS hi FROM scores GROUP BY port"), ("swept", f"""
    SELECT s.port, t, lo + t * (hi - lo) AS threshold,
           cast(sum(CASE WHEN score > lo + t * (hi - lo) AND NOT label THEN 1 ELSE 0 END) AS bigint) AS tn,
           cast(sum(CASE WHEN score <= lo + t * (hi - lo) AND NOT label THEN 1 ELSE 0 END) AS bigint) AS fp,
           cast(sum(CASE WHEN score > lo + t * (hi - lo) AND label THEN 1 ELSE 0 END) AS bigint) AS fn,
           cast(sum(CASE WHEN score <= lo + t * (hi - lo) AND label THEN 1 ELSE 0 END) AS bigint) AS tp
    FROM scores s JOIN edges e ON e.port = s.port CROSS JOIN (VALUES {', '.join(f'({t}e0)' for t in RELATIVE)}) r(t)
    GROUP BY s.port, t, lo, hi""")]
_RATES = """round(fp / cast(fp + tn AS double), 6) AS fpr, round(tp / cast(tp + fn AS double), 6) AS tpr,
    round(tp / nullif(cast(tp + fp AS double), 0), 6) AS precision, round(tp / cast(tp + fn AS double), 6) AS recall"""


@query("threshold_sweep", q.with_(_SWEEP, f"SELECT port, t, round(threshold, 6) AS threshold, tn, fp, fn, tp, {_RATES} FROM swept"))
def threshold_sweep(spark, sf_dir):
    return rounded(evaluation.threshold_sweep(st.scores(spark, sf_dir), RELATIVE, ["port"]))


@query("sweep_curves", q.with_(_SWEEP, f"""
    SELECT port, 'roc' AS curve, t, fpr AS a, tpr AS b FROM (SELECT *, {_RATES} FROM swept) r
    UNION ALL SELECT port, 'pr', t, precision, recall FROM (SELECT *, {_RATES} FROM swept) r
    UNION ALL SELECT port, 'roc', cast(NULL AS double), 0e0, 0e0 FROM edges UNION ALL SELECT port, 'pr', cast(NULL AS double), 1e0, 0e0 FROM edges"""))
def sweep_curves(spark, sf_dir):
    return rounded(evaluation.sweep_curves(evaluation.threshold_sweep(st.scores(spark, sf_dir), RELATIVE, ["port"]), ["port"]))


@query("adaptive_thresholds", q.with_([*_SCORES, ("e0", """
    SELECT port, min(score) AS lo, max(score) AS hi, min(CASE WHEN label THEN score END) AS first, max(CASE WHEN label THEN score END) AS last
    FROM scores GROUP BY port"""),
    ("e1", "SELECT port, lo, CASE WHEN last >= hi THEN last + 1e-5 ELSE hi END AS hi, CASE WHEN first = last THEN first - 1e-5 ELSE first END AS first, last FROM e0"),
    ("e2", "SELECT port, CASE WHEN first <= lo THEN first - 1e-5 ELSE lo END AS lo, hi, first, last FROM e1"),
    ("cuts", """SELECT port, lo + i * ((first - lo) / 100) AS threshold FROM e2 CROSS JOIN range(100) r(i)
                UNION ALL SELECT port, first + i * ((last - first) / 100) FROM e2 CROSS JOIN range(100) r(i)
                UNION ALL SELECT port, last + i * ((hi - last) / 100) FROM e2 CROSS JOIN range(100) r(i)""")], """
    SELECT c.port, round(threshold, 6) AS threshold,
           round(sum(CASE WHEN score < threshold AND NOT label THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN NOT label THEN 1e0 ELSE 0e0 END), 6) AS fpr,
           round(sum(CASE WHEN score < threshold AND label THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN label THEN 1e0 ELSE 0e0 END), 6) AS tpr
    FROM cuts c JOIN scores s ON s.port = c.port GROUP BY c.port, threshold
    UNION ALL SELECT port, cast(NULL AS double), 1e0, 1e0 FROM e2"""))
def adaptive_thresholds(spark, sf_dir):
    return rounded(evaluation.adaptive_roc(st.scores(spark, sf_dir), ["port"]))


@query("sort_importance_desc", q.with_([*q.features(3600)], f"""
    SELECT port, feature, row_number() OVER (PARTITION BY port ORDER BY round(x, 4) DESC, feature) AS place FROM (
      SELECT port, feature, max(x) AS x FROM ({q.long('features', 'port')}) l GROUP BY port, feature) m"""))
def sort_importance_desc(spark, sf_dir):
    """One row per feature and port: a port's features are a fixed, small group."""
    from pyspark.sql import Window as W

    long = scaling.unpivot_features(window_features(spark, sf_dir), ["port"])
    top = long.groupBy("port", "feature").agg(F.round(F.max("x"), 4).alias("x"))
    place = F.row_number().over(W.partitionBy("port").orderBy(F.desc("x"), "feature"))
    return top.select("port", "feature", place.cast("long").alias("place"))

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborwatch.operators import evaluation as ev
from harborwatch.operators import ranking as rk
from harborwatch.schema import PERCENTILES, TOP_K, Params
from tests.helpers import day

SCORES = "day date, timewindow int, port int, score double, label boolean"


def score_frame(spark, rows, port=22):
    return spark.createDataFrame([(day(3), i, port, float(s), bool(a)) for i, (s, a) in enumerate(rows)], SCORES)


def random_scores(n, seed, ties=30):
    rng = random.Random(seed)
    return [(rng.randrange(ties) / 10, rng.random() < 0.3) for _ in range(n)]


FOUR = [(6.7041, False), (6.7792, False), (6.8432, False), (6.4588, False)]


def test_ranks_and_percentiles_of_four_scores(spark):
    df = score_frame(spark, FOUR, port=23)
    assert [(r.timewindow, r["rank"]) for r in rk.rank_scores(df).orderBy("rank").collect()] == [(3, 1), (0, 2), (1, 3), (2, 4)]
    got = {r.percentile: r.score for r in rk.percentile_table(df).collect()}
    assert len(got) == 111 and (got[0.0], got[100.0]) == (6.4588, 6.8432)
    assert got[5.0] == pytest.approx(np.percentile([s for s, _ in FOUR], 5))


def test_percentiles_match_numpy(spark):
    a, b = random_scores(501, 1), random_scores(77, 2, ties=1000)
    table = rk.percentile_table(score_frame(spark, a).unionByName(score_frame(spark, b, port=80)))
    got = {(r.port, r.percentile): r.score for r in table.collect()}
    for port, rows in ((22, a), (80, b)):
        want = np.percentile([s for s, _ in rows], PERCENTILES)
        assert [got[(port, p)] for p in PERCENTILES] == pytest.approx(list(want), abs=1e-12)


def test_equal_scores_rank_by_window(spark):
    df = score_frame(spark, [(1, False), (0, False), (1, True), (0, True)])
    assert [r.timewindow for r in rk.rank_scores(df).orderBy("rank").collect()] == [1, 3, 0, 2]
    assert [r.timewindow for r in rk.rank_training_scores(df).orderBy("rank").collect()] == [1, 3, 0, 2]


def test_top_k_beyond_the_last_window_shows_totals(spark):
    rows = [(1, True), (2, False), (3, True), (4, False), (5, False)]
    ranked = rk.rank_scores(score_frame(spark, rows))
    got = {r.k: (r.tp_total, r.fp_total) for r in rk.topk_metrics(ranked, [1, 3, 5, 9]).collect()}
    assert got == {1: (1, 0), 3: (2, 1), 5: (2, 3), 9: (2, 3)}
    full = rk.topk_metrics(ranked).collect()
    assert len(full) == len(TOP_K) == 39 and all(r.tp_total + r.fp_total == min(r.k, 5) for r in full)
    shares = {r.k: (r.tp_by_k, r.fp_by_k) for r in rk.recall_at_k(rk.topk_metrics(ranked, [1, 3]), ranked).collect()}
    assert shares == {1: (0.5, 0.0), 3: (1.0, pytest.approx(1 / 3))}


def test_top_k_over_all_ports(spark):
    df = score_frame(spark, [(1, True), (4, False)]).unionByName(score_frame(spark, [(2, False), (3, True)], port=80))
    got = {r.k: (r.tp_total, r.fp_total, r.fp_22, r.fp_80) for r in
           rk.topk_metrics_all_ports(rk.rank_all_ports(df), Params(), [1, 2, 4]).collect()}
    assert got == {1: (1, 0, 0, 0), 2: (1, 1, 0, 1), 4: (2, 2, 1, 1)}


def test_detection_counts_lists_and_relabel(spark):
    features = score_frame(spark, [(0, True), (0, False), (0, True), (0, False)]).drop("score")
    scores = score_frame(spark, [(1, True), (2, False), (3, True), (4, False)])
    percentiles = spark.createDataFrame([(22, 10.0, 2.0), (22, 50.0, 9.0)], "port int, percentile double, score double")
    judged = ev.detect(features, scores, percentiles, 10.0)
    r = ev.confusion(judged, lists=True).first()
    assert (r.tp, r.tn, r.fp, r.fn) == (1, 1, 1, 1)
    assert (r.tp_windows, r.tn_windows, r.fp_windows, r.fn_windows) == ([0], [3], [1], [2])
    s = ev.classification_scores(ev.confusion(judged)).first()
    assert (s.accuracy, s.precision, s.recall, s.f1) == (0.5, 0.5, 0.5, 0.5)
    flagged = ev.flagged_windows(scores, ev.threshold_at_percentile(percentiles, 10.0))
    assert [x.label for x in ev.relabel(features, flagged).orderBy("timewindow").collect()] == [True, True, False, False]


def brute_steps(rows):
    by = defaultdict(lambda: [0, 0])
    for s, a in rows:
        by[s][0 if a else 1] += 1
    tp = fp = 0
    out = []
    for s in sorted(by):
        tp, fp = tp + by[s][0], fp + by[s][1]
        out.append((s, tp, fp))
    return out


@pytest.mark.parametrize("n,seed", [(5, 1), (400, 2)])
def test_curves_match_a_loop(spark, n, seed):
    rows = random_scores(n, seed) if n > 5 else [(1, True), (2, False), (3, True), (4, False), (5, False)]
    df = score_frame(spark, rows)
    steps = brute_steps(rows)
    pos, neg = sum(a for _, a in rows), sum(not a for _, a in rows)
    roc = sorted((r.fpr, r.tpr) for r in ev.roc_points(df, drop_collinear=False).collect())
    want = sorted([(0.0, 0.0)] + [(f / neg, t / pos) for _, t, f in steps])
    assert np.allclose(roc, want, rtol=0, atol=1e-12)
    pr = {r.threshold: (r.precision, r.recall) for r in ev.pr_points(df).collect()}
    want = {None: (1.0, 0.0)}
    for s, t, f in steps:
        want[s] = (t / (t + f), t / pos)
        if t == pos:
            break
    assert pr == {k: pytest.approx(v) for k, v in want.items()}
    pts = [(0.0, 0.0)] + [(f / neg, t / pos) for _, t, f in steps]
    prs = [(0.0, 1.0)] + [(t / pos, t / (t + f)) for _, t, f in steps]
    area = lambda p: sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(p, p[1:]))
    r = ev.auc(df).first()
    assert (r.roc_auc, r.pr_auc) == pytest.approx((area(pts), area(prs)))


def test_collinear_points_are_dropped(spark):
    df = score_frame(spark, [(1, True), (2, True), (3, True), (4, False), (5, False)])
    kept = ev.roc_points(df).orderBy("fpr", "tpr").collect()
    # The second-difference rule looks at steps 2..n-1; steps 2 and 4 continue in the direction they came.
    assert [(r.fpr, round(r.tpr, 6)) for r in kept] == [(0.0, 0.0), (0.0, round(1 / 3, 6)), (0.0, 1.0), (1.0, 1.0)]
    area = lambda rows: np.trapezoid([r.tpr for r in rows], [r.fpr for r in rows])
    full = ev.roc_points(df, drop_collinear=False).orderBy("fpr", "tpr").collect()
    assert area(kept) == pytest.approx(area(full))


def test_relative_thresholds(spark):
    rows = random_scores(200, 5)
    ts = [0.0, 0.3, 0.5, 1.0]
    got = {r.t: (r.tn, r.fp, r.fn, r.tp) for r in ev.threshold_sweep(score_frame(spark, rows), ts).collect()}
    low, high = min(s for s, _ in rows), max(s for s, _ in rows)
    for t in ts:
        cut = low + t * (high - low)
        tp = sum(a and s <= cut for s, a in rows)
        fp = sum((not a) and s <= cut for s, a in rows)
        pos = sum(a for _, a in rows)
        assert got[t] == (len(rows) - pos - fp, fp, pos - tp, tp)
    curves = ev.sweep_curves(ev.threshold_sweep(score_frame(spark, rows), ts)).collect()
    starts = {r.curve: (r.a, r.b) for r in curves if r.t is None}
    assert starts == {"roc": (0.0, 0.0), "pr": (1.0, 0.0)} and len(curves) == 10


def test_sweep_of_many_groups_and_equal_cuts(spark):
    rows = [(f"v{i}", float((i * 7 + k * k) % 5), k % 2 == 0) for i in range(3000) for k in range(3)]
    rows += [("flat", 2.0, True), ("flat", 2.0, False), ("flat", None, True)]
    df = spark.createDataFrame(rows, "variant string, score double, label boolean")
    swept = ev.threshold_sweep(df, [0.0, 0.5, 1.0], ["variant"])
    got = {(r.variant, r.t): (r.tn, r.fp, r.fn, r.tp) for r in swept.collect()}
    by = {}
    for v, s, a in rows:
        by.setdefault(v, []).append((s, a))
    assert len(got) == 3 * len(by)
    for (v, t), counts in got.items():
        known = [s for s, _ in by[v] if s is not None]
        cut = min(known) + t * (max(known) - min(known))
        flagged = [(s is not None and s <= cut, a) for s, a in by[v]]
        assert counts == tuple(sum(f == p and a == l for f, a in flagged) for p, l in ((0, 0), (1, 0), (0, 1), (1, 1)))
    plan = swept._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_adaptive_thresholds(spark):
    rows = random_scores(150, 6)
    df = score_frame(spark, rows)
    cuts = ev.adaptive_thresholds(df).first().cuts
    assert len(cuts) == 300 and cuts == sorted(cuts)
    points = ev.adaptive_roc(df).collect()
    assert len(points) == 301 and sum(r.threshold is None and (r.fpr, r.tpr) == (1.0, 1.0) for r in points) == 1
    pos, neg = sum(a for _, a in rows), sum(not a for _, a in rows)
    for r in points:
        if r.threshold is not None:
            assert r.tpr == pytest.approx(sum(a and s < r.threshold for s, a in rows) / pos)
            assert r.fpr == pytest.approx(sum((not a) and s < r.threshold for s, a in rows) / neg)
    one = ev.adaptive_thresholds(score_frame(spark, [(1, True), (5, False)])).first().cuts
    assert one[0] == pytest.approx(1 - 2e-5) and max(one) < 5


def test_groups_are_kept_apart_by_variant(spark):
    a = score_frame(spark, [(1, True), (2, False)]).withColumn("variant", F.lit("a"))
    b = score_frame(spark, [(5, False), (6, True)]).withColumn("variant", F.lit("b"))
    ranked = rk.rank_scores(a.unionByName(b))
    assert sorted((r.variant, r["rank"]) for r in ranked.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert ev.roc_points(a.unionByName(b), ["variant", "port"]).select("variant").distinct().count() == 2

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborwatch.functions.normal import normal_cdf
from harborwatch.operators import ensemble, forest, importance, kde, ranking, scaling, vectors
from harborwatch.operators.ordering import ordinals, window_ordinals
from harborwatch.plans import isolation, training
from harborwatch.schema import MODEL_FEATURES, Params
from tests.helpers import day, feature_frame

P = Params()
CONTINUOUS = ["num_conns", "mean_duration", "variance_orig_bytes"]


def windows(spark, n_days=4, per_day=30, ports=(22, 80), seed=0, label=lambda d, t: False):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(n_days):
        for t in range(per_day):
            for port in ports:
                values = {"num_conns": int(rng.integers(0, 6)), "mean_duration": float(rng.exponential(3)),
                          "variance_orig_bytes": float(rng.normal(500, 100) ** 2) if t % 3 else 0.0,
                          "S0_count": int(rng.integers(0, 3)), "external_ips": int(rng.integers(0, 9))}
                rows.append((date(2024, 1, 2) + timedelta(days=d), t, port, values, bool(label(d, t))))
    return feature_frame(spark, rows)


def matrix(df, columns, port):
    rows = df.filter(F.col("port") == port).orderBy("day", "timewindow").collect()
    return np.array([[float(r[c]) for c in columns] for r in rows])


def bounds(x):
    return np.minimum(x.min(0), 0), np.maximum(x.max(0), 5 * x.max(0))


def scaled(x, low, high):
    return (x - low) / np.where(high == low, 1, high - low)


def gauss(t, x, h):
    return np.exp(-((t[:, None] - x[None, :]) / h) ** 2 / 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi))


def test_scaler_bounds_and_constant_feature(spark):
    df = feature_frame(spark, [(day(2), 0, 22, {"num_conns": 3}, False), (day(2), 1, 22, {"num_conns": 4}, False)])
    got = {r.feature: (r.lo, r.hi) for r in scaling.scaler_fit(df, P).collect()}
    assert len(got) == 35 and got["num_conns"] == (0.0, 20.0) and got["SH_count"] == (0.0, 0.0)
    z = {r.timewindow: r.z for r in scaling.scaled_long(df, scaling.scaler_fit(df, P), ["timewindow", "port"])
         .filter("feature = 'SH_count'").collect()}
    assert z == {0: 0.0, 1: 0.0}
    plain = {r.feature: (r.lo, r.hi) for r in scaling.scaler_fit(df, Params(scaler_bounded=False)).collect()}
    assert plain["num_conns"] == (3.0, 4.0)


def support_of(spark, values, h):
    df = spark.createDataFrame([(22, "f", float(z), float(h)) for z in values], "port int, feature string, z double, bandwidth double")
    return kde.kde_support(df, ["port", "feature"])


def score(spark, targets, support, fn=kde.kde_score, column="density"):
    t = spark.createDataFrame([(22, "f", float(z)) for z in targets], "port int, feature string, z double")
    got = {r.z: r[column] for r in fn(t.distinct(), support, ["port", "z"]).collect()}
    return np.array([got[float(z)] for z in targets])


def test_density_by_hand(spark):
    support = support_of(spark, [0, 1], 0.5)
    got = score(spark, [0, 0.5, 10], support)
    one = 1 / (0.5 * math.sqrt(2 * math.pi))
    assert got[:2] == pytest.approx([one * (1 + math.exp(-2)) / 2, one * math.exp(-0.5)], rel=1e-14)
    assert 0 <= got[2] < 1e-60


@pytest.mark.parametrize("h", [1 / 49, 0.1, 0.5, 1.0])
def test_density_equals_the_pairwise_sum_over_the_whole_range(spark, h):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.random(400) ** 3, np.zeros(300), [1.0]])
    targets = np.concatenate([np.linspace(0, 1, 60), rng.random(40)])
    support = support_of(spark, x, h)
    assert support.count() <= max(1 / h**2, kde.REACH / h) + 2
    assert score(spark, targets, support) == pytest.approx(gauss(targets, x, h), rel=1e-12)


def test_far_tail_keeps_its_relative_size(spark):
    h = 1 / 49
    got = score(spark, [0.7, 0.75], support_of(spark, [0.0, 0.003, 0.01], h))
    want = gauss(np.array([0.7, 0.75]), np.array([0.0, 0.003, 0.01]), h)
    assert want[1] < 1e-270
    assert got == pytest.approx(want, rel=1e-10)


@pytest.mark.parametrize("h", [1 / 49, 0.03, 0.2, 1.0])
def test_density_off_the_fitted_scale(spark, h):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random(11), [0.0, 1.0]])
    targets = np.concatenate([np.linspace(-3, 20, 70), [1 + 30 * h, -20 * h]])
    got, want = score(spark, targets, support_of(spark, x, h)), gauss(targets, x, h)
    big = want > 1e-280
    assert got[big] == pytest.approx(want[big], rel=1e-10) and (got >= 0).all() and (got[~big] < 1e-270).all()


def test_search_with_boxes_repeated_for_salts(spark, monkeypatch):
    table = windows(spark, n_days=3, per_day=15, seed=21)
    scaler = scaling.scaler_fit(table, P)
    pick = lambda: sorted(map(tuple, kde.kde_bandwidth_cv(table, scaler, CONTINUOUS).collect()))
    sent = pick()
    monkeypatch.setattr(kde, "BROADCAST_BOXES", 0)
    for a, b in zip(sent, pick(), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-12)


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(2)
    grid = np.linspace(-1, 2, 1501)
    values = score(spark, grid, support_of(spark, rng.random(50), 0.1))
    assert np.trapezoid(values, grid) == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("h", [1 / 49, 0.2, 1.0])
def test_tail_probability(spark, h):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random(100), np.zeros(40)])
    targets = np.linspace(0, 1, 41)
    want = [np.mean([0.5 * math.erfc((t - v) / h / math.sqrt(2)) for v in x]) for t in targets]
    got = score(spark, targets, support_of(spark, x, h), kde.kde_ccdf, "tail")
    assert got == pytest.approx(want, abs=1e-9)


def test_normal_cdf_column(spark):
    zs = np.linspace(-39, 39, 1001)
    df = spark.createDataFrame([(float(z),) for z in zs], "z double")
    got = {r.z: r.p for r in df.select("z", normal_cdf(F.col("z")).alias("p")).collect()}
    for z in zs:
        want = 0.5 * math.erfc(-z / math.sqrt(2))
        assert got[float(z)] == pytest.approx(want, rel=0, abs=1e-15)


def test_bandwidth_below_the_grid_is_refused(spark):
    with pytest.raises(Exception, match="bandwidth below"):
        support_of(spark, [0.1], 0.001).collect()


def cv_scores(z, candidates):
    half = math.ceil(len(z) / 2)
    a, b = z[:half], z[half:]

    def held_out(t, x, h):
        e = -((t[:, None] - x[None, :]) / h) ** 2 / 2
        top = e.max(1)
        return (top + np.log(np.exp(e - top[:, None]).sum(1)) - math.log(len(x) * h * math.sqrt(2 * math.pi))).sum()

    return [np.mean([held_out(a, b, h), held_out(b, a, h)]) for h in candidates]


@pytest.mark.parametrize("bounded", [True, False])
def test_bandwidth_search(spark, bounded):
    p = Params(scaler_bounded=bounded)
    train = windows(spark, seed=4)
    scaler = scaling.scaler_fit(train, p, CONTINUOUS)
    got = {(r.port, r.feature, round(r.bandwidth * 49)): r.score
           for r in kde.bandwidth_scores(train, scaler, CONTINUOUS).collect()}
    best = {(r.port, r.feature): round(r.bandwidth * 49) for r in kde.kde_bandwidth_cv(train, scaler, CONTINUOUS).collect()}
    for port in (22, 80):
        x = matrix(train, CONTINUOUS, port)
        low, high = bounds(x) if bounded else (x.min(0), x.max(0))
        z = scaled(x, low, high)
        for i, c in enumerate(CONTINUOUS):
            want = cv_scores(z[:, i], kde.BANDWIDTHS)
            assert [got[(port, c, k)] for k in range(1, 50)] == pytest.approx(want, rel=1e-9)
            assert best[(port, c)] == int(np.argmax(want)) + 1


def test_bandwidth_search_with_an_isolated_value(spark):
    """One window lies 49 bandwidths away from all others: its log-density must not vanish."""
    rows = [(date(2024, 1, 2), t, 22, {"mean_duration": 0.001 * t}, False) for t in range(20)]
    rows.append((date(2024, 1, 3), 0, 22, {"mean_duration": 1000.0}, False))
    train = feature_frame(spark, rows)
    scaler = scaling.scaler_fit(train, Params(scaler_bounded=False), ["mean_duration"])
    got = {round(r.bandwidth * 49): r.score for r in kde.bandwidth_scores(train, scaler, ["mean_duration"]).collect()}
    x = matrix(train, ["mean_duration"], 22)
    want = cv_scores(scaled(x, x.min(0), x.max(0))[:, 0], kde.BANDWIDTHS)
    assert [got[k] for k in range(1, 50)] == pytest.approx(want, rel=1e-9)


def test_ensembles_match_numpy(spark):
    train, test = windows(spark, seed=5), windows(spark, n_days=1, seed=6)
    models = training.train(train, P, CONTINUOUS, bandwidth=0.1)
    weights = spark.createDataFrame([(p, c, w) for p in (22, 80) for c, w in zip(CONTINUOUS[:2], (0.7, 0.2))],
                                    "port int, feature string, weight double")
    mean = ensemble.ensemble_scores(test, models.scaler, models.support, columns=CONTINUOUS)
    weighted = ensemble.ensemble_scores(test, models.scaler, models.support, weights, columns=CONTINUOUS)
    spread = ensemble.score_spread(
        ensemble.feature_densities(test, models.scaler, models.support, CONTINUOUS), ["timewindow", "port"])
    for port in (22, 80):
        x, t = matrix(train, CONTINUOUS, port), matrix(test, CONTINUOUS, port)
        low, high = bounds(x)
        d = np.stack([gauss(scaled(np.minimum(t, high), low, high)[:, i], scaled(x, low, high)[:, i], 0.1) for i in range(3)], 1)
        pick = lambda df, c: [r[c] for r in df.filter(F.col("port") == port).orderBy("timewindow").collect()]
        assert pick(mean, "score") == pytest.approx(d.mean(1), rel=1e-10)
        assert pick(weighted, "score") == pytest.approx((0.7 * d[:, 0] + 0.2 * d[:, 1]) / 0.9, rel=1e-10)
        assert pick(spread, "std") == pytest.approx(d.std(1, ddof=1), rel=1e-9)


def test_equal_windows_get_equal_scores_and_missing_ports_none(spark):
    train = windows(spark, seed=7, ports=(22,))
    rows = [(day(9), t, p, {"num_conns": 2, "mean_duration": 1.7}, False) for t in range(50) for p in (22, 443)]
    models = training.train(train, P, bandwidth=0.05)
    scores = ensemble.ensemble_scores(feature_frame(spark, rows), models.scaler, models.support).collect()
    assert len(scores) == 50 and len({r.score for r in scores}) == 1


def test_tails_of_ranked_windows(spark):
    train, test = windows(spark, seed=8), windows(spark, n_days=1, seed=9)
    models = training.train(train, P, CONTINUOUS, bandwidth=0.1)
    scores = ensemble.ensemble_scores(test, models.scaler, models.support, columns=CONTINUOUS)
    ranked = ranking.rank_scores(scores, k=5)
    tails = ensemble.ensemble_tails(ranked, test, models.scaler, models.support, columns=CONTINUOUS).collect()
    assert len(tails) == 10 and all(0 <= r.normalized_score <= 1 and r["rank"] <= 5 for r in tails)


# --- vectors ---------------------------------------------------------------------------

def test_vector_density(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)  # several blocks per port
    train, test = windows(spark, seed=10), windows(spark, n_days=1, seed=11)
    scaler = scaling.scaler_fit(train, P, CONTINUOUS)
    hs = {22: [0.2], 80: [0.3, 0.1, 0.5]}
    bandwidths = spark.createDataFrame(list(hs.items()), "port int, h array<double>")
    got = vectors.vector_kde_score(test, train, scaler, bandwidths, CONTINUOUS)
    for port, h in hs.items():
        x, t = matrix(train, CONTINUOUS, port), matrix(test, CONTINUOUS, port)
        low, high = bounds(x)
        a, b = scaled(t, low, high), scaled(x, low, high)
        k = np.prod(np.exp(-((a[:, None, :] - b[None, :, :]) / h) ** 2 / 2) / (np.broadcast_to(h, 3) * math.sqrt(2 * math.pi)), axis=2)
        rows = got.filter(F.col("port") == port).orderBy("timewindow").collect()
        assert [r.log_density for r in rows] == pytest.approx(np.log(k.mean(1)), rel=1e-9)
        assert [r.score for r in rows] == pytest.approx(k.mean(1), rel=1e-9)


def test_vector_bandwidth_search(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    candidates = [1 / 49, 0.05, 0.1, 0.4]
    train = windows(spark, n_days=3, per_day=15, seed=12)
    scaler = scaling.scaler_fit(train, P, CONTINUOUS)
    got = {r.port: r for r in vectors.vector_bandwidth_cv(train, scaler, CONTINUOUS, candidates).collect()}
    for port in (22, 80):
        x = matrix(train, CONTINUOUS, port)
        z = scaled(x, *bounds(x))
        half = math.ceil(len(z) / 2)

        def held_out(t, r, h):
            e = -(((t[:, None, :] - r[None, :, :]) / h) ** 2).sum(2) / 2
            top = e.max(1)
            return (top + np.log(np.exp(e - top[:, None]).sum(1)) - math.log(len(r)) - 3 * math.log(h * math.sqrt(2 * math.pi))).sum()

        want = [np.mean([held_out(z[:half], z[half:], h), held_out(z[half:], z[:half], h)]) for h in candidates]
        assert got[port].bandwidth == pytest.approx(candidates[int(np.argmax(want))])
        assert got[port].score == pytest.approx(max(want), rel=1e-9)


def test_leave_one_out_bandwidths(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    grid = [(0.05, 0.05), (0.1, 0.3), (0.5, 0.2)]
    pair = ["mean_duration", "external_ips"]
    train = windows(spark, n_days=2, per_day=20, seed=13)
    scaler = scaling.scaler_fit(train, P, pair)
    got = {r.port: r for r in vectors.pair_bandwidth_ml(train, scaler, pair, grid).collect()}
    for port in (22, 80):
        x = matrix(train, pair, port)
        z = scaled(x, *bounds(x))
        want = []
        for h in grid:
            k = np.exp(-(((z[:, None, :] - z[None, :, :]) / h) ** 2).sum(2) / 2)
            np.fill_diagonal(k, 0)
            want.append((np.log(k.sum(1)) - math.log(h[0] * h[1])).sum())
        assert tuple(got[port].h) == grid[int(np.argmax(want))]
        assert got[port].score == pytest.approx(max(want), rel=1e-9)
    with pytest.raises(ValueError):
        vectors.pair_bandwidth_ml(train, scaler, CONTINUOUS)


# --- forests -------------------------------------------------------------------------------

def plain_tree(rows, tree, max_features, key):
    """Nodes {number: (size, feature, cut)} of one tree, node by node."""
    seed, port, model = key
    n = rows.shape[1]

    def order(base):
        def place(f):
            s = (base % forest.PRIME + (f + 1) * forest.STEP) % forest.PRIME * forest.FACTOR % forest.PRIME
            return (s * s + f + 1) % forest.PRIME, f
        return sorted(range(n), key=place)

    usable = order(forest.number(seed, "columns", port, model, tree, 0))[:max_features]
    nodes = {}

    def grow(part, k, depth):
        nodes[k] = (len(part), None, None)
        low, high = part.min(axis=0), part.max(axis=0)
        base = forest.number(seed, "node", port, model, tree, k)
        by = next((f for f in order(base) if f in usable and high[f] > low[f] + forest.CONSTANT), None)
        if by is None or len(part) == 1 or depth == forest.depth_limit(len(rows)):
            return
        cut = low[by] + (high[by] - low[by]) * (base // forest.PRIME / forest.SHARES)
        nodes[k] = (len(part), by, cut)
        grow(part[part[:, by] <= cut], 2 * k, depth + 1)
        grow(part[part[:, by] > cut], 2 * k + 1, depth + 1)

    grow(rows, 1, 0)
    return nodes


def walk(nodes, row, k=1, depth=0):
    size, by, cut = nodes[k]
    if by is None:
        return depth + float(forest.average_path(np.array([size]))[0])
    return walk(nodes, row, 2 * k + (row[by] > cut), depth + 1)


def test_level_wise_growth_equals_node_by_node():
    rng = np.random.default_rng(0)
    rows = np.round(rng.random((300, 6)), 1)
    rows[:, 2] = 0.5
    tree = np.repeat(np.arange(3), 100)[rng.permutation(300)]
    got = forest.grow_forest(rows, tree, np.ones(6, bool), 4, ("s", 22, 7), 7)
    for t in range(3):
        want = plain_tree(rows[tree == t], t, 4, ("s", 22, 7))
        own = got["tree"] == t
        found = {int(k): (int(n), int(f) if f >= 0 else None, c) for k, n, f, c in zip(
            got["node"][own], got["size"][own], got["feature"][own], got["cut"][own])}
        assert found.keys() == want.keys() and 2 not in {f for _, f, _ in found.values()}
        assert all(found[k][:2] == want[k][:2] and (found[k][1] is None or found[k][2] == want[k][2]) for k in want)
        assert len({f for _, f, _ in found.values()} - {None}) <= 4
        one = {k: v[own] for k, v in got.items()}
        assert forest.path_lengths(one, rows)[:, 0] == pytest.approx([walk(want, r) for r in rows])
    assert forest.average_path(np.array([1, 2, 100])) == pytest.approx([0, 1, 2 * (math.log(99) + 0.5772156649) - 2 * 99 / 100])
    constant = forest.grow_forest(np.ones((5, 3)), np.zeros(5, int), np.ones(3, bool), 3, ("s", 1, 1), 3)
    assert constant["size"].tolist() == [5] and constant["feature"].tolist() == [-1]


def trees_of(nodes):
    out = {}
    for r in nodes.collect():
        by = None if r.feature is None else MODEL_FEATURES.index(r.feature)
        out.setdefault((r.port, r.model, r.tree), {})[r.node] = (r.size, by, r.cut)
    return out


def test_forest_scores(spark, monkeypatch):
    monkeypatch.setattr(forest, "SCORE_BLOCK", 16)
    train = windows(spark, seed=14)
    odd = [(day(9), 0, 22, {"num_conns": 400, "mean_duration": 900.0, "external_ips": 300}, True)]
    test = windows(spark, n_days=1, seed=15).unionByName(feature_frame(spark, odd))
    scaler = scaling.scaler_fit(train, P)
    nodes = forest.iforest_fit(train, scaler, P, max_features=16, trees=20, sample=50)
    stored = trees_of(nodes)
    assert len(stored) == 40 and {k[1] for k in stored} == {16}
    again = forest.iforest_fit(train.repartition(3), scaler, P, max_features=16, trees=20, sample=50)
    assert trees_of(again) == stored
    scores = {(r.day, r.timewindow, r.port): r.score for r in forest.iforest_score(test, scaler, nodes).collect()}
    assert len(scores) == 61 and all(-1 <= s < 0 for s in scores.values())
    assert min((s, k) for k, s in scores.items() if k[2] == 22)[1] == (day(9), 0, 22)
    x = matrix(train, MODEL_FEATURES, 22)
    row = scaled(np.array([[float(odd[0][3].get(c, 0)) for c in MODEL_FEATURES]]), *bounds(x))[0]
    depth = np.mean([walk(t, row) for k, t in stored.items() if k[0] == 22])
    assert scores[(day(9), 0, 22)] == pytest.approx(-2 ** (-depth / float(forest.average_path(np.array([50]))[0])))


def test_forest_of_a_port_with_few_windows(spark):
    rows = [(day(1 + i), i, 22, {"num_conns": i, "external_ips": 5 - i}, False) for i in range(4)]
    train = feature_frame(spark, rows)
    scaler = scaling.scaler_fit(train, P)
    nodes = forest.iforest_fit(train, scaler, P, max_features=35, trees=8)
    grown = trees_of(nodes)
    assert {t[1][0] for t in grown.values()} == {4}
    assert max(map(len, grown.values())) <= 7
    scores = [r.score for r in forest.iforest_score(train, scaler, nodes).collect()]
    assert len(scores) == 4 and all(-1 <= s < 0 for s in scores)
    lone = forest.iforest_fit(train.limit(1), scaler, P, max_features=35, trees=3)
    assert [r.score for r in forest.iforest_score(train.limit(1), scaler, lone).collect()] == [-0.5]


def test_forest_search_and_single_feature_forests(spark):
    train = windows(spark, seed=16)
    scaler = scaling.scaler_fit(train, P)
    best = forest.iforest_search(train, scaler, P, candidates=[10, 35], trees=5, sample=30).collect()
    assert {r.port for r in best} == {22, 80} and all(r.max_features in (10, 35) for r in best)
    every = {(r.port, r.max_features): r.score for r in forest.search_scores(
        train, scaler, P, candidates=[10, 35], trees=5, sample=30).collect()}
    assert all(r.score == max(every[r.port, 10], every[r.port, 35]) for r in best)
    parts = forest.iforest_ensemble(train.limit(10), train, scaler, P, CONTINUOUS, trees=5, sample=30)
    assert {r.feature for r in parts.collect()} == set(CONTINUOUS) and parts.count() == 30
    single = forest.iforest_fit_single(train, scaler, P, CONTINUOUS, trees=5, sample=30)
    assert all(r.feature in (None, CONTINUOUS[r.model]) for r in single.collect())
    assert forest.feature_counts(35)[:4] == [10, 15, 16, 17] and forest.feature_counts(20) == [20]


def test_isolation_ensemble_through_thresholds(spark):
    train = windows(spark, seed=17)
    odd = [(day(9), t, 22, {"num_conns": 300 + t, "mean_duration": 700.0, "external_ips": 200}, True) for t in range(5)]
    test = windows(spark, n_days=1, per_day=20, seed=18).withColumn("day", F.lit(day(9))).withColumn(
        "timewindow", F.col("timewindow") + 100).unionByName(feature_frame(spark, odd))
    models = isolation.train(train, P)
    counts = {r.port: r for r in isolation.detect(test, train, models, 5.0, [22, 80]).collect()}
    assert (counts[22].tp, counts[22].fn) == (5, 0) and counts[22].fp + counts[22].tn == 20 and counts[80].tp == 0
    weights = spark.createDataFrame([(p, "num_conns", 1.0) for p in (22, 80)], "port int, feature string, weight double")
    only = {(r.timewindow, r.port): r.score for r in isolation.scores(test, models, weights).collect()}
    parts = forest.iforest_feature_scores(test, models.scaler, models.nodes).filter("feature = 'num_conns'").collect()
    assert only == pytest.approx({(r.timewindow, r.port): r.density for r in parts})


def test_importance_finds_the_telling_feature(spark):
    rows = [(day(2 + t % 3), t, 22, {"num_conns": t % 7, "S0_count": 9 if t % 4 == 0 else 0}, t % 4 == 0) for t in range(200)]
    rows += [(day(2), t, 80, {"num_conns": t}, False) for t in range(20)]
    table = importance.rf_importance(feature_frame(spark, rows), [22, 80], trees=10, max_depth=5)
    got = {(r.port, r.feature): r.weight for r in table.collect()}
    assert len(got) == 35 and max(got, key=got.get) == (22, "S0_count")


def test_windows_and_draws_are_not_sent_to_the_driver(spark):
    """Small sides of a join may be broadcast; windows are not one, however few they seem."""
    windows = spark.createDataFrame([(p, day(d), t, [float(t)]) for p in (22, 80) for d in (2, 3) for t in range(40)],
                                    "port int, day date, timewindow int, v array<double>")
    numbered = window_ordinals(windows, ["port"], ["timewindow"], "day", "position")
    models = spark.createDataFrame([(22, 0, 1, 80), (80, 0, 1, 80)], "port int, model int, first int, n long")
    drawn = forest.bootstrap(numbered.select("port", "position", "v"), models, P, trees=3, sample=20)
    assert drawn.count() == 2 * 3 * 20
    ranked = ordinals(windows, ["timewindow", "day", "port"], {"place": ["port"]})
    for table in (drawn, numbered, ranked):
        table.collect()
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()

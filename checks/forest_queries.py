"""Isolation forests (M7, M8) and their ensemble on one-minute windows, with SQL that grows and walks the same trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as x
from checks import sql as q
from checks import stages as st
from checks.model_queries import _COUNTS, _PERCENTILES, _STEPS, _TEST_Z, PERCENTILE
from checks.registry import query, rounded
from harborwatch.operators import evaluation, forest, ranking, scaling
from harborwatch.plans import detection, isolation
from harborwatch.schema import MODEL_FEATURES

_LEVELS = forest.depth_limit(forest.SAMPLE)
_CHOICES = forest.feature_counts(len(MODEL_FEATURES))


def _number(kind: str, i: str) -> str:
    text = f"concat_ws('|', '{x.PARAMS_60.seed}', '{kind}', port, model, tree, {i})"
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _scatter(base: str) -> str:
    return (f"list_transform([({base} % {forest.PRIME} + (f + 1) * {forest.STEP}) % {forest.PRIME} * {forest.FACTOR} % {forest.PRIME}], "
            f"lambda s: (s * s + f + 1) % {forest.PRIME})[1]")


_COLUMNS = ", ".join(f"({i}, '{c}')" for i, c in enumerate(MODEL_FEATURES))
_PATH = f"CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE 2 * (ln(n - 1) + {forest.EULER_GAMMA}) - 2e0 * (n - 1) / n END"
#: Training windows in order, and their scaled values by window and column number.
_WINDOWS = [
    *q.train(60), ("columns", f"SELECT f::BIGINT AS f, feature FROM (VALUES {_COLUMNS}) c(f, feature)"),
    ("numbered", """SELECT day, timewindow, port, row_number() OVER (PARTITION BY port ORDER BY day, timewindow) AS position,
                           count(*) OVER (PARTITION BY port) AS of FROM train"""),
    ("train_values", """SELECT n.port, n.position, c.f, z.z FROM train_z z JOIN columns c ON c.feature = z.feature
                        JOIN numbered n ON n.day = z.day AND n.timewindow = z.timewindow AND n.port = z.port""")]


def _forest(name: str, usable: str = "place <= width") -> list[tuple[str, str]]:
    """Grows the trees of ``{name}_models`` (port, model, first, n, width) into ``{name}`` (port, model, tree, node, size, f, cut)."""
    ctes = [
        (f"{name}_rows_0", f"""
          SELECT port, model, tree, draw, 1 AS node, first + {_number('draw', 'draw')} % n AS position, least(n, {forest.SAMPLE}) AS drawn
          FROM {name}_models, range({forest.TREES}) t(tree), range({forest.SAMPLE}) d(draw) WHERE draw < n"""),
        (f"{name}_usable", f"""
          SELECT port, model, tree, f FROM (SELECT *, row_number() OVER (PARTITION BY port, model, tree ORDER BY {_scatter(_number('columns', '0'))}, f)
                                                   AS place FROM {name}_models, range({forest.TREES}) t(tree), columns) u WHERE {usable}""")]
    for k in range(_LEVELS + 1):
        rows = f"{name}_rows_{k}"
        ctes += [
            (f"{name}_ranges_{k}", f"""
              SELECT r.port, r.model, r.tree, r.node, v.f, min(v.z) AS lo, max(v.z) AS hi FROM {rows} r
              JOIN {name}_usable u ON u.port = r.port AND u.model = r.model AND u.tree = r.tree
              JOIN train_values v ON v.port = r.port AND v.position = r.position AND v.f = u.f
              WHERE {k} < ceil(log2(greatest(r.drawn, 2))) GROUP BY r.port, r.model, r.tree, r.node, v.f"""),
            (f"{name}_split_{k}", f"""
              SELECT port, model, tree, node, f, CASE WHEN cut >= hi THEN lo ELSE cut END AS cut FROM (
                SELECT *, lo + (hi - lo) * ((base // {forest.PRIME}) / {float(forest.SHARES)}e0) AS cut,
                       row_number() OVER (PARTITION BY port, model, tree, node ORDER BY {_scatter('base')}, f) AS place
                FROM (SELECT *, {_number('node', 'node')} AS base FROM {name}_ranges_{k} WHERE hi > lo + {forest.CONSTANT}) b) c
              WHERE place = 1"""),
            (f"{name}_nodes_{k}", f"""
              SELECT r.port, r.model, r.tree, r.node, count(*) AS size, any_value(s.f) AS f, any_value(s.cut) AS cut FROM {rows} r
              LEFT JOIN {name}_split_{k} s ON s.port = r.port AND s.model = r.model AND s.tree = r.tree AND s.node = r.node
              GROUP BY r.port, r.model, r.tree, r.node"""),
            (f"{name}_rows_{k + 1}", f"""
              SELECT r.port, r.model, r.tree, r.draw, 2 * r.node + (v.z > s.cut)::INT AS node, r.position, r.drawn FROM {rows} r
              JOIN {name}_split_{k} s ON s.port = r.port AND s.model = r.model AND s.tree = r.tree AND s.node = r.node
              JOIN train_values v ON v.port = r.port AND v.position = r.position AND v.f = s.f""")]
    return [*ctes, (name, " UNION ALL ".join(f"SELECT * FROM {name}_nodes_{k}" for k in range(_LEVELS + 1)))]


def _scores(name: str, trees: str, windows: str, values: str, where: str = "true") -> list[tuple[str, str]]:
    """``{name}`` (model, w, port, score): walks of ``windows`` (w, port, ...) with ``values`` (w, f, z) through ``trees``."""
    ctes = [(f"{name}_at_0", f"""SELECT n.port, n.model, n.tree, i.w, 1 AS node, 0 AS depth, NULL::BIGINT AS n FROM {windows} i
                                 JOIN {trees} n ON n.port = i.port AND n.node = 1 WHERE {where}""")]
    for k in range(_LEVELS + 1):
        ctes.append((f"{name}_at_{k + 1}", f"""
          SELECT a.port, a.model, a.tree, a.w, CASE WHEN n.f IS NULL THEN a.node ELSE 2 * a.node + (v.z > n.cut)::INT END AS node,
                 a.depth + (n.f IS NOT NULL)::INT AS depth, n.size AS n
          FROM {name}_at_{k} a JOIN {trees} n ON n.port = a.port AND n.model = a.model AND n.tree = a.tree AND n.node = a.node
          LEFT JOIN {values} v ON v.w = a.w AND v.f = n.f"""))
    root = f"SELECT port, model, {_PATH} AS usual FROM (SELECT port, model, max(size) AS n FROM {trees} GROUP BY port, model) r"
    return [*ctes, (name, f"""
      SELECT p.port, p.model, p.w, -pow(2e0, -coalesce(avg(p.path) / nullif(max(r.usual), 0), 1)) AS score
      FROM (SELECT *, depth + {_PATH} AS path FROM {name}_at_{_LEVELS + 1}) p JOIN ({root}) r ON r.port = p.port AND r.model = p.model
      GROUP BY p.port, p.model, p.w""")]


_TRAIN_WINDOWS = [("train_w", "SELECT *, port::BIGINT * 10000000 + position AS w FROM numbered"),
                  ("train_wv", "SELECT port::BIGINT * 10000000 + position AS w, f, z FROM train_values")]
_DAY = [("day30", f"SELECT *, row_number() OVER () AS w FROM features WHERE day = DATE '2024-01-30' AND port IN {q.MODEL_PORTS}"),
        ("day30_long", q.long("day30", "w, port")),
        ("day30_wv", """SELECT t.w, c.f, (t.x - s.lo) / CASE WHEN s.hi = s.lo THEN 1e0 ELSE s.hi - s.lo END AS z
                        FROM day30_long t JOIN scaler s ON t.port = s.port AND t.feature = s.feature JOIN columns c ON c.feature = t.feature""")]
_TEST = [*_TEST_Z, ("test_w", "SELECT variant, day, timewindow, port, label, port::BIGINT * 10000000 + timewindow AS w FROM scored"),
         ("plain_long", q.long("scored", "timewindow, port")),
         ("test_plain", """SELECT t.port::BIGINT * 10000000 + t.timewindow AS w, c.f,
                                  (t.x - s.lo) / CASE WHEN s.hi = s.lo THEN 1e0 ELSE s.hi - s.lo END AS z FROM plain_long t
                           JOIN scaler s ON t.port = s.port AND t.feature = s.feature JOIN columns c ON c.feature = t.feature"""),
         ("test_wv", "SELECT z.port::BIGINT * 10000000 + z.timewindow AS w, c.f, z.z FROM test_z z JOIN columns c ON c.feature = z.feature")]
_SEARCH = [
    *_WINDOWS, *_TRAIN_WINDOWS,
    ("folds", """SELECT port, f AS fold, CASE WHEN f = 0 THEN 1 ELSE half + 1 END AS first, CASE WHEN f = 0 THEN half ELSE of - half END AS n
                 FROM (SELECT DISTINCT port, of, ceil(of / 2e0)::BIGINT AS half FROM numbered) h, range(2) r(f)"""),
    ("tried_models", f"""SELECT port, 2 * i + fold AS model, first, n, width FROM folds,
                         (VALUES {', '.join(f'({i}, {w})' for i, w in enumerate(_CHOICES))}) c(i, width) WHERE n > 0"""),
    *_forest("tried"),
    *_scores("held_out_scores", "tried", "(SELECT *, (position > ceil(of / 2e0))::INT AS fold FROM train_w)", "train_wv", "n.model % 2 <> i.fold"),
    ("means", f"""SELECT port, {_CHOICES}[(model // 2 + 1)::INT] AS max_features, avg(s) AS score
                  FROM (SELECT port, model, avg(score) AS s FROM held_out_scores GROUP BY port, model) m GROUP BY port, model // 2"""),
    ("searched", """SELECT port, max_features, score FROM (
                      SELECT *, row_number() OVER (PARTITION BY port ORDER BY score DESC, max_features) AS place FROM means) p WHERE place = 1""")]
_FIT = [*_SEARCH, ("fitted_models", """SELECT s.port, s.max_features AS model, 1 AS first, n.of AS n, s.max_features AS width
                                       FROM searched s JOIN (SELECT DISTINCT port, of FROM numbered) n ON n.port = s.port"""), *_forest("fitted")]
_SINGLE = [*_WINDOWS, ("single_models", "SELECT port, f AS model, 1 AS first, of AS n, 1 AS width FROM (SELECT DISTINCT port, of FROM numbered) n, columns"),
           *_forest("single", "f = model")]


def _with(ctes: list[tuple[str, str]], select: str) -> str:
    return q.with_(ctes, select, materialized=True)


def _train(spark, sf_dir):
    return st.train_60(spark, sf_dir)


def _scaler(spark, sf_dir):
    return st.stage(spark, sf_dir, "forest-scaler", lambda: scaling.scaler_fit(_train(spark, sf_dir), x.PARAMS_60))


def _nodes(spark, sf_dir):
    return st.stage(spark, sf_dir, "forest-nodes", lambda: forest.iforest_fit(
        _train(spark, sf_dir), _scaler(spark, sf_dir), x.PARAMS_60))


def _forests(spark, sf_dir) -> isolation.Forests:
    scaler = _scaler(spark, sf_dir)
    nodes = st.stage(spark, sf_dir, "forest-single", lambda: forest.iforest_fit_single(_train(spark, sf_dir), scaler, x.PARAMS_60))
    return isolation.Forests(scaler, nodes, x.PARAMS_60.scaler_bounded)


@query("iforest_search", _with(_SEARCH, "SELECT port, max_features, round(score, 6) AS score FROM searched"))
def iforest_search(spark, sf_dir):
    return rounded(forest.iforest_search(_train(spark, sf_dir), _scaler(spark, sf_dir), x.PARAMS_60))


@query("iforest_fit", _with(_FIT, """
    SELECT t.port, t.model, t.tree, t.node, t.size, c.feature, round(t.cut, 6) AS cut FROM fitted t LEFT JOIN columns c ON c.f = t.f"""))
def iforest_fit(spark, sf_dir):
    return rounded(_nodes(spark, sf_dir))


@query("iforest_score", _with([*_FIT, *_DAY, *_scores("day_scores", "fitted", "day30", "day30_wv")], """
    SELECT d.day, d.timewindow, d.port, round(s.score, 6) AS score FROM day_scores s JOIN day30 d ON d.w = s.w"""))
def iforest_score(spark, sf_dir):
    return rounded(forest.iforest_score(st.last_day(spark, sf_dir, x.PARAMS_60), _scaler(spark, sf_dir), _nodes(spark, sf_dir)))


_LABELLED = [*_FIT, *_TEST, *_scores("walked", "fitted", "test_w", "test_plain"), ("scores", """
    SELECT w.variant, w.day, w.timewindow, w.port, w.label, round(s.score, 9) AS score FROM walked s JOIN test_w w ON w.w = s.w""")]


@query("iforest_evaluation", _with([*_LABELLED, *_STEPS], """
    SELECT 'wannacry' AS variant, DATE '2024-01-30' AS day, port, round(sum(sfp / neg * (tp - stp + tp) / 2 / pos), 6) AS roc_auc,
           round(sum(stp / pos * (tp / (tp + fp) + CASE WHEN step = 1 THEN 1 ELSE (tp - stp) / nullif(tp - stp + fp - sfp, 0) END) / 2), 6) AS pr_auc
    FROM steps GROUP BY port"""))
def iforest_evaluation(spark, sf_dir):
    """Areas under the curves of the searched isolation forests on the labelled test day."""
    scored = forest.iforest_score(st.scored_ports(spark, sf_dir), _scaler(spark, sf_dir), _nodes(spark, sf_dir))
    return rounded(evaluation.auc(scored.withColumn("score", F.round("score", 9))))


_ENSEMBLE = [*_SINGLE, *_TEST, *_scores("walked", "single", "test_w", "test_wv"), ("scores", """
    SELECT w.variant, w.day, w.timewindow, w.port, w.label, round(s.score, 9) AS score
    FROM (SELECT w, avg(score) AS score FROM walked GROUP BY w) s JOIN test_w w ON w.w = s.w""")]
_ENSEMBLE_TRAIN = [*_TRAIN_WINDOWS, *_scores("walked_train", "single", "train_w", "train_wv"), ("training_scores", """
    SELECT w.day, w.timewindow, w.port, round(s.score, 9) AS score
    FROM (SELECT w, avg(score) AS score FROM walked_train GROUP BY w) s JOIN train_w w ON w.w = s.w""")]


def _ensemble_scores(spark, sf_dir):
    return st.stage(spark, sf_dir, "forest-scores", lambda: isolation.scores(
        st.scored_ports(spark, sf_dir), _forests(spark, sf_dir)).withColumn("score", F.round("score", 9)))


@query("iforest_ensemble", _with(_ENSEMBLE, "SELECT variant, day, timewindow, port, label, round(score, 6) AS score FROM scores"))
def iforest_ensemble(spark, sf_dir):
    return rounded(_ensemble_scores(spark, sf_dir))


@query("iforest_topk", _with([*_ENSEMBLE, ("ranked", """
    SELECT *, row_number() OVER (PARTITION BY port ORDER BY score, timewindow) AS rank FROM scores""")], """
    SELECT port, timewindow, label, rank, round(score, 6) AS score FROM ranked WHERE rank <= 100"""))
def iforest_topk(spark, sf_dir):
    """The hundred most anomalous windows per port by the isolation ensemble."""
    ranked = ranking.rank_scores(_ensemble_scores(spark, sf_dir), k=100)
    return rounded(ranked.select("port", "timewindow", "label", F.col("rank").cast("long").alias("rank"), "score"))


def _ensemble_percentiles(spark, sf_dir):
    return st.stage(spark, sf_dir, "forest-percentiles", lambda: ranking.percentile_table(
        isolation.scores(_train(spark, sf_dir), _forests(spark, sf_dir)).withColumn("score", F.round("score", 9))))


@query("iforest_percentiles", _with([*_SINGLE, *_ENSEMBLE_TRAIN, *_PERCENTILES], "SELECT port, percentile, round(score, 6) AS score FROM percentiles"))
def iforest_percentiles(spark, sf_dir):
    return rounded(_ensemble_percentiles(spark, sf_dir))


@query("iforest_detect", _with([*_ENSEMBLE, *_ENSEMBLE_TRAIN, *_COUNTS], "SELECT variant, day, port, tp, tn, fp, fn FROM counts"))
def iforest_detect(spark, sf_dir):
    """Isolation ensemble through training percentiles and thresholds to confusion counts."""
    limits = _ensemble_percentiles(spark, sf_dir).withColumn("score", F.round("score", 9))
    return detection.detection_counts(st.test_60(spark, sf_dir), _ensemble_scores(spark, sf_dir), limits, PERCENTILE,
                                      list(x.PARAMS_60.model_ports))


@query("iforest_weighted", _with([*_SINGLE, *_TEST, *q.importance(), *_scores("walked", "single", "test_w", "test_wv")], """
    SELECT w.variant, w.day, w.timewindow, w.port, w.label, round(sum(i.weight * s.score) / sum(i.weight), 6) AS score
    FROM walked s JOIN test_w w ON w.w = s.w JOIN columns c ON c.f = s.model JOIN importance i ON i.port = w.port AND i.feature = c.feature
    GROUP BY w.variant, w.day, w.timewindow, w.port, w.label"""))
def iforest_weighted(spark, sf_dir):
    return rounded(isolation.scores(st.scored_ports(spark, sf_dir), _forests(spark, sf_dir), x.importance(spark)))

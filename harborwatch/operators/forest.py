"""Isolation forests per port as node tables: every choice follows from a hash, so any engine can grow and walk the trees.

A tree is grown from min(sample, n) windows drawn with replacement, level by level. A node's number follows from its place
(root 1, children 2k and 2k + 1), and

* draw i takes position ``number("draw", tree, i) mod n`` of the port's windows,
* a tree may use the ``max_features`` columns that come first by ``scatter(number("columns", tree, 0), column)``,
* a node splits by the usable, not constant column that comes first by ``scatter(number("node", tree, k), column)``, at
  ``low + (high - low) * share`` with the share from the same number; rows up to the cut go left,

where ``number(kind, tree, i)`` is 60 bits of md5("seed|kind|port|model|tree|i"). Nodes of one row, of equal rows or at depth
ceil(log2(sample)) are leaves. A forest is the table (port, model, tree, node, size, feature, cut).

Draws fetch their windows by an equi-join, and the trees of one (port, model) are grown together, a bounded group: trees
times sample rows. Windows are scored in blocks that meet their port's nodes, a bounded table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborwatch.operators.kde import with_folds
from harborwatch.operators.ordering import window_ordinals
from harborwatch.operators.vectors import blocked, fresh, scaled_vectors
from harborwatch.schema import MODEL_FEATURES, Params
from harborwatch.session import cut_lineage, spread

TREES = 50
SAMPLE = 100
CONSTANT = 1e-7  # narrower value ranges are not split
EULER_GAMMA = 0.5772156649015329
#: Windows scored together; a block receives one copy of its port's nodes.
SCORE_BLOCK = 16384
#: Arithmetic of ``scatter``, below 2^62 in every step.
PRIME = 2147483647
STEP, FACTOR = 1103515245, 48271
#: The upper part of a 60-bit number over PRIME is below this.
SHARES = 536870913
NODES = "port int, model int, tree int, node int, size long, feature string, cut double"


def feature_counts(n_features: int) -> list[int]:
    """Candidates for the number of features a tree may use."""
    return [10, 15, *range(16, n_features + 1)] if n_features > 20 else [n_features]


def depth_limit(rows: int) -> int:
    return math.ceil(math.log2(max(rows, 2)))


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    long = 2 * (np.log(big - 1) + EULER_GAMMA) - 2 * (big - 1) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def number(seed: str, kind: str, port: int, model: int, tree: int, i: int) -> int:
    return int(hashlib.md5(f"{seed}|{kind}|{port}|{model}|{tree}|{i}".encode()).hexdigest()[:15], 16)


def number_column(seed: str, kind: str, *keys: str) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.lit(kind), *[F.col(k).cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def scatter(base: np.ndarray, columns: int) -> np.ndarray:
    """Per base, a value for each column; columns are taken in their order (equal values by column)."""
    s = (base[:, None] % PRIME + np.arange(1, columns + 1) * STEP) % PRIME * FACTOR % PRIME
    return (s * s + np.arange(1, columns + 1)) % PRIME


def grow_forest(x: np.ndarray, tree: np.ndarray, allowed: np.ndarray, max_features: int, key: tuple[str, int, int],
                limit: int) -> dict[str, np.ndarray]:
    """Nodes of the trees (0, 1, ...) whose drawn rows are ``x``; ``allowed`` columns only. ``key``: seed, port, model."""
    seed, port, model = key
    columns = np.flatnonzero(allowed)
    order = scatter(np.array([number(seed, "columns", port, model, int(t), 0) for t in range(tree.max() + 1)]), x.shape[1])
    order[:, ~allowed] = PRIME
    usable = np.zeros(order.shape, bool)
    np.put_along_axis(usable, np.argsort(order, axis=1, kind="stable")[:, : min(max_features, len(columns))], True, axis=1)
    out: dict[str, list] = {k: [] for k in ("tree", "node", "size", "feature", "cut")}
    node = np.ones(len(x), np.int64)
    live = np.arange(len(x))
    for depth in range(limit + 1):
        if not len(live):
            break
        live = live[np.lexsort((node[live], tree[live]))]
        first = np.flatnonzero(np.diff(tree[live], prepend=-1) | np.diff(node[live], prepend=0))
        size = np.diff(np.append(first, len(live)))
        of, at = tree[live[first]], node[live[first]]
        low, high = (fn.reduceat(x[live], first, axis=0) for fn in (np.minimum, np.maximum))
        splits = usable[of] & (high > low + CONSTANT) & (size > 1)[:, None] & (depth < limit)
        base = np.array([number(seed, "node", port, model, int(t), int(k)) for t, k in zip(of, at)])
        feature = np.where(splits, scatter(base, x.shape[1]), PRIME).argmin(axis=1)
        pick = np.arange(len(of)), feature
        cut = low[pick] + (high[pick] - low[pick]) * (base // PRIME / SHARES)
        cut = np.where(cut >= high[pick], low[pick], cut)
        inner = splits.any(axis=1)
        for k, v in zip(out, (of, at, size, np.where(inner, feature, -1), np.where(inner, cut, np.nan))):
            out[k].append(v)
        group = np.repeat(np.arange(len(of)), size)
        right = x[live, feature[group]] > cut[group]
        node[live] = 2 * node[live] + right
        live = live[inner[group]]
    return {k: np.concatenate(v) for k, v in out.items()}


def path_lengths(nodes: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """(rows, trees): depth of each row's leaf plus the expected depth inside it. ``feature`` is -1 in a leaf."""
    trees, which = np.unique(nodes["tree"], return_inverse=True)
    feature = np.full((len(trees), int(nodes["node"].max()) + 1), -1)
    cut, size = np.zeros(feature.shape), np.zeros(feature.shape)
    feature[which, nodes["node"]], cut[which, nodes["node"]] = nodes["feature"], nodes["cut"]
    size[which, nodes["node"]] = nodes["size"]
    of = np.arange(len(trees))
    at, depth = np.ones((len(x), len(trees)), np.int64), np.zeros((len(x), len(trees)))
    while True:
        by = feature[of, at]
        inner = by >= 0
        if not inner.any():
            return depth + average_path(size[of, at])
        right = x[np.arange(len(x))[:, None], by] > cut[of, at]
        at = np.where(inner, 2 * at + right, at)
        depth += inner


def bootstrap(vectors: DataFrame, models: DataFrame, p: Params, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(port, model, tree, draw, v): rows drawn with replacement, min(sample, n) per tree.

    ``vectors``: (port, position 1..n, v); ``models``: (port, model, first, n) says which positions a model may
    draw. Each draw hashes to a position and fetches it by an equi-join, so no port is gathered; both sides are shuffled,
    as neither the windows nor the draws of all models are a table for the driver.
    """
    draws = models.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    ).select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(sample), F.col("n")).cast("int") - 1)).alias("draw"))
    position = F.col("first") + number_column(p.seed, "draw", "port", "model", "tree", "draw") % F.col("n")
    return draws.select("port", "model", "tree", "draw", position.alias("position")).join(
        vectors.hint("merge"), ["port", "position"])


def _grow(drawn: DataFrame, widths: dict[int, int], p: Params, columns: list[str], single: bool = False) -> DataFrame:
    """All trees of a (port, model) in one group: trees times sample rows, a fixed number. ``single``: model i is of column i."""
    seed, names = p.seed, np.array([*columns, None], object)

    def grow_model(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        port, model = (int(k) for k in key)
        tree = pdf["tree"].to_numpy()
        allowed = np.arange(len(columns)) == model if single else np.ones(len(columns), bool)
        rows = int(np.bincount(tree).max())
        nodes = grow_forest(np.stack(pdf["v"].to_numpy()), tree, allowed, widths[model], (seed, port, model), depth_limit(rows))
        cut = pd.Series(nodes["cut"]).astype(object).where(nodes["feature"] >= 0, None)
        return pd.DataFrame({"port": port, "model": model, **nodes, "feature": names[nodes["feature"]], "cut": cut})[
            [c.split()[0] for c in NODES.split(", ")]]

    return spread(drawn, "port", "model").groupBy("port", "model").applyInPandas(grow_model, NODES)


def _score_blocks(vectors: DataFrame, nodes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, model, score): -2^(-mean path / c(rows of a tree)), on blocks of a port's windows.

    The rows a tree was grown from are the size of its root; trees of a single row score -0.5 everywhere.
    """
    rows = blocked(vectors, "block", SCORE_BLOCK)
    groups = [c for c in ("variant", "port", "block") if c in rows.columns]
    carried = [f for f in vectors.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + ", model int, score double"
    # One row per block of windows is sent to the nodes, which are many more rows.
    forest = nodes.join(F.broadcast(fresh(rows.select(*groups).distinct())), "port")
    place = {c: i for i, c in enumerate(columns)}

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if not left.empty:
            x = np.stack(left["v"].to_numpy())
            at = right["feature"].map(place).fillna(-1).astype(int)
            for model, group in right.assign(feature=at).groupby("model"):
                table = {c: group[c].to_numpy() for c in ("tree", "node", "size", "feature", "cut")}
                usual = float(average_path(table["size"][table["node"] == 1].max()))
                values = np.concatenate([path_lengths(table, x[i: i + 1024]).mean(axis=1) for i in range(0, len(x), 1024)])
                ratio = values / usual if usual > 0 else np.ones(len(x))
                parts.append(left[keys].assign(model=np.int32(model), score=-np.exp2(-ratio)))
        if not parts:
            return left[keys].iloc[:0].assign(model=np.int32([]), score=np.float64([]))
        return pd.concat(parts)

    pairs = spread(rows, *groups).groupBy(*groups).cogroup(spread(fresh(forest), *groups).groupBy(*groups))
    return pairs.applyInPandas(score, schema)


def _numbered(features: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """(port, position, v): a port's windows in the order of day and window."""
    vectors = scaled_vectors(features, scaler, ["day", "timewindow", "port"], columns)
    return window_ordinals(vectors, ["port"], ["timewindow"], "day", "position").select("port", "position", "v")


def search_scores(features: DataFrame, scaler: DataFrame, p: Params, columns: list[str] = MODEL_FEATURES,
                  candidates: list[int] | None = None, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(port, max_features, score): mean over two folds of the mean score of held-out windows."""
    candidates = candidates or feature_counts(len(columns))
    keys = ["day", "timewindow", "port", "fold"]
    folded = scaled_vectors(with_folds(features), scaler, keys, columns)
    numbered = window_ordinals(folded, ["port"], ["timewindow"], "day", "position").select("port", "position", "v")
    sizes = folded.groupBy("port").agg(F.count_if(F.col("fold") == 0).alias("n0"), F.count_if(F.col("fold") == 1).alias("n1"))
    # Model 2*i + f draws from fold f; fold 0 holds the first positions.
    configs = F.explode(F.array(*[F.lit(i) for i in range(2 * len(candidates))])).alias("model")
    in_second = F.col("model") % 2 == 1
    models = sizes.select("*", configs).select(
        "port", "model", F.when(in_second, F.col("n0") + 1).otherwise(F.lit(1)).alias("first"),
        F.when(in_second, F.col("n1")).otherwise(F.col("n0")).alias("n")).filter(F.col("n") > 0)
    widths = {2 * i + f: c for i, c in enumerate(candidates) for f in (0, 1)}
    grown = _grow(bootstrap(numbered, models, p, trees, sample), widths, p, columns)
    scored = _score_blocks(folded, grown, keys, columns).filter(F.col("model") % 2 != F.col("fold"))
    width = F.element_at(F.array(*[F.lit(c) for c in candidates]), (F.floor(F.col("model") / 2) + 1).cast("int"))
    per_fold = scored.groupBy("port", "fold", width.alias("max_features")).agg(F.avg("score").alias("score"))
    return per_fold.groupBy("port", "max_features").agg(F.avg("score").alias("score"))


def iforest_search(features: DataFrame, scaler: DataFrame, p: Params, columns: list[str] = MODEL_FEATURES,
                   candidates: list[int] | None = None, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(port, max_features, score): the candidate with the best held-out score, the smaller one at equal scores."""
    best = F.max(F.struct("score", (-F.col("max_features")).alias("neg"))).alias("best")
    return search_scores(features, scaler, p, columns, candidates, trees, sample).groupBy("port").agg(best).select(
        "port", (-F.col("best.neg")).alias("max_features"), F.col("best.score").alias("score"))


def iforest_fit(features: DataFrame, scaler: DataFrame, p: Params, columns: list[str] = MODEL_FEATURES,
                max_features: int | None = None, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Node table on all training windows; a port's model number is the number of features its trees may use.

    Without ``max_features`` the number is searched per port.
    """
    candidates = [max_features] if max_features else feature_counts(len(columns))
    sizes = features.groupBy("port").agg(F.count(F.lit(1)).alias("n"))
    if len(candidates) > 1:
        chosen = cut_lineage(iforest_search(features, scaler, p, columns, candidates, trees, sample))
        models = sizes.join(chosen, "port").select("port", F.col("max_features").cast("int").alias("model"), F.lit(1).alias("first"), "n")
    else:
        models = sizes.select("port", F.lit(candidates[0]).alias("model"), F.lit(1).alias("first"), "n")
    drawn = bootstrap(_numbered(features, scaler, columns), models, p, trees, sample)
    return _grow(drawn, {c: c for c in candidates}, p, columns)


def iforest_score(features: DataFrame, scaler: DataFrame, nodes: DataFrame, columns: list[str] = MODEL_FEATURES,
                  clip: bool = False) -> DataFrame:
    """Anomaly score per window in [-1, 0): lower is more anomalous."""
    keys = [c for c in ("variant", "day", "timewindow", "port", "label") if c in features.columns]
    vectors = scaled_vectors(features, scaler, keys, columns, clip)
    return _score_blocks(vectors, nodes, keys, columns).drop("model")


def iforest_fit_single(train: DataFrame, scaler: DataFrame, p: Params, columns: list[str] = MODEL_FEATURES,
                       trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """One forest per feature in one node table; the model's number is the column's."""
    sizes = train.groupBy("port").agg(F.count(F.lit(1)).alias("n"))
    models = sizes.select("port", F.lit(1).alias("first"), "n",
                          F.explode(F.array(*[F.lit(i) for i in range(len(columns))])).alias("model"))
    drawn = bootstrap(_numbered(train, scaler, columns), models, p, trees, sample)
    return _grow(drawn, {i: 1 for i in range(len(columns))}, p, columns, single=True)


def iforest_feature_scores(features: DataFrame, scaler: DataFrame, nodes: DataFrame, columns: list[str] = MODEL_FEATURES,
                           clip: bool = True) -> DataFrame:
    """(keys, feature, density): scores of the single-feature forests, for the mean or weighted ensemble."""
    keys = [c for c in ("variant", "day", "timewindow", "port", "label") if c in features.columns]
    scored = _score_blocks(scaled_vectors(features, scaler, keys, columns, clip), nodes, keys, columns)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("model") + 1)
    return scored.select(*keys, name.alias("feature"), F.col("score").alias("density"))


def iforest_ensemble(features: DataFrame, train: DataFrame, scaler: DataFrame, p: Params,
                     columns: list[str] = MODEL_FEATURES, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """The two steps above together."""
    return iforest_feature_scores(features, scaler, iforest_fit_single(train, scaler, p, columns, trees, sample), columns)

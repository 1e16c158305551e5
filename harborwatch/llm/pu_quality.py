"""Quality scores from positive and unlabelled texts (non-negative PU risk).

Trusted positives are texts marked good in the training part; unlabelled texts are all texts of that part. With class prior
p and logistic loss l, the risk of a linear score g is

    p * E_pos[l(g)] + max(0, E_unl[l(-g)] - p * E_pos[l(-g)]) + PENALTY / 2 * |w|^2

The second term estimates the loss on bad texts without having any; where it would fall below zero the fit has begun to
learn single texts. Weighted with m from 0 to 1 instead of cut at zero, the risk is convex, because l(g) = l(-g) - g. Newton
steps solve m = 1; if the term is negative there, the largest m of a bisection is taken whose term is not. The prior is the
share of good marks among the marks of the training part, less one standard error: a prior that is too large makes the term
negative. The output is the probability 1 / (1 + exp(-g)).

The executors write the features of every text of the training part once. Each step is one pass over them: tasks sum loss,
gradient and curvature over their texts, the sums are added by parts, and the driver receives one vector of fixed length. Only
the positives, which are labelled, are a bounded sample (``POSITIVES`` ids of least hash); the driver gets ``WIDTH`` numbers
for each. Scoring shuffles nothing and reads whole texts. Features use nothing but the text.

Null text counts as empty and is scored like it. Rows with a null id are unlabelled and not held out. Labels that contradict
each other for an id count as good if any does. Positives are drawn among the marks whose text is there; the rows of a
repeated id share the weight of one. Repeated rows count among the unlabelled as often as they are there. Without a positive
there is no model: the score is 0.5 for every row, and ``accept`` keeps all rows. Repeated rows get equal scores; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborwatch.llm import common

POSITIVES = 8_000
BUCKETS = 256
PENALTY = 0.1
NEWTON_STEPS = 25
HALVINGS = 5
THRESHOLD = 0.7
#: Pieces in which the sums of the tasks are added.
PARTS = 64
#: Feature rows that a task widens to doubles at once.
ROWS = 1024


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_LOWER = _mask(bytes(range(97, 123)))
_UPPER = _mask(bytes(range(65, 91)))
_DIGIT = _mask(b"0123456789")
_STOPS = _mask(b".,;:")
_MARKS = _mask(b"!?")
_SYMBOLS = _mask(b"#*$%&|<>")
_BREAK = _mask(b"\n")
_SPACE = _mask(common.SPACES)
_OTHER = ~(_LOWER | _UPPER | _DIGIT | _STOPS | _MARKS | _SYMBOLS | _SPACE)
_OTHER[128:] = False
_FOREIGN = np.arange(256) >= 128
_CLASSES = (_LOWER, _UPPER, _DIGIT, _STOPS, _MARKS, _SYMBOLS, _BREAK, _SPACE, _OTHER, _FOREIGN)
_LAST_OF_WORD = (_STOPS, _MARKS, _SYMBOLS)
WIDTH = len(_CLASSES) + len(_LAST_OF_WORD) + 8 + BUCKETS


def describe(chunk: common.Chunk) -> np.ndarray:
    """Feature rows of the texts of a chunk."""
    data, offsets = chunk.data, chunk.offsets
    n = len(offsets) - 1
    w = common.words(chunk)
    bounds = np.searchsorted(w.start, offsets)
    n_bytes, n_words = np.diff(offsets), np.diff(bounds)
    per_byte, per_word = 1 / np.maximum(n_bytes, 1), 1 / np.maximum(n_words, 1)
    cols = [common.counts_between(c[data], offsets) * per_byte for c in _CLASSES]
    last = data[w.end - 1] if len(w.end) else data[:0]
    cols += [common.counts_between(c[last], bounds) * per_word for c in _LAST_OF_WORD]
    upper = np.append(0, np.cumsum(_UPPER[data]))
    shouted = (upper[w.end] - upper[w.start]) * 2 > w.end - w.start
    prefix = common.byte_hash(data)
    key = common.mixed(common.span_hash(prefix, w.start, w.end)) ^ common.mixed(w.text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    stuttered = np.zeros(len(key), bool)
    stuttered[1:] = key[1:] == key[:-1]
    n_lines = common.counts_between(_BREAK[data], offsets) + 1
    cols += [
        np.log1p(n_bytes), np.log1p(n_words), common.counts_between(w.end - w.start, bounds) * per_word / 10,
        common.counts_between(shouted, bounds) * per_word, np.log1p(n_lines), np.log1p(n_words / n_lines),
        common.counts_between(again, bounds) * per_word, common.counts_between(stuttered, bounds) * per_word,
    ]
    text = np.repeat(np.arange(n), n_bytes)
    pair = (data[:-1].astype(np.int64) * 131 + data[1:] * 7) % BUCKETS
    own = text[1:] == text[:-1]
    pairs = np.bincount(text[1:][own] * BUCKETS + pair[own], minlength=n * BUCKETS).reshape(n, BUCKETS)
    return np.column_stack([*cols, np.sqrt(pairs * per_byte[:, None])]).astype(np.float32)


def _describe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in common.text_chunks(batch.column(1), common.SMALL_CHUNK_BYTES):
            x = describe(chunk)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, len(x)), pa.array([r.tobytes() for r in x], pa.binary())],
                ["weight", "x"])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


Scale = tuple[np.ndarray, np.ndarray]
#: Of weights: the mean over unlabelled texts of log(1 + exp(g)), its gradient and its second derivatives.
Terms = Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]


def standard(x: np.ndarray, scale: Scale) -> np.ndarray:
    """Features in units of their spread, with a last column of ones."""
    return np.column_stack([np.clip((x - scale[0]) / scale[1], -8, 8), np.ones(len(x))]).astype(np.float64)


def softplus_sums(z: np.ndarray, w: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted sum of log(1 + exp(g)), its gradient and its second derivatives."""
    g = z @ w
    at = 1 / (1 + np.exp(-np.clip(g, -60, 60)))
    return float(weight @ np.logaddexp(0, g)), (weight * at) @ z, (z * (weight * at * (1 - at))[:, None]).T @ z


def _newton(terms: Terms, positive: np.ndarray, weight: np.ndarray, prior: float, m: float, w: np.ndarray):
    """(weights, second term of the risk) at the minimum of the convex risk whose second term is weighted with ``m``."""
    ridge = np.full(len(w), PENALTY)
    ridge[-1] = 1e-9
    centre = weight @ positive
    best, step, term = np.inf, np.zeros_like(w), 0.0
    for _ in range(NEWTON_STEPS):
        at = w - step
        u, u_up, u_curve = terms(at)
        p, p_up, p_curve = softplus_sums(positive, at, weight)
        risk = m * u + prior * (1 - m) * p - prior * (centre @ at) + ridge @ at**2 / 2
        if risk > best + 1e-12:
            step = step / 2
            continue
        w, best, term = at, risk, u - prior * p
        up = m * u_up + prior * (1 - m) * p_up - prior * centre + ridge * w
        step = np.linalg.solve(m * u_curve + prior * (1 - m) * p_curve + np.diag(ridge), up)
        if up @ step < 1e-6:
            break
    return w, term


def fit(terms: Terms, positive: np.ndarray, weight: np.ndarray, prior: float) -> np.ndarray:
    """Weights of the least non-negative risk; the positives' weights add up to one."""
    w, term = _newton(terms, positive, weight, prior, 1.0, np.zeros(positive.shape[1]))
    if term < 0:
        below, above = 0.0, 1.0
        start = np.zeros_like(w)
        w = None
        for _ in range(HALVINGS):
            middle = (below + above) / 2
            at, term = _newton(terms, positive, weight, prior, middle, start)
            if term < 0:
                above = middle
            else:
                below, w, start = middle, at, at
        if w is None:
            w, _ = _newton(terms, positive, weight, prior, 0.0, start)
    # Sums of floating-point numbers differ in their last bits with the split of the table.
    return np.round(w, 9)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, WIDTH)


def _task_sums(batches: Iterator[pa.RecordBatch], per_rows: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The sum of ``per_rows`` over a task's texts, in ``PARTS`` pieces."""
    total = None
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            own = per_rows(_matrix(batch.column(0).slice(first, ROWS)))
            total = own if total is None else total + own
    if total is not None:
        task = TaskContext.get().partitionId()
        pieces = np.array_split(total, PARTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(PARTS), pa.int32()), pa.array([task] * PARTS, pa.int64()),
             pa.array([x.tobytes() for x in pieces], pa.binary())], ["part", "task", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, sums in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            own = np.frombuffer(sums)
            total[part] = total[part] + own if part in total else own
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "sums"])


def _sum(features: DataFrame, per_rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all texts of a vector of fixed length; each part of it is added in the order of the tasks."""
    pieces = features.select("x").mapInArrow(
        lambda batches: _task_sums(batches, per_rows), "part int, task long, sums binary")
    added = pieces.repartition("part").sortWithinPartitions("part", "task").mapInArrow(_add, "part int, sums binary")
    by_part = {r["part"]: r["sums"] for r in added.collect()}  # PARTS rows
    return np.concatenate([np.frombuffer(by_part[i]) for i in range(PARTS)])


def _unlabelled_terms(features: DataFrame, scale: Scale, n: float) -> Terms:
    upper = np.triu_indices(WIDTH + 1)

    def terms(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def per_rows(x: np.ndarray) -> np.ndarray:
            loss, up, curve = softplus_sums(standard(x, scale), w, np.ones(len(x)))
            return np.concatenate([[loss], up, curve[upper]])

        sums = _sum(features, per_rows) / n
        curve = np.zeros((WIDTH + 1, WIDTH + 1))
        curve[upper] = sums[WIDTH + 2:]
        return float(sums[0]), sums[1: WIDTH + 2], curve + np.triu(curve, 1).T

    return terms


def _moments(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)])


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES):
    """The fitted model, or None without a positive."""
    common.ship(docs.sparkSession)
    common.bound_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(
        ~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    by_id = marks.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"))
    good, every = by_id.agg(F.count_if("good"), F.count("doc_id")).first()
    if not good:
        return None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(~held_out())
    rows_of = texts.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((1 / F.count("*")).alias("weight"))
    chosen = by_id.filter("good").join(rows_of, "doc_id").select("doc_id", "weight").orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(positives)
    # At most ``positives`` ids: a bounded broadcast.
    tagged = texts.join(F.broadcast(chosen), "doc_id", "left").select("weight", "text")
    features = common.materialise(tagged.mapInArrow(_describe_batches, "weight double, x binary"), "quality-features")
    known = features.filter(F.col("weight").isNotNull()).toArrow()
    if not known.num_rows:
        return None
    sums = _sum(features, _moments)
    n, mean = sums[0], sums[1: WIDTH + 1] / sums[0]
    scale = mean, np.sqrt(np.maximum(sums[WIDTH + 1:] / n - mean**2, 0)) + 1e-3
    weight = known["weight"].to_numpy()
    share = good / every
    prior = min(max(share - (share * (1 - share) / every) ** 0.5, 0.05), 0.95)
    w = fit(_unlabelled_terms(features, scale, n), standard(_matrix(known["x"]), scale), weight / weight.sum(), prior)
    return scale, w


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = batch.columns[:-1]
        for chunk in common.text_chunks(batch.column(len(rest)), common.SMALL_CHUNK_BYTES):
            x = describe(chunk)
            if model is None:
                score = np.full(len(x), 0.5)
            else:
                score = 1 / (1 + np.exp(-np.clip(standard(x, model[0]) @ model[1], -60, 60)))
            yield pa.RecordBatch.from_arrays(
                [c.slice(chunk.first, len(x)) for c in rest] + [pa.array(score)], [*batch.schema.names[:-1], "_score"])


def _scored(docs: DataFrame, model, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, _held_out and _score of every row."""
    common.ship(docs.sparkSession)
    common.bound_batches(docs.sparkSession)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, held_out().alias("_held_out"), F.col("text").alias("_text")).mapInArrow(
        lambda batches: _score(batches, model), f"{own}, _held_out boolean, _score double")


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    return _scored(docs, model, ("doc_id",)).select(
        "doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of at least the threshold, columns as they are; all rows without a model."""
    model = learn(docs, labels)
    if model is None:
        return docs
    scored = _scored(docs, model, tuple(docs.columns))
    return scored.filter(F.col("_score") >= THRESHOLD).select(*docs.columns)

"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Every block of candidates keeps, per dimension, its vectors in order of that component. A query walks all lists at the
same time, from the large end where its own component is positive and from the small end where it is negative. Each
vector met is scored in full. After depth d no vector that was not met can score more than the sum over dimensions of
query component times the component at depth d; the walk stops when that bound is below the k-th best score (at an
equal bound it goes on, because a tie goes to the smaller id).

Queries and candidates are cut into blocks, and a task walks one block of queries through one block of candidates, so
memory is bounded and no pair is a row; each pair of blocks returns k rows per query. The work grows with queries times
candidates, as it must where the bound stops late: with components of even size it stops after most of a block.

Components are floor(256 * x) of x as a double, scores exact integers. Vectors that are null or hold null or
non-finite components take no part, nor do null ids. Vectors of unequal length are compared as if the shorter one ended
in zeros. Rows that repeat an id are candidates and queries of their own; a query's candidates are all rows but its own. Ties
go to the smaller id. An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborwatch.llm import common

K = 5
QUERY_EVERY = 50
SCALE = 256
CANDIDATES = 4096
QUERIES = 512
FIRST_DEPTH = 16


def vectors(table: DataFrame) -> DataFrame:
    """(row, vec_id, v): integer vectors that take part, with a number of the row, which holds once the result is written."""
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v"))


def walk(query: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, lists: np.ndarray, ends: np.ndarray, k: int):
    """(ids, scores) of the k best candidates of one block. ``rows`` are in order of ``ids``; those marked ``own`` are left out.

    ``lists[j]`` has the row numbers in rising order of component j, ``ends[j]`` the components in that order.
    """
    n = len(ids)
    used = np.flatnonzero(query)
    seen = own.copy()
    best_row, best = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
    rising = query[used] < 0
    depth, step = 0, FIRST_DEPTH
    while depth < n:
        upto = min(n, depth + step)
        if len(used):
            met = np.where(rising[:, None], lists[used, depth:upto], lists[used, n - upto: n - depth])
            fresh = np.zeros(n, bool)
            fresh[met.ravel()] = True
        else:
            fresh = np.ones(n, bool)
        new = np.flatnonzero(fresh & ~seen)
        seen[new] = True
        if len(new):
            best_row = np.concatenate([best_row, new])
            best = np.concatenate([best, rows[new] @ query])
            top = np.lexsort((best_row, -best))[:k]
            best_row, best = best_row[top], best[top]
        if not len(used) or seen.all():
            break
        bound = (query[used] * np.where(rising, ends[used, upto - 1], ends[used, n - upto])).sum()
        if len(best) == k and bound < best[-1]:
            break
        depth, step = upto, 2 * step
    return ids[best_row], best


def _block(table: pa.Table, k: int) -> pa.Table:
    is_query = table.column("is_query").to_numpy()
    vec_id, number = table.column("vec_id").to_numpy(), table.column("row").to_numpy()
    lists_of = table.column("v").combine_chunks()
    lengths = np.diff(np.asarray(lists_of.offsets))
    matrix = np.zeros((len(vec_id), max(1, lengths.max(initial=0))), np.int64)
    matrix[np.arange(matrix.shape[1])[None, :] < lengths[:, None]] = np.asarray(lists_of.flatten())
    order = np.flatnonzero(~is_query)
    order = order[np.lexsort((number[order], vec_id[order]))]
    ids, rows, numbers = vec_id[order], matrix[order], number[order]
    biggest = float(np.abs(matrix).max(initial=0))
    if biggest**2 * matrix.shape[1] < 2**53:  # sums of products stay exact in doubles, whose products are fast
        matrix, rows = matrix.astype(np.float64), rows.astype(np.float64)
    lists = np.argsort(rows, axis=0, kind="stable").T.copy()
    ends = np.take_along_axis(rows.T, lists, axis=1)
    out: list[list] = [[], [], [], []]
    for i in np.flatnonzero(is_query):
        found, score = walk(matrix[i], numbers == number[i], ids, rows, lists, ends, k)
        out[0] += [number[i]] * len(found)
        out[1] += [vec_id[i]] * len(found)
        out[2] += found.tolist()
        out[3] += score.astype(np.int64).tolist()
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_row", "query_id", "vec_id", "score"), out)})


def search(table: DataFrame, k: int = K, query_every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for every row whose id is divisible by ``query_every``."""
    common.ship(table.sparkSession)
    every = common.materialise(vectors(table), "vectors")
    is_query = F.col("vec_id") % query_every == 0
    n, q = every.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    n_blocks, q_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-q // QUERIES))
    block = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    met = every.select("row", "vec_id", "v", F.lit(False).alias("is_query"), block(n_blocks).alias("b"),
                       numbers(q_blocks).alias("q")).unionByName(
        every.filter(is_query).select("row", "vec_id", "v", F.lit(True).alias("is_query"), numbers(n_blocks).alias("b"),
                                      block(q_blocks).alias("q")))
    found = met.groupBy("b", "q").applyInArrow(lambda t: _block(t.drop(["b", "q"]), k), "query_row long, query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""

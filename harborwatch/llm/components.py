"""Connected components of a table of links: local forests, and alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.llm.common import materialise, ship

#: Links that a task holds at once; a larger table is several blocks, whose forests the star steps join.
LINK_BLOCK = 1 << 16


def _forest(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """The links of each node to the least node it reaches here, that one excepted."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u):]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["u", "v"])


def _forests(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    joined = lambda: _forest(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
    for batch in batches:
        if held and sum(b.num_rows for b in held) + batch.num_rows > block:
            yield joined()
            held = []
        held.append(batch)
    if held:
        yield joined()


def _contracted(edges: DataFrame) -> tuple[DataFrame, bool]:
    """Forests of blocks of links where they lie, as long as this halves them; whether one block held them all."""
    block = LINK_BLOCK
    n = edges.count()
    while n:
        tasks = -(-n // block)
        edges = materialise(edges.coalesce(tasks).mapInArrow(lambda batches: _forests(batches, block), "u long, v long"), "links")
        left = edges.count()
        if tasks == 1 or 2 * left > n:
            return edges, tasks == 1
        n = left
    return edges, True


def _are_stars(edges: DataFrame) -> bool:
    """Every larger node has one link, and no smaller node is a larger one of another link."""
    ends = edges.select(F.col("u").alias("node"), "v").unionByName(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
    return not ends.groupBy("node").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v").isNull()).alias("above"),
    ).filter("low < high or low is not null and above > 0").count()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (the larger ones, or the smaller ones with itself) move to its least neighbour."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = near.join(least, "u")
    if large:
        return moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    # The link to the least neighbour itself stays; the others' smaller ends move.
    return moved.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v), component being the least node reached.

    ``known`` (node, component) is an earlier result that the links extend. Links may repeat. Blocks of links become forests
    in the tasks that read them, without a shuffle; one block is the result. More blocks meet in star steps, each written, so
    lineage stays short; a node with very many links is one aggregated row and a join that adaptive execution splits. The
    number of steps grows with the logarithm of the longest path.
    """
    ship(links.sparkSession)
    if known is not None:
        links = links.select("u", "v").unionByName(known.select(F.col("node").alias("u"), F.col("component").alias("v")))
    edges, whole = _contracted(materialise(links.filter(F.col("u") != F.col("v")).select("u", "v"), "links"))
    while not whole and not _are_stars(edges):
        edges, whole = _contracted(materialise(_star(materialise(_star(edges, True), "links"), False), "links"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return materialise(found.distinct(), "components")

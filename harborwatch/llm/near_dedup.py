"""MinHash near-duplicates by an inverted join on signature coordinates.

1. A document is the set of its distinct w-word shingles (A-Z lower-cased). Equal sets are one class: a copy costs one
   row. Every class has a signature of K minima under K hash functions.
2. Two signatures with at least M equal coordinates agree in one of any K - M + 1 coordinates. With the coordinates of
   each class ordered by how few classes share the (coordinate, value) pair, posting the first K - M + 1 is therefore
   enough (prefix); pairs that occur once are skipped, and a class whose prefix holds nothing else has no partner at all.
   Values that a common passage puts into thousands of documents fall behind the prefix.
3. Collisions of whole signatures are counted inside posting lists: members against leaders drawn from the list, then, in
   lists that still hold several groups, members outside the largest group against all others. Only members of different
   groups are counted, and a task returns the collisions that join groups, not all of them. The result is the components
   of the graph of all pairs with at least M collisions.
4. Links lie inside these components. Their texts are brought together in blocks of bounded size (a component of any size
   is split) and compared by full shingle sets, again only where two members are not joined yet: in large components first
   with drawn leaders, then members outside the largest group with all others.

So no list or component is expanded into pairs, and no link between different groups is left out. A pair at the required
similarity s has a binomial number of collisions; M is chosen so that fewer than M occur with a probability below ``MISS``
(1e-6). That is the only way to lose a link; what joins documents in the end is exact.

Of each class one text is compared, however many rows repeat it, and texts of one doc_id are spread over the blocks.

Null or empty texts have no shingles and no links; they stay. A text of fewer than w words is one shingle. Rows with
equal doc_id are one node. A null doc_id takes no part and stays. Empty tables give empty results; further columns are
ignored here and kept by ``drop_near_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.llm import common
from harborwatch.llm.components import components
from harborwatch.operators.skew import FREQUENT, frequency_split_join

COORDINATES = 40
#: Chance that a pair at the required similarity has too few collisions.
MISS = 1e-6
#: Leaders that a posting list or a component may have in one round.
LEADERS = 6
#: Members of a posting list that one task holds on either side, and texts of a component.
LIST_BLOCK = 1024
TEXT_BLOCK = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_draw = np.random.default_rng(7)
_FACTOR = _draw.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _draw.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def least_matches(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Largest M such that a pair of similarity ``percent`` has fewer than M collisions with a chance of at most ``miss``."""
    s, below = percent / 100, 0.0
    for m in range(coordinates + 1):
        below += math.comb(coordinates, m) * s**m * (1 - s) ** (coordinates - m)
        if below > miss:
            return max(m, 1)
    return coordinates


def shingles(chunk: common.Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), both sorted: the distinct shingles of each text."""
    chunk = chunk._replace(data=_LOWER[chunk.data])
    w = common.words(chunk)
    prefix = common.byte_hash(chunk.data)
    one = common.mixed(common.span_hash(prefix, w.start, w.end) + (w.end - w.start).astype(np.uint64))
    n = len(one)
    first = np.searchsorted(w.start, chunk.offsets)
    n_words = np.diff(first)
    at = np.arange(max(0, n - size + 1))
    at = at[w.text[at + size - 1] == w.text[at]] if n else at
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    rolling = common.prefix_hash(one)
    start = np.concatenate([at, first[short]])
    end = np.concatenate([at + size, first[short] + n_words[short]])
    of = w.text[start] if n else start
    h = common.mixed(common.span_hash(rolling, start, end) + (end - start).astype(np.uint64))
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return of[new], h[new]


def signatures(of: np.ndarray, h: np.ndarray, n_texts: int) -> tuple[np.ndarray, ...]:
    """Set sizes, two 64-bit fingerprints of each set, and signatures (0 for empty sets)."""
    sizes = np.bincount(of, minlength=n_texts)
    first = np.cumsum(sizes) - sizes
    rows = np.flatnonzero(sizes)
    finger = np.zeros((2, n_texts), np.uint64)
    sign = np.zeros((n_texts, COORDINATES), np.uint32)
    if len(rows):
        at = first[rows]
        finger[0, rows] = np.add.reduceat(common.mixed(h), at)
        finger[1, rows] = np.add.reduceat(common.mixed(h ^ np.uint64(0xD6E8FEB86659FD93)), at)
        for k in range(COORDINATES):
            sign[rows, k] = np.minimum.reduceat((h * _FACTOR[k] + _SHIFT[k]) >> np.uint64(32), at)
    return sizes, finger[0], finger[1], sign


def _features(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in common.text_chunks(batch.column(2), common.SMALL_CHUNK_BYTES):
            rows = len(chunk.offsets) - 1
            n, high, low, sign = signatures(*shingles(chunk, size), rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, rows), batch.column(1).slice(chunk.first, rows), pa.array(n),
                 pa.array(high.view(np.int64)), pa.array(low.view(np.int64)),
                 pa.array([s.tobytes() for s in sign], pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "high", "low", "sign"])


def features(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, high, low, sign) of every row."""
    common.ship(docs.sparkSession)
    common.bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        lambda batches: _features(batches, size),
        "doc_id long, text_hash long, n_shingles long, high long, low long, sign binary")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coordinate = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        node = np.asarray(batch.column(0))
        sign = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES)
        yield pa.RecordBatch.from_arrays(
            [pa.array((coordinate + sign).ravel()), pa.array(np.repeat(node, COORDINATES))], ["token", "node"])


def prefix_postings(classes: DataFrame, matches: int) -> DataFrame:
    """(token, node, sign): the shared tokens among the first K - M + 1 of each class, rarest first."""
    every = classes.select("node", "sign").mapInArrow(_postings, "token long, node long")
    shared = every.groupBy("token").agg(F.count("node").alias("often")).filter("often > 1")
    of_node = every.join(shared, "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("often", "token"))).alias("tokens"))
    # Tokens that no other class has come first in the order.
    room = F.size("tokens") - F.lit(matches - 1)
    first = of_node.filter(room > 0).select("node", F.explode(F.slice("tokens", 1, room)).alias("t"))
    return first.select("node", F.col("t.token").alias("token")).join(classes.select("node", "sign"), "node")


def _collide(batches: Iterator[pa.RecordBatch], matches: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, COORDINATES) for i in (2, 3))
        enough = pa.array((a == b).sum(axis=1) >= matches)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(enough), batch.column(1).filter(enough)], ["u", "v"])


def leader_pairs(lists: DataFrame, matches: int, leaders: int, turn: int) -> DataFrame:
    """(u, v): members of a posting list against one of its leaders, with enough collisions. ``lists`` has labels."""
    draw = F.xxhash64("node", F.pmod(F.xxhash64("token"), F.lit(leaders)), F.lit(turn))
    leader = lists.groupBy("token").agg(
        F.min(F.struct(draw.alias("draw"), "node", "label", "sign")).alias("leader"),
        F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").drop("low", "high")
    met = lists.join(leader, "token").filter(F.col("label") != F.col("leader.label"))
    return met.select(F.least("node", "leader.node").alias("u"), F.greatest("node", "leader.node").alias("v"),
                      "sign", F.col("leader.sign").alias("other")).mapInArrow(
        lambda batches: _collide(batches, matches), "u long, v long")


def _joining(one: np.ndarray, two: np.ndarray, group: np.ndarray, met: Callable[[int, np.ndarray], np.ndarray]) -> list:
    """Edges (i, j), i of ``one`` and j of ``two``, that join different groups; as few as it takes. ``met`` tells which
    of the given rows belong with row i. ``group`` is changed."""
    edges = []
    for i in one:
        others = two[group[two] != group[i]]
        if len(others):
            others = others[met(i, others)]
            joined, first = np.unique(group[others], return_index=True)
            if len(joined):
                edges += [(i, others[k]) for k in first]
                group[np.isin(group, joined)] = group[i]
    return edges


def _edge_table(node: np.ndarray, edges: list) -> pa.Table:
    i, j = np.array(edges, np.int64).reshape(-1, 2).T
    return pa.table({"u": node[i], "v": node[j]})


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    node, label, side = (table.column(c).to_numpy() for c in ("node", "label", "side"))
    return node, np.unique(label, return_inverse=True)[1], np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _collisions(table: pa.Table, matches: int) -> pa.Table:
    """Joining edges by collisions of signatures, in one block of a list."""
    node, group, one, two = _sides(table)
    sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint32).reshape(-1, COORDINATES)
    return _edge_table(node, _joining(one, two, group, lambda i, rows: (sign[rows] == sign[i]).sum(axis=1) >= matches))


def _links(table: pa.Table, size: int, percent: int) -> pa.Table:
    """Joining edges by similarity of full shingle sets, in one block of a component."""
    node, group, one, two = _sides(table)
    sets = []
    for chunk in common.text_chunks(table.column("text"), common.SMALL_CHUNK_BYTES):
        of, h = shingles(chunk, size)
        cut = np.searchsorted(of, np.arange(len(chunk.offsets)))
        sets += [h[cut[k]: cut[k + 1]] for k in range(len(chunk.offsets) - 1)]
    n = np.array([len(s) for s in sets])
    first = np.append(0, np.cumsum(n))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(flat) + 1, bool)

    def similar(i: int, rows: np.ndarray) -> np.ndarray:
        own = flat[first[i]: first[i + 1]]
        mark[own] = True
        both = np.diff(np.append(0, np.cumsum(mark[flat]))[first])[rows]
        mark[own] = False
        return (n[rows] > 0) & (100 * both >= percent * (n[rows] + n[i] - both))

    return _edge_table(node, _joining(one, two, group, similar))


def with_rest(rows: DataFrame, key: str) -> DataFrame:
    """``rest``: not of the largest group of its ``key``. Keys with a single group go, and so do lists of two."""
    counts = rows.groupBy(key, "label").agg(F.count("node").alias("n"))
    sizes = counts.groupBy(key).agg(
        F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("main"),
    ).filter("all > 2 and most < all")
    return rows.join(sizes.select(key, "main"), key).withColumn("rest", F.col("label") != F.col("main")).drop("main")


def with_large(rows: DataFrame, sizes: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``sizes`` (the large keys only), null for other keys.

    As long as the large keys are few they are broadcast, and so are the largest of them otherwise; rows of one key never
    meet in a task for this.
    """
    sizes = common.materialise(sizes, "large-keys")
    if sizes.count() <= FREQUENT:
        return rows.join(F.broadcast(sizes), key, "left")
    large = frequency_split_join(rows, sizes, [key], count)
    rest = rows.join(sizes.select(key).hint("merge"), key, "left_anti")
    return large.unionByName(rest, allowMissingColumns=True)


def in_blocks(rows: DataFrame, key: str, block: int, spread: tuple[str, ...] = ("node",)) -> DataFrame:
    """Rows copied to the blocks (kind, i, j) of their ``key`` in which they are compared, with their side there.

    Every member of ``rest`` meets every member of the key. A key of up to ``block`` rows is one block (kind 2) without
    copies. Of a larger one, rows are dealt to blocks by hash of the ``spread`` columns: kind 0 sets a block of the rest (side
    0) against a block of the others (1); kind 1 sets two blocks of the rest against each other, or one against itself (side 2).
    """
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    sizes = rows.groupBy(key).agg(F.count_if("rest").alias("in_rest"), F.count_if(~F.col("rest")).alias("in_main")).select(
        key, (F.col("in_rest") + F.col("in_main")).alias("of_key"), blocks("in_rest").alias("in_rest"),
        blocks("in_main").alias("in_main")).filter(F.col("of_key") > block)
    sized = with_large(rows, sizes, key, "of_key")
    own = F.pmod(F.xxhash64(*spread), F.when(F.col("rest"), F.col("in_rest")).otherwise(F.col("in_main"))).cast("int")
    numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(
        F.array().cast("array<int>"))
    entry = lambda kind, i, j, side: F.struct(
        F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    mine, none = F.col("own"), F.lit(0)
    whole = F.array(entry(2, none, none, F.when(F.col("rest"), 2).otherwise(1)))
    with_main = F.transform(numbers("in_main"), lambda j: entry(0, mine, j, F.lit(0)))
    with_rest_ = F.transform(numbers("in_rest"), lambda j: entry(
        1, F.least(mine, j), F.greatest(mine, j), F.when(mine == j, 2).when(mine < j, 0).otherwise(1)))
    from_main = F.transform(numbers("in_rest"), lambda i: entry(0, i, mine, F.lit(1)))
    placed = sized.withColumn("own", own).withColumn("b", F.explode(F.when(F.col("of_key").isNull(), whole).when(
        F.col("rest"), F.concat(with_main, with_rest_)).otherwise(from_main)))
    return placed.select("*", "b.*").drop("in_rest", "in_main", "of_key", "own", "b", "rest")


def remaining_collisions(lists: DataFrame, matches: int) -> DataFrame:
    """(u, v): collisions that join the groups of each list, lists of two excepted (a leader has met the other)."""
    return in_blocks(with_rest(lists, "token"), "token", LIST_BLOCK).groupBy("token", "kind", "i", "j").applyInArrow(
        lambda table: _collisions(table, matches), "u long, v long")


def collision_components(posted: DataFrame, matches: int) -> DataFrame:
    """(node, component): components of the graph of all pairs with enough collisions; nodes without any are left out."""
    labels = None
    for turn in range(3):
        own = F.col("node") if labels is None else F.coalesce("component", "node")
        lists = (posted if labels is None else posted.join(labels, "node", "left")).select(
            "token", "node", own.alias("label"), "sign")
        if turn < 2:
            found = leader_pairs(lists, matches, LEADERS if turn else 1, turn)
        else:
            found = remaining_collisions(lists, matches)
        labels = components(found, labels)
    return labels


def links_within(members: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) by exact similarity. ``members`` (node, family, text): links lie within families."""
    families = members.groupBy("family").agg(F.count("node").alias("n")).filter(F.col("n") > TEXT_BLOCK)
    # Leaders: LEADERS of a large family on average, by hash.
    leader = F.pmod(F.xxhash64("node", "text", F.lit(3)), F.col("n")) < LEADERS
    first = with_large(members, families, "family", "n").select(
        "family", "node", F.col("node").alias("label"), "text", (F.col("n").isNull() | leader).alias("rest"),
        F.col("n").isNull().alias("small"))
    compare = lambda placed: placed.groupBy("family", "kind", "i", "j").applyInArrow(
        lambda table: _links(table, size, percent), "u long, v long")
    blocks = lambda rows: in_blocks(rows, "family", TEXT_BLOCK, ("node", "text"))
    labels = components(compare(blocks(first.drop("small"))), None)
    large = first.filter("not small").select("family", "node", "text").join(labels, "node", "left").select(
        "family", "node", F.coalesce("component", "node").alias("label"), "text")
    return components(compare(blocks(with_rest(large, "family"))), labels)


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``; rows of one doc_id are one node."""
    matches = least_matches(percent)
    known = common.materialise(features(docs, size), "signatures")
    filled = known.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    least = F.min(F.struct("doc_id", "text_hash"))
    classes = common.materialise(
        filled.groupBy("high", "low").agg(least.alias("least"), F.max("sign").alias("sign")).select(
            "high", "low", F.col("least.doc_id").alias("node"), F.col("least.text_hash").alias("text_hash"), "sign"), "classes")
    posted = common.materialise(prefix_postings(classes, matches), "postings")
    families = collision_components(posted, matches)
    # One text of each class: repeated rows collapse before they are shuffled.
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.xxhash64("text").alias("text_hash"), "text").filter(
        F.col("node").isNotNull()).dropDuplicates(["node", "text_hash"])
    own = classes.select("node", "text_hash").join(families.withColumnRenamed("component", "family"), "node")
    # A sort-merge join at every size: the nodes with collisions grow with the documents.
    members = common.materialise(
        texts.join(own.hint("merge"), ["node", "text_hash"]).select("node", "text", "family"), "families")
    labels = links_within(members, size, percent)

    members = known.join(classes.select("high", "low", "node"), ["high", "low"], "left").join(labels, "node", "left")
    part = F.col("n_shingles") > 0
    component = F.when(F.col("doc_id").isNull(), None).when(part, F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    return members.select("doc_id", "n_shingles", component.cast("long").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """All columns of ``docs``: of every component the row with the least id, once; rows without words or without id stay.

    Rows are compared, not ids: rows that share an id but not their words are texts of their own. Rows without words or id
    take part in no join.
    """
    words = F.coalesce(F.col("doc.text"), F.lit("")).rlike(common.WORD_PATTERN) & F.col("doc.doc_id").isNotNull()
    rows = common.materialise(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row")).withColumn(
        "_part", words), "near-rows")
    part = rows.filter("_part")
    texts = part.select(F.col("_row").alias("doc_id"), "doc.text")
    found = near_copies(texts, size, percent).select(F.col("doc_id").alias("_row"), "component_id")
    ids = part.select("_row", F.col("doc.doc_id").cast("long").alias("id"))
    first = ids.join(found.hint("merge"), "_row").groupBy("component_id").agg(F.min(F.struct("id", "_row")).alias("first"))
    stay = first.select(F.col("first._row").alias("_row"))
    return part.join(stay.hint("merge"), "_row", "left_semi").unionByName(rows.filter("not _part")).select("doc.*")

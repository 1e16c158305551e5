"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Targets. Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share the total size; a target above
``MOST`` times its source's size stops there, and the excess is shared again by weight until none is above.

Rates. Among all document rates r in [0, MOST] whose tokens meet the targets, the ones nearest to 1 in relative entropy,
sum r log r - r, are exponential tilts r = min(MOST, exp(lambda * x)) with x = size / mean size of the source. The dual is
convex and has one multiplier per source, solved by Newton steps on the log of the tokens taken, kept inside a shrinking
bracket. Documents of one source and size share a rate, so a step reads a table of (source, size, count), one row per
distinct size, not the documents.

Rounding. A document gets floor(r) copies, and some get one more. Inside a source the fractions are added up from the
largest size down, and a document gets the extra copy where the running sum passes a whole number. Neighbours in this
order have nearly equal sizes, so the words taken miss the target by less than the size of the largest document. The choice among
documents of equal size is by hash of the id, so reruns agree.

A source or a size that holds a third of all rows is counted by partial aggregation and spread over ``SALTS`` groups for
the choice. Null or empty text: size 0, one copy, no words. Null source: a source of its own. An empty table gives an
empty result. Rows with equal ids are documents of their own, chosen in an arbitrary order among equals; ``mix`` numbers the
rows, so each is taken as often as its own decision says. Rows without an id come after the others of their size and are
spread by row. A target of 0 (a source without words) leaves its documents as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborwatch.llm.common import WORD_PATTERN, materialise

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Groups over which documents of one source and size are spread for the choice.
SALTS = 1024
NEWTON_STEPS = 40
#: Relative distance of the real-valued solution from its target.
CLOSE = 1e-9


def text_size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of each row, which holds once the result is written."""
    return docs.withColumn("_row", F.monotonically_increasing_id())


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, _row, key, size, salt): ``key`` is the source, with null told apart from every string."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("_row"), F.lit(SALTS)) + SALTS).otherwise(
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    return docs.select("doc_id", "_row", key.alias("key"), text_size().alias("size")).withColumn("salt", salt.cast("int"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``by_source`` (key, source_size, docs) with ``target``; one row per source.

    Sharing the excess again until no target is above its limit is filling to a level: with limits MOST * size and
    sources in order of limit / weight, those before the first that the level does not reach stop at their limit.
    """
    ordered = W.orderBy("key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    limit = F.col("source_size") * float(MOST)
    filling = W.orderBy("ratio", "key")
    before, after = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    ranked = by_source.withColumn("rank", F.row_number().over(ordered)).withColumn("weight", weight)
    levels = ranked.withColumns({"limit": limit, "ratio": limit / F.col("weight")}).withColumn(
        "level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / F.sum("weight").over(after))
    # The first source whose limit lies above the level fixes it for all that follow.
    fixed = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "key", "level"))).over(whole)["level"]
    target = F.least("limit", F.coalesce(fixed * F.col("weight"), F.col("limit")))
    return levels.withColumn("target", target).select("key", "source_size", "docs", "target")


def _relative_size() -> Column:
    """Size over the mean size of the source; 0 in a source without words."""
    return F.coalesce(F.try_divide(F.col("size") * F.col("docs"), F.col("source_size")), F.lit(0.0))


def _newton(cells: DataFrame, goal: DataFrame) -> DataFrame:
    """(key, source_size, docs, target, lam): the multipliers of all sources, one bounded pass over the cells a step."""
    state = materialise(goal.withColumns({
        "lam": F.lit(0.0), "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "open": F.col("target") > 0}), "dual")
    x = _relative_size()
    tilt = F.exp(F.least(F.col("lam") * x, F.lit(2.0)))
    tokens = F.col("n") * F.col("size")
    for _ in range(NEWTON_STEPS):
        if not state.filter("open").limit(1).count():
            break
        met = cells.join(state.select("key", "lam", "docs", "source_size"), "key")
        sums = met.groupBy("key").agg(
            F.sum(tokens * F.least(tilt, F.lit(float(MOST)))).alias("taken"),
            F.sum(F.when(tilt < MOST, tokens * tilt * x).otherwise(0.0)).alias("slope"))
        over = F.col("taken") > F.col("target")
        done = F.abs(F.col("taken") - F.col("target")) <= CLOSE * F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.greatest("low", "lam"))
        high = F.when(over, F.least("high", "lam")).otherwise(F.col("high"))
        step = F.col("lam") + F.try_divide(
            F.ln(F.try_divide(F.col("target"), F.col("taken"))) * F.col("taken"), F.col("slope"))
        inside = F.coalesce((F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high")), F.lit(False))
        # Outside the bracket: its middle, or twice as far where one side is still open.
        middle = (F.when(F.col("high") == float("inf"), F.greatest(F.col("low") * 2, F.lit(1.0)))
                  .when(F.col("low") == float("-inf"), F.least(F.col("high") * 2, F.lit(-1.0)))
                  .otherwise((F.col("low") + F.col("high")) / 2))
        state = materialise(
            state.join(sums, "key", "left")
            .withColumns({"low": low, "high": high, "open": F.col("open") & ~F.coalesce(done, F.lit(True))})
            .withColumn("lam", F.when(~F.col("open"), F.col("lam")).when(inside, step).otherwise(middle))
            .drop("taken", "slope"), "dual")
    else:
        if state.filter("open").limit(1).count():
            raise RuntimeError(f"a source did not reach its target within {NEWTON_STEPS} steps")
    return state.drop("low", "high", "open")


def _decided(docs: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(doc_id, _row, size, source_size, target, copies) of every row of ``docs``, which has numbers."""
    rows = materialise(sized(docs), "sizes")
    groups = materialise(rows.groupBy("key", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "groups")
    cells = materialise(groups.groupBy("key", "size").agg(F.sum("n").alias("n")), "cells")
    by_source = cells.groupBy("key").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    solved = _newton(cells, materialise(targets(by_source, weights), "targets"))

    x = _relative_size()
    rate = F.when((F.col("target") > 0) & (F.col("size") > 0),
                  F.least(F.exp(F.least(F.col("lam") * x, F.lit(2.0))), F.lit(float(MOST)))).otherwise(1.0)
    rated = cells.join(solved, "key").withColumn("rate", rate).withColumns({
        "base": F.floor("rate"), "part": F.col("rate") - F.floor("rate")})
    # Extra copies of a cell: whole numbers passed by the running sum of fractions, by size, then by salt.
    by_size = W.partitionBy("key").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    cell_start = F.coalesce(F.sum(F.col("n") * F.col("part")).over(by_size), F.lit(0.0))
    starts = rated.withColumn("start", cell_start).drop("n")
    by_salt = W.partitionBy("key", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(by_salt), F.lit(0))
    counted = groups.withColumn("before", before).join(starts, ["key", "size"])
    half = F.lit(0.5)
    passed = lambda at: F.floor(F.col("start") + at * F.col("part") + half)
    extra = counted.withColumn("extra", passed(F.col("before") + F.col("n")) - passed(F.col("before")))
    chosen = rows.withColumn("place", F.row_number().over(
        W.partitionBy("key", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "_row")))
    number = F.col("base") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)
    return chosen.join(extra.drop("docs"), ["key", "size", "salt"]).select(
        "doc_id", "_row", "size", "source_size", "target", number.cast("long").alias("copies"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every row of ``docs``."""
    return _decided(numbered(docs), weights).drop("_row")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """All columns of ``docs``, every row as often as the mix takes it."""
    rows = materialise(numbered(docs), "mix-rows")
    often = _decided(rows, weights).filter("copies > 0").select("_row", F.col("copies").alias("_copies"))
    taken = rows.join(often, "_row")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*docs.columns)

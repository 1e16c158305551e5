"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of one source are shuffled by a seeded hash and ranked; row r of n has the fractional rank (2r - 1) / 2n. Sorted by
it, all sources run through the whole order at their own even pace, so every cut of it holds the mixture. The order is cut
into ``shards`` runs whose row counts differ by one at most (law ``rows``); a shard holds of every source its share of the
rows to within about one row, plus one for each source where their paces meet.

No source and no shard is sorted in one task. Ranks: rows are counted by (source, slice of the hash), the counts of the
``SLICES`` slices of a source are added up, and only rows of one slice are sorted together. Places: the same over slices of
the fractional rank, which are even by construction. Two shuffles of narrow rows; texts are read once and not moved. A
source with a third of all rows is dealt to ``SLICES`` groups of even size; copies of one text are dealt by their ids, rows
without an id by their number.

Null source: a source of its own. Null text: as empty. Repeated ids: rows of their own, told apart by text; rows equal in
id, source and text are interchangeable. Rows without an id are shuffled by their place in the table, so they keep their
shards in a rerun over the same files only. An empty table gives an empty result; fewer rows than shards leave shards empty. Further columns are ignored by ``assign`` and kept by ``sharded``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborwatch.llm.common import materialise

SHARDS = 40
SEED = 20240501
#: Slices of a source's hash range, and of the range of fractional ranks.
SLICES = 1024
#: Bits of the shuffling hash: fifteen hexadecimal digits, a positive long.
_HASH_BITS = 60
_ROW_BYTES = 16


def _hash(seed: int) -> Column:
    """A number below 2^60 from the id (its row's number, where it is null) and the text's checksum."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row"), F.col("_row").cast("string")))
    name = F.concat_ws(":", F.lit(str(seed)), own, F.col("text_crc32"))
    return F.conv(F.substring(F.md5(name), 1, _HASH_BITS // 4), 16, 10).cast("long")


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, _row): the rows as structs, so that no name clashes, and their numbers, which hold once a result is written."""
    return docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row"))


def _narrow(docs: DataFrame, by: str, seed: int) -> DataFrame:
    """(doc_id, _row, stratum, size, text_crc32, mix, slice) of numbered rows."""
    text = F.coalesce(F.col("doc.text"), F.lit("")).cast("binary")
    source = F.col("doc")[by]
    stratum = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))
    return docs.select(
        "doc.doc_id", "_row", stratum.alias("stratum"), (F.octet_length(text) + _ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("mix", _hash(seed)).withColumn(
        "slice", F.shiftrightunsigned("mix", _HASH_BITS - SLICES.bit_length() + 1).cast("int"))


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pace``, the fractional rank inside the stratum."""
    counts = rows.groupBy("stratum", "slice").agg(F.count(F.lit(1)).alias("n"))
    stratum = W.partitionBy("stratum")
    earlier = stratum.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("stratum", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                           F.sum("n").over(stratum).alias("of"))
    inside = W.partitionBy("stratum", "slice").orderBy("mix", "doc_id", "text_crc32", "size")
    return rows.withColumn("nth", F.row_number().over(inside)).join(shifts, ["stratum", "slice"]).withColumn(
        "pace", (2 * (F.col("before") + F.col("nth")) - 1) / (2 * F.col("of"))).drop("before", "of", "nth", "slice")


def _placed(ranked: DataFrame) -> DataFrame:
    """``ranked`` with ``place`` (from 0) in the whole order and ``total``, the number of rows."""
    cut = ranked.withColumn("slice", F.floor(F.col("pace") * SLICES).cast("int"))
    # One row per slice: SLICES rows at any size, so the window without a key and the broadcast are bounded.
    counts = cut.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shifts = counts.select("slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
                           F.sum("n").over(every).alias("total"))
    inside = W.partitionBy("slice").orderBy("pace", "stratum", "mix", "doc_id", "text_crc32", "size")
    return cut.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(shifts), "slice").withColumn(
        "place", F.col("before") + F.col("nth") - 1).drop("before", "nth", "slice")


def _assigned(docs: DataFrame, by: str, shards: int, seed: int) -> DataFrame:
    rows = materialise(_narrow(docs, by, seed), "interleave-rows")
    placed = _placed(materialise(_ranked(rows), "interleave-ranks"))
    # Shard k begins at the least place p with p * shards >= k * total.
    shard = F.expr(f"(place * {shards}) div total")
    begin = F.expr(f"(({shards} - 1) + shard * total) div {shards}")
    slot = F.col("place") - begin
    return placed.withColumn("shard", shard).withColumn("slot", slot)


def assign(docs: DataFrame, by: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``."""
    return _assigned(_numbered(docs), by, shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded(
    docs: DataFrame, by: str = "source", shards: int = SHARDS, seed: int = SEED, names: tuple[str, str] = ("shard", "slot"),
) -> DataFrame:
    """All columns of ``docs`` and the row's shard and place there, under ``names``."""
    numbered = materialise(_numbered(docs), "interleave-docs")
    places = _assigned(numbered, by, shards, seed).select(
        "_row", F.col("shard").cast("int").alias("_shard"), F.col("slot").cast("long").alias("_slot"))
    return numbered.join(places, "_row").select(
        "doc.*", F.col("_shard").alias(names[0]), F.col("_slot").alias(names[1]))


def write_shards(
    docs: DataFrame, path: str, by: str = "source", shards: int = SHARDS, seed: int = SEED,
    names: tuple[str, str] = ("shard", "slot"),
) -> None:
    """Writes a folder per shard, its rows dealt to files by runs of slots and sorted inside each."""
    placed = sharded(docs, by, shards, seed, names)
    placed.repartitionByRange(*names).sortWithinPartitions(*names).write.partitionBy(names[0]).parquet(path)

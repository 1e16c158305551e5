"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (key, n_docs, max_doc, n_rows), one row per key, bucketed and sorted by key. A batch of documents is
counted by key and merge-anti-joined with the runs there are, which need no exchange and no sort for it: keys that no run
holds become a run of level 0, so a key is in one run only; counts of keys that a run holds go to ``again``. ``FAN_IN`` runs
of a level are merged into one run of the next, so a key is rewritten once per level and with b batches there are at most
FAN_IN * log(b) runs. Earlier texts are never read again.

Two uses:
* ``drop_seen``: lines whose key an earlier batch holds go (merge anti-join), then the batch adds its own keys;
* ``drop_shared``: all batches pass first; the runs with what came again, joined run by run, say which keys are in at least
  ``min_docs`` documents, and such a line goes where another document with a larger id holds it.

A key is the 128-bit hash of the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased; keys below
``min_chars`` code points take no part. Null text is one empty line. Rows with equal doc_id are one document for the
counts (and each loses or keeps its lines alike); a null doc_id counts as one document below all others. An empty table
gives an empty result; further columns pass through.

A key that a third of all documents holds is one row per task after partial aggregation, and one row in a run; where postings
meet the shared keys, keys with many postings are broadcast (their number is bounded) and their postings stay in place. Counts go by doc_id, drops by doc_id
and hash of the text: what meets in one group is the drops of one text, bounded by its own lines, however many rows share
its id or have none. Whether a line goes depends on its key and the doc_id only, so texts of one id with equal hashes
would still lose the right lines.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.llm import common
from harborwatch.operators.skew import frequency_split_join
from harborwatch.session import work_path

MIN_CHARS = 20
MIN_DOCS = 3
FAN_IN = 4
#: Batches in which a whole table arrives.
BATCHES = 5
#: Stands for a null doc_id: below all others.
NO_ID = -(1 << 63)

_SPACES = common.SPACES


def _long_enough(key: bytes, least: int) -> bool:
    if len(key) < least or len(key) >= 4 * least:  # a code point has one to four bytes
        return len(key) >= least
    return len(key.decode()) >= least


def line_keys(text: str, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and their keys (None where too short)."""
    lines = text.encode().split(b"\n")
    stripped = [line.strip(_SPACES).lower() for line in lines]  # bytes.lower() changes A-Z only
    return lines, [xxhash.xxh3_128_digest(k) if _long_enough(k, least) else None for k in stripped]


def _postings(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, parts, keys = [], [], []
        for doc, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = set(line_keys(text.as_py() or "", least)[1]) - {None}
            ids += [doc] * len(found)
            parts += [part] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(parts, pa.int64())], ["key", "doc", "part"])


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _part() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64("text")


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc, part): distinct keys of each row."""
    common.ship(docs.sparkSession)
    common.bound_batches(docs.sparkSession)
    return docs.select(_doc().alias("doc"), _part().alias("part"), "text").mapInArrow(
        lambda batches: _postings(batches, min_chars), "key binary, doc long, part long")


def _counts(batch: DataFrame) -> DataFrame:
    """(key, n_docs, max_doc, n_rows) of postings."""
    pairs = batch.groupBy("key", "doc").agg(F.count(F.lit(1)).alias("n_rows"))
    return pairs.groupBy("key").agg(
        F.count("doc").alias("n_docs"), F.max("doc").alias("max_doc"), F.sum("n_rows").alias("n_rows"))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("key").agg(
        F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.sum("n_rows").alias("n_rows"))


class LineRuns:
    """The levelled store: bucketed tables whose files are in the shared folder of the session."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int | None = None) -> None:
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.again: list[DataFrame] = []
        self._names: list[str] = []

    def _write(self, keys: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        keys.write.bucketBy(self.buckets, "key").sortBy("key").option("path", work_path(self.spark, "line-run")).saveAsTable(name)
        self._names.append(name)
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> None:
        """Adds the postings of a batch: new keys as a run, counts of known ones to ``again``; compacts full levels."""
        counted = common.materialise(_counts(batch), "line-batch-counts")
        fresh = self.unseen(counted)
        self.again += [counted.join(run.hint("merge"), "key", "left_semi") for run in self.runs()]
        run, level = self._write(fresh), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_in:
                return
            # What came again was found in the runs that go now, so it is written down first.
            self.again = [common.materialise(_union(self.again), "line-again")] if self.again else []
            run = self._write(_union(self.levels[level]).repartition(self.buckets, "key"))
            self.levels[level] = []
            level += 1

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose key is in no run: a merge anti-join with each run."""
        for run in self.runs():
            batch = batch.join(run.hint("merge"), "key", "left_anti")
        return batch

    def totals(self, min_docs: int = 1) -> DataFrame:
        """(key, n_docs, max_doc, n_rows) of keys in at least ``min_docs`` documents, run by run."""
        again = common.materialise(_summed(_union(self.again)), "line-again") if self.again else None
        found = []
        for run in self.runs():
            if again is None:
                found.append(run)
                continue
            more = again.select("key", *[F.col(c).alias(f"_{c}") for c in ("n_docs", "max_doc", "n_rows")])
            none = F.lit(0).cast("long")
            found.append(run.join(more.hint("merge"), "key", "left").select(
                "key", (F.col("n_docs") + F.coalesce("_n_docs", none)).alias("n_docs"), F.greatest("max_doc", "_max_doc").alias("max_doc"),
                (F.col("n_rows") + F.coalesce("_n_rows", none)).alias("n_rows")))
        return _union(found).filter(F.col("n_docs") >= min_docs)

    def close(self) -> None:
        """Forgets the tables; their files stay in the shared folder like other work tables."""
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self.again, self._names = [], [], []


def _union(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for one in tables[1:]:
        every = every.unionByName(one)
    return every


def _rewrite(
    batches: Iterator[pa.RecordBatch], least: int, names: list[str], counts: tuple[str, str]
) -> Iterator[pa.RecordBatch]:
    """Last two columns: text and the keys that go."""
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        for text, drops in zip(batch.column(len(names)), batch.column(len(names) + 1)):
            text, gone = text.as_py() or "", set(drops.as_py() or ())
            if not gone:
                texts.append(text)
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(0)
                continue
            lines, keys = line_keys(text, least)
            left = [line for line, key in zip(lines, keys) if key is None or key not in gone]
            texts.append(b"\n".join(left).decode())
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()),
             pa.array(n_dropped, pa.int64())], [*names, "text", *counts])


def _without(docs: DataFrame, drops: DataFrame, min_chars: int, counts: tuple[str, str]) -> DataFrame:
    """``docs`` with the keys of ``drops`` (key, doc, part) taken out; adds the two counts."""
    common.ship(docs.sparkSession)
    common.bound_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]
    lists = drops.groupBy(F.col("doc").alias("_doc"), F.col("part").alias("_part")).agg(F.collect_list("key").alias("_drops"))
    # Written first, so that adaptive execution can split the join where a text is repeated in very many rows.
    lists = common.materialise(lists, "line-drops")
    joined = docs.withColumns({"_doc": _doc(), "_part": _part()}).join(lists, ["_doc", "_part"], "left")
    picked = joined.select(*others, "text", "_drops")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema.fields)
    return picked.mapInArrow(lambda batches: _rewrite(batches, min_chars, others, counts),
                             f"{own}, text string, `{counts[0]}` long, `{counts[1]}` long")


def drop_shared(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """All columns of ``docs``, the text without shared lines, and ``counts``: lines before, and lines dropped."""
    spark = docs.sparkSession
    arrived = postings(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
    path = work_path(spark, "line-postings")
    arrived.write.partitionBy("batch").parquet(path)
    pairs = spark.read.schema(arrived.schema).parquet(path)
    store = LineRuns(spark)
    for i in range(batches):
        store.add(pairs.filter(F.col("batch") == i).drop("batch"))
    shared = common.materialise(store.totals(min_docs).select("key", "max_doc", "n_rows"), "shared-lines")
    store.close()
    met = frequency_split_join(pairs.select("key", "doc", "part"), shared, ["key"], "n_rows")
    drops = met.filter(F.col("doc") < F.col("max_doc")).select("key", "doc", "part")
    return _without(docs, drops.distinct(), min_chars, counts)


def drop_seen(batch: DataFrame, store: LineRuns, min_chars: int = MIN_CHARS) -> DataFrame:
    """The batch without lines that earlier batches hold; the store then knows the batch's own lines."""
    pairs = common.materialise(postings(batch, min_chars).distinct(), "line-postings")
    known = pairs.join(store.unseen(pairs), ["key", "doc"], "left_anti") if store.runs() else pairs.limit(0)
    result = common.materialise(_without(batch, known, min_chars, ("n_lines", "n_dropped")), "line-batch")
    store.add(pairs)
    return result

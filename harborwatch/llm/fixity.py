"""Merkle fixity audit of WARC replicas.

``write_segments`` turns pages into WARC/1.1 response records, appended to segments of bounded size, each segment one
cell of a table (Spark has no writer of raw files; ``read_files`` takes segments from WARC files instead) together with
its manifest: the ordered offset ranges of the records.

``tree`` hashes every range of the manifest in a replica's bytes and combines ``FAN`` neighbours at a time up to one
root. A segment's own tree is made in the task that holds its bytes; only segment roots are shuffled. ``audit`` compares
the roots of two trees and, level by level, joins only children of nodes that differ, so equal branches are never read.
A missing segment, or bytes missing at the end of one, differ like changed bytes. The last leaf of a segment holds its
length and the bytes that no range covers, so bytes appended or put between records differ too; its place is the number
of records. Both replicas are hashed by one manifest: ``with_manifest`` hands that of the first (or a stored one) to a
replica read from files, whose own bytes may be damaged. Files that are no plain WARC (cut, overwritten, compressed) have
what could not be read as their last range.

Segments follow the order of the input's partitions and carry the partition in their number; nothing is ordered or
shuffled to build them, and a hot host or page is bytes like any others. Null url or html is written as an empty string;
equal rows are records of their own; an empty table has no segments, no tree and no differences.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborwatch.llm import common

#: A segment is closed when it has reached this size.
SEGMENT_BYTES = 1 << 20
FAN = 16
#: Segments that one input partition may fill.
PER_PARTITION = 1 << 12
DATE = "2024-01-01T00:00:00Z"

SEGMENT = "segment long, data binary, ranges array<struct<offset:long,length:long,page_id:long>>"
NODE = "depth int, segment long, pos long, leaf boolean, hash binary"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    head = (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {DATE}\r\n"
            f"WARC-Target-URI: {url or ''}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\n"
            f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n")
    return head.encode() + body + b"\r\n\r\n"


def _segment_batch(number: int, data: bytes, ranges: list[dict]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([ranges], kind)],
        ["segment", "data", "ranges"])


def _write(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() * PER_PARTITION
    last = number + PER_PARTITION
    data, ranges = bytearray(), []
    for batch in batches:
        for page_id, url, html in zip(*batch.columns):
            page_id = page_id.as_py()
            entry = record(page_id, url.as_py(), html.as_py())
            ranges.append({"offset": len(data), "length": len(entry), "page_id": page_id})
            data += entry
            if len(data) >= limit:
                if number == last:
                    raise ValueError("too many segments in one partition; use larger segments")
                yield _segment_batch(number, bytes(data), ranges)
                number, data, ranges = number + 1, bytearray(), []
    if ranges:
        yield _segment_batch(number, bytes(data), ranges)


def write_segments(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The segments of the pages, fixed in the shared folder."""
    common.ship(pages.sparkSession)
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return common.materialise(picked.mapInArrow(lambda batches: _write(batches, segment_bytes), SEGMENT), "warc")


def record_ranges(data: bytes) -> list[dict]:
    """Manifest of WARC bytes by the lengths that the records state; bytes that state none, to the end, are one range."""
    ranges, at = [], 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        lines = data[at: max(head, at)].split(b"\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
        length = fields.get(b"content-length", b"")
        sound = lines[0].startswith(b"WARC/") and length.isdigit() and len(length) < 19
        end = min(head + 4 + int(length) + 4, len(data)) if sound else len(data)
        ranges.append({"offset": at, "length": end - at, "page_id": None})
        at = end
    return ranges


def with_manifest(replica: DataFrame, manifest: DataFrame) -> DataFrame:
    """The bytes of ``replica`` with the ranges of ``manifest`` (segment, ranges); segments of either side alone stay."""
    ranges = manifest.select("segment", "ranges")
    return replica.select("segment", "data").join(ranges, "segment", "full").select("segment", "data", "ranges")


def read_files(spark, paths: str) -> DataFrame:
    """Segments from uncompressed WARC files, numbered by a hash of the file name; a file is held whole by its task."""
    common.ship(spark)
    files = spark.read.format("binaryFile").load(paths)
    number = F.pmod(F.xxhash64(F.element_at(F.split("path", "/"), -1)), F.lit(1 << 40))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                yield _segment_batch(segment, data, record_ranges(data))

    return files.select(number.alias("segment"), F.col("content").alias("data")).mapInArrow(parse, SEGMENT)


def _hash(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def _outside(view: memoryview, ranges: list[dict], there: bool) -> bytes:
    """Hash of a segment's length and of the bytes that no range covers."""
    found, at = hashlib.sha256(f"{len(view)} {there} ".encode()), 0
    for r in sorted(ranges, key=lambda r: r["offset"]):
        if r["offset"] > at:
            found.update(f"{at} {min(r['offset'], len(view))} ".encode())
            found.update(view[at: r["offset"]])
        at = max(at, r["offset"] + r["length"])
    found.update(view[at:])
    return found.digest()


def _segment_nodes(batches: Iterator[pa.RecordBatch], fan: int) -> Iterator[pa.RecordBatch]:
    """All nodes of each segment's tree, depth 0 being its root; leaves are the records and what lies outside them."""
    for batch in batches:
        for segment, data, ranges in zip(*batch.columns):
            view = memoryview(data.as_buffer() if data.is_valid else b"")
            own = ranges.as_py() or []
            levels = [[]]
            for r in own:
                piece = view[r["offset"]: r["offset"] + r["length"]]
                levels[0].append(_hash(f"{r['offset']} {len(piece)} ".encode() + piece))
            levels[0].append(_outside(view, own, data.is_valid))
            while len(levels[-1]) > 1:
                below = levels[-1]
                levels.append([_hash(b"".join(below[i: i + fan])) for i in range(0, len(below), fan)])
            rows = [(len(levels) - 1 - level, segment.as_py(), i, level == 0, h)
                    for level, hashes in enumerate(levels) for i, h in enumerate(hashes)]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["depth", "segment", "pos", "leaf", "hash"])


class Tree(NamedTuple):
    nodes: DataFrame  # trees of single segments, depth 0 being a segment's root
    upper: list[DataFrame]  # levels above the segments; the last one has a single node


def tree(segments: DataFrame, height: int, fan: int = FAN) -> Tree:
    """``segments``: segment, data and the ranges of the manifest. ``height`` levels above the segments."""
    common.ship(segments.sparkSession)
    nodes = common.materialise(segments.select("segment", "data", "ranges").mapInArrow(
        lambda batches: _segment_nodes(batches, fan), NODE), "nodes")
    below = nodes.filter("depth = 0").select(F.col("segment").alias("pos"), "hash")
    upper = []
    for _ in range(height):
        children = F.sort_array(F.collect_list(F.struct("pos", "hash")))  # at most ``fan``
        below = below.groupBy(F.floor(F.col("pos") / fan).cast("long").alias("parent")).agg(
            F.sha2(F.concat_ws("", F.transform(children, lambda c: F.concat(c["pos"].cast("string"), F.hex(c["hash"])))),
                   256).alias("digest"))
        below = common.materialise(below.select(F.col("parent").alias("pos"), F.unhex("digest").alias("hash")), "level")
        upper.append(below)
    return Tree(nodes, upper)


def height_of(segments: DataFrame, fan: int = FAN) -> int:
    """Levels needed above the segments until one node is left."""
    largest = segments.agg(F.max("segment")).first()[0] or 0
    height = 1
    while largest >= fan**height:
        height += 1
    return height


def _differ(a: DataFrame, b: DataFrame, keys: list[str], under: DataFrame | None, parent: dict[str, Column]) -> DataFrame:
    """Keys whose hashes differ or are on one side only, among the children of ``under``."""
    sides = []
    for side, name in ((a, "_a"), (b, "_b")):
        side = side.withColumns({f"_up_{k}": c for k, c in parent.items()}).withColumnRenamed("hash", name)
        if under is not None:
            ups = under.select(*[F.col(k).alias(f"_up_{k}") for k in parent]).distinct()
            side = side.join(ups, list(ups.columns), "left_semi")
        sides.append(side.select(*keys, name))
    return sides[0].join(sides[1], keys, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)


def audit(one: Tree, two: Tree, fan: int = FAN) -> DataFrame:
    """(segment, pos): the records (by place in the manifest) at which the replicas differ; behind the last record: the
    segment's length or bytes outside the records."""
    spark = one.nodes.sparkSession
    up = F.floor(F.col("pos") / fan).cast("long")
    under: DataFrame | None = None
    found = spark.createDataFrame([], "segment long, pos long")
    for a, b in zip(reversed(one.upper), reversed(two.upper)):
        under = common.materialise(_differ(a, b, ["pos"], under, {"pos": up}), "differ")
        if under.isEmpty():
            return found
    keys, depth = ["segment", "pos", "leaf"], 0
    while True:
        a, b = (t.nodes.filter(F.col("depth") == depth).drop("depth") for t in (one, two))
        if depth == 0:  # a segment is a child of the lowest upper level by its number
            bad = _differ(a, b, keys, under, {"pos": F.floor(F.col("segment") / fan).cast("long")})
        else:
            bad = _differ(a, b, keys, under, {"segment": F.col("segment"), "pos": up})
        bad = common.materialise(bad, "differ")
        found = found.unionByName(bad.filter("leaf").select("segment", "pos"))
        under = bad.filter("not leaf").select("segment", "pos")
        if under.isEmpty():
            return found
        depth += 1


def located(segments: DataFrame, damage: DataFrame) -> DataFrame:
    """(page_id, segment, record_no, offset, length, damaged) of every record of the manifest. Bytes outside the records are
    in ``damage`` only."""
    manifest = segments.select("segment", F.posexplode("ranges").alias("pos", "r")).select(
        "segment", F.col("pos").cast("long").alias("pos"), "r.*")
    marked = manifest.join(damage.withColumn("damaged", F.lit(True)), ["segment", "pos"], "left")
    return marked.select("page_id", "segment", F.col("pos").alias("record_no"), "offset", "length",
                         F.coalesce("damaged", F.lit(False)).alias("damaged"))


def _damage(batches: Iterator[pa.RecordBatch], flip_every: int, cut_every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment, data, ranges in zip(*batch.columns):
            content, own = bytearray(data.as_py()), ranges.as_py()
            for r in own:
                if r["page_id"] is not None and r["page_id"] % flip_every == 0:
                    content[r["offset"] + r["length"] // 2] ^= 1
            if segment.as_py() % cut_every == 3:
                del content[own[-1]["offset"] + 10:]
            yield _segment_batch(segment.as_py(), bytes(content), own)


def damaged_copy(segments: DataFrame, flip_every: int = 97, cut_every: int = 50) -> DataFrame:
    """A replica with one bit changed in every page whose id is divisible by ``flip_every``, and the last record cut
    short in every segment whose number is 3 modulo ``cut_every``."""
    return segments.mapInArrow(lambda batches: _damage(batches, flip_every, cut_every), SEGMENT)

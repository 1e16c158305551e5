"""Byte-level text helpers shared by the operators: numpy over whole Arrow batches, in pieces of bounded size.

Texts are handled as UTF-8 bytes. The word separators and the characters counted here are ASCII, and no byte of a
longer UTF-8 sequence equals an ASCII byte, so byte positions are exact.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from harborwatch.session import work_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bytes of text handled at once inside a task; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: The same where arrays of words, shingles or features are many times the text.
SMALL_CHUNK_BYTES = 1 << 18

#: Bytes of an Arrow batch of texts; a larger row is a batch of its own.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Separators of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True

_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    Where the folder is not shared, the package must be given with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of texts that a Python worker, and the buffers of its executor, hold at once.

    Spark cuts Arrow batches by rows and only then at 64 MB, so memory would grow with the length of the texts, several
    times for each worker. A limit that the session has set itself stays.
    """
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes to the shared folder and reads back: the rows are fixed and survive the loss of executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Chunk(NamedTuple):
    first: int  # row of the batch with which the chunk begins
    data: np.ndarray  # bytes of its texts, one after the other
    offsets: np.ndarray  # where each text begins; one more than there are texts


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Runs of consecutive texts of at most ``limit`` bytes together (one text at least); null counts as empty."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, where, content = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset: texts.offset + n + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Chunk(row, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row])
        row = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n; kept in the process for the usual chunk sizes."""
    have = len(_powers["up"]) if _powers else 0
    if have < n:
        size = max(n, (SMALL_CHUNK_BYTES if n <= SMALL_CHUNK_BYTES + 64 else CHUNK_BYTES) + 64)
        up, down = (np.full(size, b, np.uint64) for b in (_BASE, _INVERSE))
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > 4 * CHUNK_BYTES:
            return up, down
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE^i; ``span_hash`` turns two of them into the hash of what lies between."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def byte_hash(data: np.ndarray) -> np.ndarray:
    return prefix_hash(_BYTE_CODE[data])


def counts_between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set flags (or sum of values) between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # row inside the chunk
    in_word: np.ndarray  # per byte


def words(chunk: Chunk) -> Words:
    space = _IS_SPACE[chunk.data]
    n = len(space)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, space)
    border = np.zeros(n + 1, bool)  # a text begins here
    border[chunk.offsets] = True
    inside = ~space
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= space[:-1] | border[1:n]
    ends[:-1] &= space[1:] | border[1:n]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(chunk.offsets, start, "right") - 1, inside)


def code_points(data: np.ndarray) -> np.ndarray:
    """Per byte: it begins a code point."""
    return (data & 0xC0) != 0x80

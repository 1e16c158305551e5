"""Packing by power-of-two decomposition: a document is cut into pieces of binary lengths, one sequence each.

A document of L ids becomes floor(L / 1024) pieces of 1024 ids and one piece for every binary digit of the rest, longest
first. Pieces of equal length form a bucket, so a batch drawn from one bucket has no padding, and no sequence holds ids
of two documents. Sequence numbers carry the bucket in their top byte; the sequences of a bucket are one range of ids.

Nothing is shuffled. Null or empty text: the document is the end id alone. Rows that repeat are documents of their own.
The ids are those of the ``tokenizers`` library and its vocabulary file. A text is cut into units, each a run of
spaces and line breaks with what follows it; the ids of a unit do not depend on its neighbours, so ids of units already
seen lately are remembered (bounded in number), and others come from the same vocabulary's rank file, whose reader is
faster on short strings. Texts with other white space, where a cut could matter, or with the strings of special tokens
are encoded whole by ``tokenizers``. Tests compare the two readers.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from harborwatch.llm import common

MAX_LENGTH = 1024
END_ID = 0
#: Units whose ids a worker remembers; when full, the half not met since the last time is forgotten.
MEMO_UNITS = 1 << 17
#: Pieces, and bytes of their ids, that a worker gathers before it hands them on, within a document as well.
OUT_ROWS = 4096
OUT_BYTES = 1 << 20
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"

RESULT = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "bucket int, ids binary")

_UNITS = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
#: White space of Unicode other than space and line break, and characters that only some libraries count to it.
_OTHER_SPACE = re.compile(
    "[\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff]").search
_loaded: dict[str, object] = {}


class _Memo(dict):
    """unit -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode) -> None:
        self.encode = encode
        self.older: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= MEMO_UNITS // 2:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(unit)
        if ids is None:
            ids = _as_bytes(self.encode(unit))
        if len(unit) <= 64:
            self[unit] = ids
        return ids


def _as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes() if len(ids) > 8 else struct.pack(f"<{len(ids)}I", *ids)


def encoder(vocabulary: str, ranks: str):
    """text -> ids as bytes. Both libraries are loaded once in a worker process."""
    if (vocabulary, ranks) not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            by_bytes = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_bytes, special_tokens={})
        memo = _Memo(bpe.encode_ordinary)

        def encode(text: str) -> bytes:
            if _OTHER_SPACE(text) or any(s in text for s in special):
                return _as_bytes(tokenizer.encode(text, add_special_tokens=False).ids)
            return b"".join(map(memo.__getitem__, _UNITS(text)))

        _loaded[vocabulary, ranks] = encode
    return _loaded[vocabulary, ranks]


def pieces(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def _pack(
    batches: Iterator[pa.RecordBatch], files: tuple[str, str], longest: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    encode = encoder(*files)
    part = TaskContext.get().partitionId()
    used = [0] * longest.bit_length()
    names = [c.split()[0] for c in RESULT.split(", ")][: None if with_ids else -1]
    end = np.asarray([END_ID], "<u4").tobytes()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            doc_id, text = doc_id.as_py(), text.as_py()
            ids = encode(text or "") + end
            start, total = 0, len(ids) // 4
            for length in pieces(total, longest):
                bucket = length.bit_length() - 1
                piece = ids[4 * start: 4 * (start + length)]
                sequence = bucket << 56 | part << 32 | used[bucket]
                used[bucket] += 1
                rows.append((doc_id, start, length, zlib.crc32(piece), total, sequence, 0, bucket)
                            + ((piece,) if with_ids else ()))
                start += length
                held += len(piece)
                if len(rows) >= OUT_ROWS or held >= OUT_BYTES:
                    yield out(rows)
                    rows, held = [], 0
    if rows:
        yield out(rows)


def pack(
    docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, longest: int = MAX_LENGTH,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece. ``longest`` is a power of two; the two files hold one vocabulary and are local to every executor."""
    if longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    common.ship(docs.sparkSession)
    common.bound_batches(docs.sparkSession)
    files = vocabulary or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS)
    schema = RESULT if with_ids else RESULT.rpartition(", ")[0]
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _pack(batches, files, longest, with_ids), schema)

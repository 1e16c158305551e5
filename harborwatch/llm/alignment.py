"""Alignment of two tokenizers: which tokens of one end where tokens of the other end, and how often over the corpus.

1. A text is tokenised whole by both: A with a space put before it, B with the space it adds itself. Ids have byte strings;
   a text whose joined bytes differ from space and text on either side has no tokens.
2. Byte positions where an A and a B token end and the next tokens begin with a space are anchors. Both ends are verified,
   so the ids between two anchors, a window, cover the same bytes on both sides, and how they align depends on the two
   tuples of ids only. Words come again and again: each pair of tuples is aligned once in a block of texts and remembered
   for its other windows, found by two 64-bit hashes of the tuples.
3. Inside a window, positions where both have a token end cut the ids into groups; the last ids of a group are a link.
4. Links are counted over all texts. Texts of one task come in blocks of bounded bytes; a block posts each linked pair once
   with its number. Pairs are summed, the highest number per B id found, and each block gets the numbers of its own pairs
   back (a block and its pairs are brought together by key) to sum them per text.

A pair that is in every block is one row per block. The table of summed pairs is shuffled, not broadcast: it grows with the
corpus up to the product of the vocabularies. Null or empty texts and those with other bytes: zeros and ''. Rows that repeat,
and those without an id, are texts of their own. A very long text is a block by itself, in about 100 bytes of memory a byte
of text. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.llm import common
from harborwatch.llm.packing import _OTHER_SPACE

VOCABULARY_A, RANKS_A, MODEL_B = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Bytes of text in a block.
BLOCK_BYTES = 2 << 20

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_SPACE_MARK = "▁"
_loaded: dict[tuple, tuple["Side", "Side"]] = {}


def byte_level(token: str) -> bytes:
    """Bytes of an entry of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes, in order, for the
    code points from 256 on."""
    if not _byte_of:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        _byte_of.update({chr(b): b for b in plain})
        _byte_of.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return bytes(_byte_of[c] for c in token)


_byte_of: dict[str, int] = {}


class _A:
    """The byte-level vocabulary. Special tokens' strings inside texts are plain text."""

    def __init__(self, vocabulary: str, ranks: str) -> None:
        import tiktoken

        self.vocabulary, self.tokenizer = vocabulary, None
        with open(vocabulary, encoding="utf-8") as file:
            read = json.load(file)
        entries = {i: byte_level(token) for token, i in read["model"]["vocab"].items()
                   if i not in {t["id"] for t in read["added_tokens"]}}
        entries |= {t["id"]: t["content"].encode() for t in read["added_tokens"]}
        self.bytes = [entries.get(i, b"") for i in range(max(entries) + 1)]
        with open(ranks, "rb") as lines:
            by_bytes = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_bytes, special_tokens={})
        self.ranked = bpe.encode_ordinary

    def whole(self, text: str) -> list[int]:
        """By the library that reads the vocabulary file itself; loaded with the first text that needs it."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.tokenizer = Tokenizer.from_file(self.vocabulary)
            self.tokenizer.encode_special_tokens = True
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        """Ids of the text with a space before it. The reader of ranks is the faster one; texts with white space that
        the two could take differently go to the other."""
        return self.whole(" " + text) if _OTHER_SPACE(text) else self.ranked(" " + text)


class _B:
    """The piece vocabulary; its reader adds the space itself."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE_MARK, " ").encode()
                      for i, p in enumerate(pieces)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


class Side(NamedTuple):
    """One vocabulary: its reader, the bytes of each id, their number, and each id in decimal with ``,`` or an end sign."""

    encode: Callable[[str], list[int]]
    bytes: list[bytes]
    sizes: np.ndarray
    names: np.ndarray


def _side(reader: _A | _B, end: str) -> Side:
    n = len(reader.bytes)
    names = np.array([f"{i}," for i in range(n)] + [f"{i}{end}" for i in range(n)], object)
    return Side(reader.encode, reader.bytes, np.array([len(x) for x in reader.bytes]), names)


def loaded(files: tuple[str, str, str]) -> tuple[Side, Side]:
    """Both vocabularies, once in a worker process."""
    if files not in _loaded:
        _loaded[files] = _side(_A(*files[:2]), "|"), _side(_B(files[2]), ";")
    return _loaded[files]


class Tokens(NamedTuple):
    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray  # tokens before each window, and in all
    cut_b: np.ndarray


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``size`` of them, one after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


def shared_ends(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Byte positions where both have a token end."""
    marks = np.zeros((2, int(end_a[-1]) + 1), bool)
    marks[0, end_a] = marks[1, end_b] = True
    return np.flatnonzero(marks[0] & marks[1])


def windows(a: np.ndarray, b: np.ndarray, text: bytes, sides: tuple[Side, Side]) -> Tokens:
    """Cuts the ids of verified texts, each with its space before it, at the anchors. Texts end in anchors."""
    end_a, end_b = np.cumsum(sides[0].sizes[a]), np.cumsum(sides[1].sizes[b])
    shared = shared_ends(end_a, end_b)
    anchors = shared[np.append(np.frombuffer(text, np.uint8)[shared[:-1]] == 32, True)]
    cuts = [np.append(0, np.searchsorted(end, anchors, "right")) for end in (end_a, end_b)]
    return Tokens(a, b, *cuts)


def distinct(tokens: Tokens) -> tuple[Tokens, np.ndarray]:
    """One window for each pair of id tuples, and for every window the number of its like."""
    hashes = []
    for ids, cut in ((tokens.a, tokens.cut_a), (tokens.b, tokens.cut_b)):
        prefix = common.prefix_hash(common.mixed(ids.astype(np.uint64) + np.uint64(1)))
        hashes.append(common.mixed(common.span_hash(prefix, cut[:-1], cut[1:]) + np.diff(cut).astype(np.uint64)))
    first, like = np.unique(hashes[0] + common.mixed(hashes[1]), return_index=True, return_inverse=True)[1:]
    if any((h[first[like]] != h).any() for h in hashes):
        first, like = np.unique(np.stack(hashes), axis=1, return_index=True, return_inverse=True)[1:]
    size_a, size_b = np.diff(tokens.cut_a)[first], np.diff(tokens.cut_b)[first]
    return Tokens(tokens.a[_ranges(tokens.cut_a[first], size_a)], tokens.b[_ranges(tokens.cut_b[first], size_b)],
                  np.append(0, np.cumsum(size_a)), np.append(0, np.cumsum(size_b))), like.ravel()


def align(tokens: Tokens, sides: tuple[Side, Side]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of each window as text, each group with ``;`` behind it; number of groups; links (A id << 32 | B id)."""
    a, b = tokens.a, tokens.b
    end_a, end_b = np.cumsum(sides[0].sizes[a]), np.cumsum(sides[1].sizes[b])
    shared = shared_ends(end_a, end_b)
    last_a, last_b = np.searchsorted(end_a, shared), np.searchsorted(end_b, shared)
    ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    ends_a[last_a] = ends_b[last_b] = 1
    # Ids in the order in which they are said: of every group its A ids, then its B ids.
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    said = np.empty(len(a) + len(b), object)
    said[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = sides[0].names[a + ends_a * len(sides[0].bytes)]
    said[np.arange(len(b)) + (last_a + 1)[group_b]] = sides[1].names[b + ends_b * len(sides[1].bytes)]
    pieces, cuts = said.tolist(), (tokens.cut_a + tokens.cut_b).tolist()
    texts = np.empty(len(cuts) - 1, object)
    texts[:] = ["".join(pieces[i:j]) for i, j in zip(cuts, cuts[1:])]
    groups = np.diff(np.searchsorted(last_a, tokens.cut_a))
    return texts, groups, a[last_a].astype(np.int64) << 32 | b[last_b]


def packed_links(links: np.ndarray) -> np.ndarray:
    """In four bytes each where both ids fit, as they do with vocabularies of up to 65,536 entries."""
    if not len(links) or (int(links.max()) >> 48 == 0 and int((links & 0xFFFFFFFF).max()) >> 16 == 0):
        return (links >> 16 | links & 0xFFFF).astype("<u4")
    return links.astype("<i8")


def link_codes(packed: bytes, n: int) -> np.ndarray:
    """``n`` packed links as (A id << 32 | B id)."""
    if len(packed) == 8 * n:
        return np.frombuffer(packed, "<i8")
    codes = np.frombuffer(packed, "<u4").astype(np.int64)
    return codes >> 16 << 32 | codes & 0xFFFF


def aligned_texts(texts: list[str], sides: tuple[Side, Side]) -> list[tuple[int, int, int, str, bytes]]:
    """(A tokens, B tokens, groups, checksum of the groups, links) of each text of a block."""
    out: list[tuple[int, int, int, str, bytes]] = [(0, 0, 0, "", b"")] * len(texts)
    sound, ids, wants = [], [], []
    for i, text in enumerate(texts):
        if text:
            both, want = [side.encode(text) for side in sides], b" " + text.encode()
            if all(b"".join(map(side.bytes.__getitem__, found)) == want for side, found in zip(sides, both)):
                sound.append(i)
                ids.append([np.array(found, np.int64) for found in both])
                wants.append(want)
    if not sound:
        return out
    tokens = windows(*map(np.concatenate, zip(*ids)), b"".join(wants), sides)
    once, like = distinct(tokens)
    said, groups, links = align(once, sides)
    first = np.append(0, np.cumsum(groups))
    every, n = said[like].tolist(), groups[like]
    linked = links[_ranges(first[like], n)]
    # Windows and links before each text.
    window_of = np.searchsorted(tokens.cut_a, np.cumsum([0, *(len(x) for x, _ in ids)])).tolist()
    link_of = np.append(0, np.cumsum(n))[window_of].tolist()
    for k, i in enumerate(sound):
        text = "".join(every[window_of[k]: window_of[k + 1]])[:-1]
        own = linked[link_of[k]: link_of[k + 1]]
        out[i] = (len(ids[k][0]), len(ids[k][1]), len(own), hashlib.sha256(text.encode()).hexdigest(), packed_links(own).tobytes())
    return out


def _texts(batches: Iterator[pa.RecordBatch], files: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    sides = loaded(files)
    part, block = TaskContext.get().partitionId(), 0
    for batch in batches:
        for chunk in common.text_chunks(batch.column(1), BLOCK_BYTES):
            rows = len(chunk.offsets) - 1
            texts = batch.column(1).slice(chunk.first, rows)
            n_a, n_b, n, said, links = zip(*aligned_texts([t or "" for t in texts.to_pylist()], sides))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, rows), *(pa.array(c, pa.int64()) for c in (n_a, n_b, n, n)),
                 pa.array(said, pa.string()), pa.array([part << 32 | block] * rows, pa.int64()), pa.array(links, pa.binary())],
                [*(c.split()[0] for c in RESULT.split(", ")), "block", "links"])
            block += 1


def aligned(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, block, links) of every row; ``links`` are packed
    (``link_codes``), ``block`` is the run of rows it came with."""
    common.ship(docs.sparkSession)
    files = files or tuple(public_tokenizers.path(f) for f in (VOCABULARY_A, RANKS_A, MODEL_B))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _texts(batches, files), f"{RESULT}, block long, links binary")


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pair, n): the pairs of each block, from rows that come block by block."""
    for batch in batches:
        blocks = np.asarray(batch.column(0))
        cuts = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1))
        for start, end in zip(cuts.tolist(), cuts[1:].tolist()):
            links = b"".join(batch.column(1).slice(start, end - start).to_pylist())
            n = int(np.asarray(batch.column(2).slice(start, end - start)).sum())
            if not n:
                continue
            if len(links) in (4 * n, 8 * n):
                found, times = np.unique(np.frombuffer(links, f"<u{len(links) // n}"), return_counts=True)
                found = link_codes(found.tobytes(), len(found))
            else:  # some texts of the block are packed wider than others
                codes = map(link_codes, batch.column(1).slice(start, end - start).to_pylist(),
                            batch.column(2).slice(start, end - start).to_pylist())
                found, times = np.unique(np.concatenate(list(codes)), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), blocks[start])), pa.array(found), pa.array(times)], ["block", "pair", "n"])


def counted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``aligned``: (block, pair, n) and, over all texts, (pair, count, best)."""
    by_block = common.materialise(
        texts.select("block", "links", "n_links").mapInArrow(_block_links, "block long, pair long, n long"), "links-by-block")
    counts = common.materialise(by_block.groupBy("pair").agg(F.sum("n").alias("count")), "link-counts")
    own = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = counts.groupBy(own).agg(F.max("count").alias("most"))
    marked = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))).join(most, "b").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))
    return by_block, marked


def _summed(texts: pa.Table, known: pa.Table) -> pa.Table:
    """The texts of a block with the sums over their links, by the numbers of the block's pairs."""
    pair, count, best = (known.column(c).to_numpy() for c in ("pair", "count", "best"))
    order = np.argsort(pair)
    pair, count, best = pair[order], count[order], best[order].astype(np.int64)
    n_best, total = [], []
    for links, n in zip(texts.column("links"), texts.column("n_links").to_pylist()):
        at = np.searchsorted(pair, link_codes(links.as_py(), n))
        n_best.append(int(best[at].sum()))
        total.append(int(count[at].sum()))
    return texts.select([c.split()[0] for c in RESULT.split(", ")]).append_column(
        "n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def cross_aligned(docs: DataFrame, files: tuple[str, str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of every row of ``docs``."""
    texts = common.materialise(aligned(docs, files), "aligned")
    by_block, marked = counted(texts)
    known = by_block.select("block", "pair").join(marked, "pair")  # a block read in two batches has some pairs twice
    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _summed, f"{RESULT}, n_best long, count_sum long")

"""Language identification by rank-order profiles of character n-grams.

A profile lists the ``PROFILE`` most frequent n-grams (1 to 3 lower-cased letters, with the borders of words as a
character) of a language's training texts by rank. A text's own most frequent n-grams are ranked alike, and its
out-of-place distance to a profile is the sum of rank differences; an n-gram the profile lacks counts ``PROFILE``. The
nearest profile wins, the first in code-point order at a tie. The score is 1 - distance / largest distance possible.

Profiles are counted over all training texts: tasks add up counts per language before anything is shuffled, so a
language with most of the rows is one row per task and n-gram. What reaches the driver is PROFILE rows per language
(bounded by the number of languages, of which there may be at most ``LANGUAGES``). Scoring shuffles nothing.

Null text, or a text without a letter: ``und``, score 0. Rows without lang teach nothing. A null doc_id is never in the
training part and never held out (its remainder is null): held_out is false. Without any training text every row is
``und``. Repeated rows count as often as they occur. Letters up to U+024F (Latin) keep their identity, others are
folded to ``FOLDED`` codes by number, which is a hash: other scripts work, with rare collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harborwatch.llm import common

PROFILE = 400
LONGEST = 3
LANGUAGES = 1000
UNKNOWN = "und"
#: Code of a word border, number of Latin codes, and number of codes other letters share; ten bits together.
BORDER = 1
LATIN = 0x250
FOLDED = 1024 - LATIN - 2
_BITS = 10
_table: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """Code of every code point: 0 for what is no letter. Made once in a worker process."""
    if not _table:
        codes = np.zeros(0x110000, np.int64)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                low = char.lower()
                low = ord(low) if len(low) == 1 else point
                codes[point] = low + 2 if low < LATIN else LATIN + 2 + low % FOLDED
        _table.append(codes)
    return _table[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count) sorted by row and gram, and per row whether it has a letter."""
    joined = "\n".join(t or "" for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    code = letter_codes()[points]
    row = np.repeat(np.arange(len(texts)), lengths)
    letter = code > 0
    # Runs of other characters become one border; texts end with a line break, so borders separate texts too.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    if len(keep):
        keep[0] = True
    code, row = np.where(letter, code, BORDER)[keep], row[keep]
    has = np.zeros(len(texts), bool)
    has[row[code > BORDER]] = True
    found = []
    for n in range(1, LONGEST + 1):
        if len(code) < n:
            break
        gram, whole = code[: len(code) - n + 1].copy(), len(code) - n + 1
        inner = np.zeros(whole, bool)
        for k in range(1, n):
            gram = gram << _BITS | code[k: k + whole]
            if k < n - 1:
                inner |= code[k: k + whole] == BORDER
        # A border may open or close an n-gram; alone it is none. One that opens belongs to the text of what follows.
        good = ~inner & ((code[:whole] > BORDER) if n == 1 else True)
        found.append((row[n - 1:][good], gram[good]))
    row = np.concatenate([r for r, _ in found])
    key = row << (_BITS * LONGEST) | np.concatenate([g for _, g in found])
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    key, count = key[at], np.diff(np.append(at, len(key)))
    return key >> (_BITS * LONGEST), key & ((1 << _BITS * LONGEST) - 1), count, has


def ranked(row: np.ndarray, gram: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, rank from 0) of the ``most`` frequent grams of each row; the smaller gram first at a tie."""
    order = np.lexsort((gram, -count, row))
    row, gram = row[order], gram[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    top = rank < most
    return row[top], gram[top], rank[top]


def _lists(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    for chunk in common.text_chunks(batch.column(column)):
        rows = len(chunk.offsets) - 1
        yield chunk.first, batch.column(column).slice(chunk.first, rows).to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums inside a task, handed on whenever they grow large."""
    total: dict[str, dict[int, int]] = {}

    def out() -> pa.RecordBatch:
        parts = [(lang, g, n) for lang, own in total.items() for g, n in own.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[i] for p in parts], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))],
            ["lang", "gram", "n"])

    for batch in batches:
        langs = np.asarray(batch.column(0).to_pylist(), object)
        for first, texts in _lists(batch, 1):
            row, gram, count, _ = grams(texts)
            own = langs[first: first + len(texts)]
            for lang in dict.fromkeys(own.tolist()):
                mine = (own == lang)[row]
                codes, where = np.unique(gram[mine], return_inverse=True)
                sums = np.bincount(where, count[mine], len(codes)).astype(np.int64)
                table = total.setdefault(lang, {})
                for g, n in zip(codes.tolist(), sums.tolist()):
                    table[g] = table.get(g, 0) + n
        if sum(map(len, total.values())) > 1_000_000:
            yield out()
            total.clear()
    yield out()


def held_out(every: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))


def profiles(training: DataFrame, size: int = PROFILE) -> list[tuple[str, int, int]]:
    """(lang, gram, rank from 0), from rows with text and lang."""
    common.ship(training.sparkSession)
    counted = training.select("lang", "text").filter("text is not null and lang is not null").mapInArrow(
        _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counted.withColumn("place", place).filter(F.col("place") <= size)
    rows = best.limit(LANGUAGES * size + 1).collect()
    if len(rows) > LANGUAGES * size:
        raise ValueError(f"more than {LANGUAGES} languages")
    return sorted((r["lang"], r["gram"], r["place"] - 1) for r in rows)


def distances(texts: list[str | None], gram_ids: np.ndarray, ranks: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Out-of-place distance of every text to every language, the largest possible, and whether there is a letter."""
    row, gram, count, has = grams(texts)
    row, gram, rank = ranked(row, gram, count, size)
    at = np.minimum(np.searchsorted(gram_ids, gram), len(gram_ids) - 1)
    theirs = ranks[at]
    place = np.where((gram_ids[at] == gram)[:, None] & (theirs >= 0), np.abs(theirs - rank[:, None]), size)
    total = np.stack([np.bincount(row, place[:, k], len(texts)) for k in range(ranks.shape[1])], axis=1)
    return total, np.bincount(row, minlength=len(texts)) * size, has


def _predict(
    batches: Iterator[pa.RecordBatch], langs: list[str], gram_ids: np.ndarray, ranks: np.ndarray, size: int
) -> Iterator[pa.RecordBatch]:
    names = np.asarray([*langs, UNKNOWN], object)
    for batch in batches:
        rest = batch.columns[:-1]
        for first, texts in _lists(batch, len(rest)):
            if langs:
                total, most, has = distances(texts, gram_ids, ranks, size)
                best = np.where(has, total.argmin(axis=1), len(langs))
                score = np.where(has, 1 - total.min(axis=1) / np.maximum(most, 1), 0.0)
            else:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [c.slice(first, len(texts)) for c in rest]
                + [pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())],
                [*batch.schema.names[:-1], "lang_pred", "score"])


def identify(docs: DataFrame, learned: list[tuple[str, int, int]], size: int = PROFILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    common.ship(docs.sparkSession)
    langs = sorted({lang for lang, _, _ in learned})
    gram_ids = np.array(sorted({g for _, g, _ in learned}), np.int64)
    ranks = np.full((len(gram_ids), len(langs)), -1, np.int64)
    for lang, gram, rank in learned:
        ranks[np.searchsorted(gram_ids, gram), langs.index(lang)] = rank
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        lambda batches: _predict(batches, langs, gram_ids, ranks, size),
        f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Profiles from the rows that are not held out, applied to all rows."""
    return identify(docs, profiles(docs.filter(~held_out() & F.col("doc_id").isNotNull())))

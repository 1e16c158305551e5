"""Repetition rules: how much of a text lies inside repeated n-grams and repeated lines.

Every n-gram of words has a rolling hash: with the prefix sums P of word hash times BASE^i, the hash of words
[i, i + n) is (P[i + n] - P[i]) * BASE^-i, so all n-grams of all texts of a batch come from one array operation per n.
A repeated n-gram begins with a repeated (n - 1)-gram; longer ones are only looked for where shorter ones repeat.
The coverage measures count what a text says again: n-grams and lines after their first occurrence.

Nothing is shuffled: a text is judged alone. Null or empty text: no words, hence too short and not kept. Rows that
repeat, null ids and further columns pass through; equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from harborwatch.llm import common

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Largest share of a text's word characters that may lie inside n-grams said again, by n.
MAX_COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: The same for characters in lines said again.
MAX_DUP_LINE_CHARS = 0.20
SYMBOLS = b"#*$%&|<>"

RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, dup_line_chars long, " + ", ".join(f"dup_{n}gram_chars long" for n in MAX_COVERAGE))

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Per key: it occurs at least twice."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    """Per word: it lies inside one of the n-grams that begin at ``at``."""
    depth = np.zeros(n_words + 1, np.int32)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + n, -1)
    return np.cumsum(depth[:-1]) > 0


def _later_copies(text: np.ndarray, keys: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of keys equal to an earlier one, and per key whether it is such a copy."""
    order = np.lexsort((keys, text))
    same = (keys[order[1:]] == keys[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    copy = np.zeros(len(keys), bool)
    copy[order[1:][same]] = True
    return np.bincount(text[copy], minlength=n_texts), copy


def measure(chunk: common.Chunk) -> dict[str, np.ndarray]:
    n_texts = len(chunk.offsets) - 1
    data, offsets = chunk.data, chunk.offsets
    w = common.words(chunk)
    begins = common.code_points(data)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begins, out=chars[1:])
    prefix = common.byte_hash(data)
    word_offsets = np.searchsorted(w.start, offsets)
    out = {
        "n_words": np.diff(word_offsets),
        "word_chars": common.counts_between(begins & w.in_word, offsets),
        "n_symbols": common.counts_between(_IS_SYMBOL[data], offsets),
    }

    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_text = np.concatenate([np.arange(n_texts), np.searchsorted(offsets, breaks, "right") - 1])
    line_text.sort()
    line_end = np.append(line_start[1:] - 1, len(data))
    last = np.append(line_text[1:] != line_text[:-1], True)
    line_end[last] = offsets[line_text[last] + 1]
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(w.in_word, out=filled[1:])
    has_word = filled[line_end] > filled[line_start]
    start, end, of = line_start[has_word], line_end[has_word], line_text[has_word]
    keys = common.mixed(common.span_hash(prefix, start, end) + np.uint64(31) * (end - start).astype(np.uint64))
    out["n_dup_lines"], copy = _later_copies(of, keys, n_texts)
    out["dup_line_chars"] = np.bincount(of[copy], (chars[end] - chars[start])[copy], n_texts).astype(np.int64)
    out["line_chars"] = np.bincount(of, chars[end] - chars[start], n_texts).astype(np.int64)

    n = len(w.start)
    lengths = (w.end - w.start).astype(np.uint64)
    rolling = common.prefix_hash(common.mixed(common.span_hash(prefix, w.start, w.end) + lengths))
    word_size = chars[w.end] - chars[w.start]
    salt = common.mixed(w.text.astype(np.uint64) + np.uint64(1))
    at = np.arange(n)
    for k in MAX_COVERAGE:
        at = at[at + k <= n]
        at = at[w.text[at + k - 1] == w.text[at]]
        keys = common.mixed(common.span_hash(rolling, at, at + k) ^ salt[at])
        repeated = _repeated(keys)
        at, keys = at[repeated], keys[repeated]
        again = np.ones(len(at), bool)
        again[np.unique(keys, return_index=True)[1]] = False
        said_again = np.where(_covered(n, at[again], k), word_size, 0)
        out[f"dup_{k}gram_chars"] = common.counts_between(said_again, word_offsets)
        if k == WINDOW:
            out["n_repeat_words"] = common.counts_between(_covered(n, at, k), word_offsets)
    return out


def verdicts(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    m["base_failed"] = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    good = ~m["base_failed"] & (m["dup_line_chars"] <= MAX_DUP_LINE_CHARS * m["line_chars"])
    for n, most in MAX_COVERAGE.items():
        good &= m[f"dup_{n}gram_chars"] <= most * m["word_chars"]
    m["kept"] = good
    return m


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RESULT.split(", ")]
    for batch in batches:
        at = batch.schema.get_field_index("text")
        rest = [c for i, c in enumerate(batch.columns) if i != at]
        kept_names = [c for i, c in enumerate(batch.schema.names) if i != at]
        for chunk in common.text_chunks(batch.column(at)):
            m = verdicts(measure(chunk))
            rows = len(chunk.offsets) - 1
            yield pa.RecordBatch.from_arrays(
                [c.slice(chunk.first, rows) for c in rest] + [pa.array(m[n]) for n in names], kept_names + names)


def repetition(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the measures of every row of ``docs``; the whole text counts."""
    common.ship(docs.sparkSession)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*keep, "text").mapInArrow(_measure_batches, f"{own}, {RESULT}")

"""Spelling variants: words one letter apart, found with a bit-sliced position index, and the commoner form of each.

Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased; a run of a document whose checksum says so loses one
letter (the rule of ``runs``). The vocabulary is what is long and frequent enough afterwards, counted over all documents.

Index. For a block of words there is one bitset per (position, letter), a bit per word. A query walks its letters once, and
at every letter updates three bitsets for the whole block at the same time: the words that agree so far (no error), those
that agree but for one replaced letter, and those that have one letter more, whose letters are read one position on. What
is left at the end, cut to the right length, are the words at one error. A missing letter is an added one seen from the
longer word, so every word is a query for the words of its own length and one letter longer. All words of a block walk as
queries together, as a matrix of bitsets.

Blocks. Two words one error apart, the shorter of m letters, differ inside one of ``PARTS`` parts of the shorter; what lies
before and behind the part is equal. So a word is posted under (m, part, letters before, letters behind) for each part and
for m its length and one less, as a 64-bit hash (a collision costs a comparison, never a result). Blocks are runs of whole
keys. A key with more than ``KEY_WORDS`` words is posted anew under the two halves of its part, until the part is one
letter: then its words differ in one letter of the alphabet, and their number is bounded by it. So a hot beginning or
ending is split, no pair is missed and no group is paired with itself as a whole.

Forms follow from the pairs: per word the near word with the most occurrences, if it has ``RATIO`` times the word's own.
Following forms multiplies the count each time, so there are no cycles; pointers are doubled until they stand still.

Null and empty texts have no words. A null doc_id counts as an empty one for the rule. Rows that repeat count as often as
they are there. Words of any length take part. Equal counts go to the smaller word in code-point order. An empty table or
vocabulary gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborwatch.llm import common

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
#: A run loses a letter where this divides its checksum.
LOSS = 31
#: Parts of a word of which one may differ.
PARTS = 4
#: Words of one key that are compared without splitting the key; a block ends with the key that reaches it.
KEY_WORDS = 1024
#: Letters of a block, and of one key.
BLOCK_LETTERS = 1 << 22

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame) -> DataFrame:
    """(word): every run of every text, after the rule that takes a letter from some."""
    low = F.translate("run", _UPPER, _LOWER)
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                        F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    hashed = found.select(low.alias("run"), F.crc32(F.concat("id", F.lit(":"), low)).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % LOSS == 0, lost).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words long and frequent enough; a word costs a row per task before it is shuffled."""
    long_enough = words.filter(F.length("word") >= least_letters)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _key() -> Column:
    """Of a word, for the part [first, last) of the shorter word's ``least`` letters."""
    behind = F.col("least") - F.col("last")
    ends = F.expr("substring(word, length(word) - (least - last) + 1, least - last)")
    return F.xxhash64("least", "first", "last", F.expr("substring(word, 1, first)"), F.when(behind > 0, ends).otherwise(""))


def postings(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(word, n, least, first, last, key): every word under each part, as the shorter and as the longer one."""
    own = F.length("word")
    classes = words.withColumn("least", F.explode(F.array(own, own - 1))).filter("least > 0")
    cuts = classes.withColumn("part", F.explode(F.sequence(F.lit(0), F.least(F.lit(parts), F.col("least")) - 1)))
    used = F.least(F.lit(parts), F.col("least"))
    cut = lambda i: F.floor(F.col("least") * i / used).cast("int")
    return cuts.withColumns({"first": cut(F.col("part")), "last": cut(F.col("part") + 1)}).drop("part").withColumn("key", _key())


def split_hot(posted: DataFrame, most: int = KEY_WORDS) -> DataFrame:
    """The postings with every key of more than ``most`` words (fewer, where they are very long) posted again under the
    halves of its part."""
    done = None
    while True:
        posted = common.materialise(posted, "variant-postings")
        sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("in_key"), F.max("least").alias("letters"))
        hot = common.materialise(sizes.filter(
            (F.col("in_key") > most) | (F.col("in_key") * F.col("letters") > BLOCK_LETTERS)).select("key"), "variant-hot")
        if not hot.limit(1).count():
            return posted if done is None else done.unionByName(posted)
        inside = F.col("last") - F.col("first") > 1
        last_ones = posted.filter(~inside)
        rest = posted.filter(inside).join(hot, "key", "left_anti").select(*posted.columns).unionByName(last_ones)
        done = rest if done is None else done.unionByName(rest)
        middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("first"), middle.alias("last")), F.struct(middle.alias("first"), F.col("last"))))
        posted = posted.filter(inside).join(hot, "key").withColumn("half", halves).select(
            "word", "n", "least", F.col("half.first").alias("first"), F.col("half.last").alias("last")).withColumn("key", _key())


def position_index(codes: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of position and letter that occur, as position * letters + letter in order, and a bitset of rows for each.

    ``codes`` has a letter's number per position and -1 behind a word. A last bitset, of no row, serves all other pairs.
    """
    row, at = np.nonzero(codes >= 0)
    pairs, which = np.unique(at * letters + codes[row, at], return_inverse=True)
    bits = np.zeros((len(pairs) + 1, -(-len(codes) // 64)), np.uint64)
    np.bitwise_or.at(bits, (which, row // 64), np.uint64(1) << (row % 64).astype(np.uint64))
    return pairs, bits


def _rows_where(flags: np.ndarray, words: int) -> np.ndarray:
    return np.packbits(np.pad(flags, (0, words * 64 - len(flags))), bitorder="little").view(np.uint64)


def _members(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the bits that are set."""
    query, word = np.nonzero(found)
    bits = np.unpackbits(found[query, word][:, None].view(np.uint8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    return query[which], word[which] * 64 + bit


def near_words(codes: np.ndarray, sizes: np.ndarray, least: int, letters: int) -> tuple[np.ndarray, ...]:
    """Words of ``least`` letters and their near words of as many or one more: (query, near) of replaced, then of added letters."""
    pairs, index = position_index(codes, letters)
    n_words = index.shape[1]
    queries = np.flatnonzero(sizes == least)
    equal = np.repeat(_rows_where(np.ones(len(codes), bool), n_words)[None], len(queries), axis=0)
    replaced, added = np.zeros_like(equal), np.zeros_like(equal)
    for i in range(least):
        own = i * letters + codes[queries, i]
        shifted = own + letters
        after = np.searchsorted(pairs, shifted)
        after[pairs[np.minimum(after, len(pairs) - 1)] != shifted] = len(pairs)
        here, behind = index[np.searchsorted(pairs, own)], index[after]
        added = (added | equal) & behind
        replaced = replaced & here | equal & ~here
        equal &= here
    q, near = _members(replaced & _rows_where(sizes == least, n_words))
    q1, near1 = _members((added | equal) & _rows_where(sizes == least + 1, n_words))
    return queries[q], near, queries[q1], near1


def _block_pairs(words: list[str], counts: np.ndarray, keys: np.ndarray, least: int) -> pa.RecordBatch | None:
    """(word, near, near_n) of a block of whole keys, in both directions."""
    order = np.unique(keys, return_inverse=True, return_counts=True)
    alone = order[2][order[1]] < 2
    row = np.flatnonzero(~alone)
    if not len(row):
        return None
    found, first = np.unique(np.array([words[i] for i in row], object), return_index=True)
    counts = counts[row[first]]
    sizes = np.array([len(w) for w in found])
    points = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
    letters, number = np.unique(points, return_inverse=True)
    codes = np.full((len(found), least + 1), -1, np.int64)
    start = np.cumsum(sizes) - sizes
    codes[np.repeat(np.arange(len(found)), sizes), np.arange(len(points)) - np.repeat(start, sizes)] = number
    a, b, short, long = near_words(codes, sizes, least, len(letters))
    word, near = np.concatenate([a, short, long]), np.concatenate([b, long, short])
    return pa.RecordBatch.from_arrays(
        [pa.array(found[word], pa.string()), pa.array(found[near], pa.string()), pa.array(counts[near])],
        ["word", "near", "near_n"]) if len(word) else None


def _pairs(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (least, key); a block is cut where the key changes."""
    held: list[pa.RecordBatch] = []

    def blocks(table: pa.Table, last: bool) -> tuple[list[tuple[int, int]], int]:
        least, key = (table.column(c).to_numpy() for c in ("least", "key"))
        change = np.flatnonzero((key[1:] != key[:-1]) | (least[1:] != least[:-1])) + 1
        cuts, start = [], 0
        while True:
            if start >= len(key):
                return cuts, start
            # The next end: the first change of key behind so many rows, or of the length.
            other = start + int(np.searchsorted(least[start:], least[start], "right"))
            full = np.searchsorted(change, start + min(block, max(1, BLOCK_LETTERS // int(least[start]))))
            end = min(other, int(change[full])) if full < len(change) else other
            if end >= len(key) and not last:
                return cuts, start
            cuts.append((start, end))
            start = end

    def compared(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        table = pa.Table.from_batches(held).combine_chunks()
        cuts, done = blocks(table, last)
        words, n, keys, least = (table.column(c) for c in ("word", "n", "key", "least"))
        for start, end in cuts:
            part = slice(start, end)
            out = _block_pairs(words.slice(start, end - start).to_pylist(), n.to_numpy()[part], keys.to_numpy()[part],
                               least[start].as_py())
            if out is not None:
                yield out
        held = table.slice(done).to_batches()

    for batch in batches:
        if len(batch):
            held.append(batch)
            if sum(map(len, held)) >= 2 * block:
                yield from compared(False)
    if held:
        yield from compared(True)


def near_pairs(words: DataFrame, most: int = KEY_WORDS, parts: int = PARTS) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words one error apart. ``words`` is (word, n), a row per word."""
    common.ship(words.sparkSession)
    posted = split_hot(postings(words, parts), most)
    dealt = posted.select("word", "n", "least", "key").repartition("least", "key").sortWithinPartitions("least", "key")
    found = dealt.mapInArrow(lambda batches: _pairs(batches, most), "word string, near string, near_n long")
    return found.dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the last form, by doubling the pointers."""
    step = common.materialise(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = step.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = common.materialise(further, "variant-roots")
        if not further.filter("moved").limit(1).count():
            return further.select("word", "root")
        step = further.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO, most: int = KEY_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n)."""
    best = F.min(F.struct((-F.col("near_n")).alias("fewer"), "near"))
    near = near_pairs(words, most).groupBy("word").agg(F.count("near").alias("n_near"), best.alias("best"))
    common_form = -F.col("best.fewer") >= ratio * F.col("n")
    known = common.materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common_form, F.col("best.near")).alias("form"), F.when(common_form, -F.col("best.fewer")).alias("form_n")),
        "variant-forms")
    last = roots(known.filter(F.col("form").isNotNull()))
    return known.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The whole chain for documents."""
    words = common.materialise(vocabulary(runs(docs)), "variant-words")
    return variants(words)

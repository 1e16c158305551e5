"""Sharding, spelling variants and token alignment against their plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from harborwatch.llm import alignment, interleave, variants

WORDS = "word string, n long"


def test_shards_follow_the_definition(docs, rows):
    want = brute.interleaved([(r[0], r[1], r[3]) for r in rows], 7, 3)
    got = interleave.assign(docs, shards=7, seed=3).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_every_shard_holds_the_mixture(spark):
    rows = [(i, f"text {i}", f"s{0 if i % 3 == 0 else i % 11}") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = interleave.sharded(table, shards=10).collect()
    every = Counter(r.source for r in got)
    per = Counter((r.shard, r.source) for r in got)
    assert set(Counter(r.shard for r in got).values()) == {300}
    assert all(abs(per[k, s] - n / 10) <= 2 for s, n in every.items() for k in range(10))
    other = interleave.sharded(table.repartition(7), shards=10).collect()
    assert sorted(got) == sorted(other)


def test_hot_source_is_dealt_to_many_tasks(spark):
    table = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    rows = interleave._narrow(interleave._numbered(table), "source", 1)
    assert max(r["count"] for r in rows.groupBy("stratum", "slice").count().collect()) < 60


def test_shard_edges(edges, empty, tmp_path):
    got = interleave.sharded(edges, shards=4).collect()
    assert len(got) == 11 and sorted(Counter(r.shard for r in got).values()) == [2, 3, 3, 3]
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    narrow = {(r.doc_id, r.text_crc32): r.size for r in interleave.assign(edges).collect()}
    assert narrow[1, 0] == narrow[2, 0] == 16
    assert interleave.assign(empty).count() == 0 and interleave.sharded(empty).count() == 0
    clashing = edges.withColumns({"shard": F.lit("x"), "slice": F.lit(1), "_shard": F.lit(2), "stratum": F.lit("y")})
    assert interleave.assign(clashing).count() == 11
    named = interleave.sharded(clashing, names=("to", "at"))
    assert named.columns == [*clashing.columns, "to", "at"] and {r.shard for r in named.collect()} == {"x"}
    interleave.write_shards(edges, str(tmp_path / "out"), shards=4)
    back = edges.sparkSession.read.parquet(str(tmp_path / "out"))
    assert sorted((r.shard, r.slot) for r in back.collect()) == sorted((r.shard, r.slot) for r in got)


def test_sharding_runs_no_python(docs):
    plan = interleave._placed(interleave._ranked(interleave._narrow(interleave._numbered(docs), "source", 1)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", text)


def random_words(rng, n, alphabet="abcdé", least=6, most=12):
    found = {"".join(rng.choice(alphabet) for _ in range(rng.randint(least, most))) for _ in range(n)}
    for w in list(found):
        if rng.random() < 0.7:
            i = rng.randrange(len(w) + 1)
            found.add(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + "x" + w[i + 1:]]))
    return {w: rng.choice([2, 3, 25, 40, 500, 9000]) for w in found if w}


@pytest.mark.parametrize("most", [1024, 8])
def test_variants_against_all_pairs(spark, most):
    counts = random_words(random.Random(most), 250) | {"base" + "abcd"[i % 4] + "efgh"[i // 4 % 4] + "ijkl"[i // 16]: i + 2
                                                        for i in range(64)}
    counts |= {"chainaa": 2, "chainab": 20, "chaincb": 200, "xchaincb": 2000}
    got = variants.variants(spark.createDataFrame(list(counts.items()), WORDS), most=most)
    want = brute.variants(counts)
    assert {r.word: (r.form, r.root, r.n_near, r.form_n) for r in got.collect()} == want
    assert any(form and form != root for form, root, _, _ in want.values())


def test_index_recurrence_tells_replaced_from_added():
    words = ["aaaaaaa", "aaaaaab", "aaaaaaaa", "baaaaaaa", "abaaaaab", "aaabaaa", "bbbbbbb"]
    letters, sizes = "ab", np.array([len(w) for w in words])
    codes = np.array([[letters.index(c) for c in w] + [-1] * (8 - len(w)) for w in words])
    q, near, q1, near1 = variants.near_words(codes, sizes, 7, 2)
    same = {(a, b) for a in range(7) for b in range(7) if sizes[a] == sizes[b] == 7 and brute.one_apart(words[a], words[b])}
    more = {(a, b) for a in range(7) for b in range(7) if sizes[a] == 7 and sizes[b] == 8 and brute.one_apart(words[a], words[b])}
    assert set(zip(q, near)) == same and set(zip(q1, near1)) == more and len(q1) == len(more)


def test_words_of_documents(docs, rows, edges, empty):
    texts = [(r[0], r[1]) for r in rows]
    counts = brute.vocabulary(texts)
    got = {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in variants.spelling_variants(docs).collect()}
    want = brute.variants(counts)
    assert got == {w: (n, *want[w]) for w, n in counts.items()}
    from tests.llm.conftest import EDGES
    found = {r.word: r.n for r in variants.vocabulary(variants.runs(edges), 3, 1).collect()}
    assert found == brute.vocabulary([(r[0], r[1]) for r in EDGES], 3, 1)
    assert variants.spelling_variants(empty).count() == 0
    clashing = docs.withColumns({"word": F.lit("x"), "n": F.lit(1), "run": F.lit("y"), "key": F.lit(0), "id": F.lit(1)})
    assert variants.spelling_variants(clashing).count() == len(counts)


def test_very_long_words(spark):
    base = "abcdefghij" * 3000
    words = {base: 50, base[:777] + "z" + base[778:]: 2, base + "q": 3, "short" + base[:40]: 2}
    got = variants.variants(spark.createDataFrame(list(words.items()), WORDS)).collect()
    assert {r.word: (r.form, r.root, r.n_near, r.form_n) for r in got} == brute.variants(words)


def test_hot_keys_are_split(spark):
    # All words begin alike: every one shares keys with thousands.
    words = [("commonprefix" + a + b + c, 2) for a in "abcdefghijkl" for b in "abcdefghijkl" for c in "abcdefghijkl"]
    table = spark.createDataFrame(words, WORDS)
    posted = variants.split_hot(variants.postings(table), 100)
    wide = posted.filter("last - first > 1").groupBy("key").count().agg(F.max("count")).first()[0]
    assert wide <= 100
    got = variants.near_pairs(table, 100).groupBy("word").count().collect()
    assert len(got) == 12**3 and {r["count"] for r in got} == {33}


TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "  two  spaces   and\ttabs\nand lines\n\n", " leading", "trailing ", "   ", "\n",
    "größe über äpfel – naïve façade 漢字 <|endoftext|> end", "emoji 👩‍👩‍👧 flags 🇩🇪", "▁mark inside▁", "a b c 　 d", "x" * 3000,
    "don't can't we'll 12345 $$$ ### </s> <unk> <0x41>", "nul \x00 byte", "é combining ﬁ ligature ① ²", "the the the the cat", None, "",
]


def test_alignment_against_both_libraries(spark, docs, rows):
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + r[0], r[1]) for r in rows]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = alignment.cross_aligned(table).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute.alignment(texts))


def test_alignment_of_random_texts(spark):
    rng = random.Random(8)
    signs = "ab e\n\t  .,'é漢-0▁ Ġ<>|"
    texts = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))) for i in range(400)]
    got = alignment.cross_aligned(spark.createDataFrame(texts, "doc_id long, text string"))
    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(*keep).collect())) == sorted(brute.alignment(texts))


def test_alignment_edges(edges, empty):
    from tests.llm.conftest import EDGES
    got = alignment.cross_aligned(edges.withColumns({"n_a": F.lit("x"), "block": F.lit(1), "links": F.lit(2)}))
    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda row: tuple(str(x) for x in row)
    assert sorted(map(tuple, got.select(*keep).collect()), key=key) == sorted(
        brute.alignment([(r[0], r[1]) for r in EDGES]), key=key)
    assert alignment.cross_aligned(empty).count() == 0
    blank = edges.withColumn("text", F.when(F.col("doc_id") == 2, F.lit("")))
    assert {(r.n_a, r.count_sum, r.groups_sha256) for r in alignment.cross_aligned(blank).collect()} == {(0, 0, "")}

"""Operators on documents against plain versions, edge cases and empty tables."""

import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harborwatch.llm import balance, common, components, language, line_runs, near_dedup, packing, pu_quality, repetition
from tests.llm import brute
from tests.llm.conftest import DOCS, EDGES


def test_repetition_equals_plain_counts(docs, edges):
    for frame in (docs, edges):
        texts = [r[0] for r in frame.select("text").collect()]
        got = [r.asDict() for r in repetition.repetition(frame).collect()]
        assert len(got) == len(texts)
        for text, row in zip(texts, got):
            for name, value in brute.repetition(text).items():
                assert row[name] == value, (name, text[:60] if text else text)
            assert row["kept"] <= (not row["base_failed"])


def test_repetition_drops_copied_passages(spark):
    plain = " ".join(f"w{i}" for i in range(400))
    looped = " ".join(f"w{i % 60}" for i in range(400))
    rows = [(1, plain), (2, looped), (3, plain + "\n" + " ".join(f"w{i}" for i in range(100, 160)))]
    got = dict(repetition.repetition(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "kept").collect())
    assert got == {1: True, 2: False, 3: False}


def test_shared_lines_equal_plain_version(docs, rows):
    got = line_runs.drop_shared(docs)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "text", "n_lines", "n_dropped"]
    want = brute.shared_lines([(r[0], r[1]) for r in rows])
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()} == want
    assert sum(w[1] for w in want.values()) > 10


def test_shared_lines_edges(edges, empty):
    got = line_runs.drop_shared(edges, min_docs=2).collect()
    assert len(got) == len(EDGES)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[1]["text"] == "" and by_id[1]["n_lines"] == 1
    assert by_id[4]["n_dropped"] == 3 and by_id[5]["n_dropped"] == 1 and by_id[6]["n_dropped"] == 0
    assert line_runs.drop_shared(empty).count() == 0


def test_drops_are_gathered_by_text(spark, monkeypatch):
    """However many rows have no id or the same one, a list of drops has the lines of one text at most."""
    line = "this is line number {} of the shared ones".format
    rows = [(None if i % 2 else 7, f"{line(2 * i)}\nown {i}\n{line(2 * i + 1)}") for i in range(40)]
    rows += [(100 + k, "\n".join(line(j) for j in range(80))) for k in range(3)]
    seen = []
    without = line_runs._without
    monkeypatch.setattr(line_runs, "_without", lambda docs, drops, *rest: seen.append(drops) or without(docs, drops, *rest))
    got = line_runs.drop_shared(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["text"] for r in got if r["doc_id"] in (None, 7)) == sorted(f"own {i}" for i in range(40))
    assert {r["doc_id"]: r["n_dropped"] for r in got if (r["doc_id"] or 0) >= 100} == {100: 80, 101: 80, 102: 0}
    lists = seen[0].groupBy([c for c in seen[0].columns if c != "key"]).count().filter("doc < 100").collect()
    assert [r["count"] for r in lists] == [2] * 40


def test_runs_are_compacted_and_drop_seen_lines(spark):
    store = line_runs.LineRuns(spark, fan_in=3)
    seen = set()
    for b in range(7):
        lines = [f"this is line number {(b * 3 + j) % 12} of them all" for j in range(5)]
        batch = spark.createDataFrame([(b * 10 + 1, "\n".join(lines))], "doc_id long, text string")
        left = line_runs.drop_seen(batch, store).first()["text"]
        assert left == "\n".join(x for x in lines if x not in seen)
        seen |= set(lines)
        assert all(len(level) < 3 for level in store.levels)
    assert len(store.levels) == 2 and store.totals().count() == len(seen)


def test_near_copies_equal_plain_version(docs, rows):
    for size, percent in ((3, 85), (5, 80)):
        want = brute.near_copies([(r[0], r[1]) for r in rows], size, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_copies(docs, size, percent).collect()}
        assert got == want
    assert sum(d != c for d, (_, c) in want.items()) > 10


def test_large_group_of_near_copies_is_one_component(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.integers(0, 150, 4):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    want = brute.near_copies(rows, 3, 85)
    got = near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_blocks_find_what_rounds_leave(spark, monkeypatch):
    """All pairs of different groups meet, however small the blocks."""
    monkeypatch.setattr(near_dedup, "LIST_BLOCK", 3)
    rows = [(i, " ".join(f"w{j}" if j % 10 != i % 10 else f"y{i}" for j in range(300))) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    known = near_dedup.features(frame, 1)
    lists = known.select(F.lit(1).cast("long").alias("token"), F.col("doc_id").alias("node"), F.col("doc_id").alias("label"), "sign")
    sign = {r["node"]: np.frombuffer(r["sign"], np.uint32) for r in lists.collect()}
    of = {a: a for a in sign}
    for a in sign:
        for b in sign:
            if a < b and (sign[a] == sign[b]).sum() >= 30 and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {k: low if v == high else v for k, v in of.items()}
    got = components.components(near_dedup.remaining_collisions(lists, 30)).collect()
    assert {k: v for k, v in of.items() if list(of.values()).count(v) > 1} == {r["node"]: r["component"] for r in got} and got


def test_large_family_is_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TEXT_BLOCK", 8)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        words = [f"w{j}" for j in range(120)]
        for at in rng.integers(0, 120, 2 + i % 3):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    members = spark.createDataFrame([(i, 0, t) for i, t in rows], "node long, family long, text string")
    got = {r["node"]: r["component"] for r in near_dedup.links_within(members, 3, 80).collect()}
    want = {d: c for d, (_, c) in brute.near_copies(rows, 3, 80).items()}
    assert {d: got.get(d, d) for d, _ in rows} == want and len(set(want.values())) not in (1, 60)


def test_repeated_rows_are_one_text_of_their_family(spark, monkeypatch):
    words = [f"w{j}" for j in range(100)]
    rows = [(1, " ".join(words))] * 50 + [(2, " ".join(words[:98] + ["x", "y"]))] * 30 + [(3, "a b c d e f g")] * 5
    seen = []
    within = near_dedup.links_within
    monkeypatch.setattr(near_dedup, "links_within", lambda members, *rest: seen.append(members) or within(members, *rest))
    got = near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1)] * 50 + [(2, 1)] * 30 + [(3, 3)] * 5
    assert sorted(r["node"] for r in seen[0].collect()) == [1, 2]


def test_texts_of_one_id_are_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TEXT_BLOCK", 8)
    blocks = []
    placed = near_dedup.in_blocks
    monkeypatch.setattr(near_dedup, "in_blocks", lambda *given: blocks.append(placed(*given)) or blocks[-1])
    words = [f"w{j}" for j in range(100)]
    rows = [(1 if i < 90 else i, 0, " ".join(words[:99] + [f"x{i}"])) for i in range(100)]
    members = spark.createDataFrame(rows, "node long, family long, text string")
    got = {r["node"]: r["component"] for r in near_dedup.links_within(members, 5, 80).collect()}
    assert got == {n: 1 for n in (1, *range(90, 100))}
    sizes = blocks[0].groupBy("family", "kind", "i", "j").count().collect()
    assert max(r["count"] for r in sizes) <= 40


def test_batch_meets_sorted_runs_without_moving_them(spark):
    store = line_runs.LineRuns(spark, buckets=4)
    for b in range(3):
        texts = [(b * 100 + i, f"this is line number {b * 7 + i} of them all\nand the line that comes every time") for i in range(9)]
        batch = line_runs.postings(spark.createDataFrame(texts, "doc_id long, text string"))
        if b == 2:
            plan = store.unseen(line_runs._counts(batch))._jdf.queryExecution()
            sides = [part.split("Scan parquet")[0] for part in plan.executedPlan().toString().split("LeftAnti")[1:]]
            assert len(sides) == 2 and plan.executedPlan().toString().count("SortMergeJoin") == 2
            scans = plan.executedPlan().toString().split("\n")
            at = [i for i, line in enumerate(scans) if "Scan parquet spark_catalog" in line]
            for i in at:  # nothing but columns and filters between a run and its join
                above = next(line for line in reversed(scans[:i]) if not any(w in line for w in ("ColumnarToRow", "Filter", "Project")))
                assert "Exchange" not in above
        store.add(batch)
    got = {(r.n_docs, r.max_doc, r.n_rows) for r in store.totals(10).collect()}
    assert got == {(27, 208, 27)} and sum(run.count() for run in store.runs()) == store.totals().count()
    everywhere = store.totals().groupBy("key").count().filter("count > 1").count()
    assert everywhere == 0
    store.close()


def test_unlike_texts_of_one_id_stay(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(7, "alpha beta gamma delta epsilon zeta eta"), (7, "quite another text with words of its own here"), (7, words),
            (3, words + " more"), (9, words), (None, words), (None, words), (7, "alpha beta gamma delta epsilon zeta eta"), (5, "")]
    got = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(map(tuple, got), key=key) == sorted([rows[0], rows[1], rows[3], rows[5], rows[6], rows[8]], key=key)


def test_near_copies_edges(edges, empty):
    got = near_dedup.near_copies(edges).collect()
    assert len(got) == len(EDGES)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] in (2, 3, 4, 5, 6)} == {2: 2, 3: 3, 4: 4, 5: 5, 6: 5}
    left = near_dedup.drop_near_copies(edges)
    assert left.columns == edges.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((-9, 1, 2, 3, 4, 5, 7, 8, None), key=str)
    assert near_dedup.near_copies(empty).count() == 0


def test_missed_links_are_rare():
    m = near_dedup.least_matches(85)
    from math import comb
    assert sum(comb(40, k) * 0.85**k * 0.15 ** (40 - k) for k in range(m)) <= 1e-6


def test_targets_and_mix(docs, rows, spark):
    got = balance.copies(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    size, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    want = brute.targets({s: size[s] for s in sorted(size)})
    for s in size:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - target[s]) <= largest[s]
    again = {r["doc_id"]: r["copies"] for r in balance.copies(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}
    mixed = balance.mix(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {d: c for d, c in again.items() if c}


def test_targets_stop_at_three_times(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 1, "e": 500}
    frame = spark.createDataFrame([("0" + s, n, 1) for s, n in sizes.items()], "key string, source_size long, docs long")
    got = {r["key"][1:]: r["target"] for r in balance.targets(frame).collect()}
    assert got == pytest.approx(brute.targets(sizes))
    assert got["a"] == 30 and got["d"] == 3


def test_mix_edges(edges, empty):
    got = balance.copies(edges).collect()
    assert len(got) == len(EDGES)
    assert all(r["copies"] == 1 for r in got if r["size"] == 0)
    assert balance.copies(empty).count() == 0 and balance.mix(empty).count() == 0
    assert balance.mix(edges).filter("doc_id is null").count() <= 3


def test_mix_decides_row_by_row(spark):
    """Rows without an id or with a repeated one meet the targets like all others."""
    rows = [(None if i % 3 == 0 else i % 40, " ".join(["w"] * (1 + i % 7)), "en", f"s{min(i % 10, 2)}", i) for i in range(600)]
    frame = spark.createDataFrame(rows, DOCS)
    mixed = balance.mix(frame).withColumn("size", balance.text_size())
    assert mixed.drop("size").subtract(frame).count() == 0
    often = [r["count"] for r in mixed.groupBy("n_chars").count().collect()]
    assert max(often) <= 3 and len(often) < len(rows)
    size = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in ("s0", "s1", "s2")}
    taken = {r["source"]: r["taken"] for r in mixed.groupBy("source").agg(F.sum("size").alias("taken")).collect()}
    want = brute.targets(size)
    assert all(abs(taken[s] - want[s]) <= 7 for s in size), (taken, want)


def test_mix_runs_no_python(docs):
    for frame in (balance.copies(docs), balance.mix(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_language(docs, edges, empty, rows):
    got = {r["doc_id"]: r for r in language.learn_and_identify(docs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] < 100]
    assert len(held) > 10
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert all(got[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    few = {r["doc_id"]: r for r in language.learn_and_identify(edges).collect()}
    assert [few[i]["lang_pred"] for i in (1, 2, 3, -9)] == ["und"] * 4 and few[1]["score"] == 0
    assert language.learn_and_identify(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, []).collect()} == {"und"}


def test_language_distance_by_hand():
    row, gram, count, has = language.grams(["abab", None, "12"])
    a, b, edge = (language.letter_codes()[ord(c)] for c in "ab ")
    assert has.tolist() == [True, False, False] and edge == 0
    counts = {g: c for r, g, c in zip(row, gram, count) if r == 0}
    one, pair = {int(a): 2, int(b): 2}, {int(a << 10 | b): 2, int(b << 10 | a): 1}
    assert {g: c for g, c in counts.items() if g < 1024} == one
    assert {g: c for g, c in counts.items() if 2048 <= g < 1 << 20 and g & 1023 > 1} == pair
    top = language.ranked(row, gram, count, 3)
    assert top[2].tolist() == [0, 1, 2]


def test_quality(spark, docs, edges, empty, rows):
    labels = spark.createDataFrame(
        [(r[0], int(r[0] < 130), 0) for r in rows if r[0] % 2 or r[0] >= 130], "doc_id long, quality int, toxic int")
    model = pu_quality.learn(docs, labels)
    got = {r["doc_id"]: r for r in pu_quality.score(docs, model).collect()}
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = [got[r[0]]["predicted"] == int(r[0] < 130) for r in held]
    assert sum(right) >= 0.9 * len(held)
    left = pu_quality.accept(docs, labels)
    assert left.columns == docs.columns and left.count() >= 110
    assert pu_quality.score(edges, model).count() == len(EDGES)
    none = pu_quality.learn(docs, labels.limit(0))
    assert none is None and {r["score"] for r in pu_quality.score(edges, none).collect()} == {0.5}
    assert pu_quality.score(empty, model).count() == 0


def test_quality_without_positives_and_with_repeated_rows(spark, docs, rows, monkeypatch):
    labels = [(r[0], int(r[0] < 130), 0) for r in rows if r[0] % 2 or r[0] >= 130]
    schema = "doc_id long, quality int, toxic int"
    strangers = spark.createDataFrame([(10_000 + i, 1, 0) for i in range(50)], schema)
    assert pu_quality.learn(docs, strangers) is None
    assert pu_quality.accept(docs, strangers).count() == len(rows)
    known = spark.createDataFrame(labels, schema)
    # A draw of few positives takes them from the documents, not from marks without one.
    assert pu_quality.learn(docs, known.union(strangers), positives=3) is not None
    # All rows three times: the same means, hence the same scores.
    once, thrice = pu_quality.learn(docs, known), pu_quality.learn(docs.union(docs).union(docs), known)
    assert np.allclose(once[1], thrice[1], atol=1e-6)


def _plain_risk(w, positive, unlabelled, prior):
    """The non-negative risk as it is written, and its second term."""
    loss = lambda g: np.log1p(np.exp(-g))
    term = loss(-unlabelled @ w).mean() - prior * loss(-positive @ w).mean()
    return prior * loss(positive @ w).mean() + max(0, term) + pu_quality.PENALTY / 2 * (w[:-1] ** 2).sum(), term


def _memory_terms(u):
    return lambda w: tuple(x / len(u) for x in pu_quality.softplus_sums(u, w, np.ones(len(u))))


def test_non_negative_risk_separates_without_negatives():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (3000, 4)), rng.normal(-1, 1, (600, 4))
    mixed = np.concatenate([good[1000:], bad])
    scale = mixed.mean(axis=0), mixed.std(axis=0)
    p, u = pu_quality.standard(good[:1000], scale), pu_quality.standard(mixed, scale)
    w = pu_quality.fit(_memory_terms(u), p, np.full(1000, 1e-3), 2000 / 2600)
    z = lambda x: pu_quality.standard(x, scale) @ w
    assert (z(good) > 0).mean() > 0.95 and (z(bad) < 0).mean() > 0.8
    least, term = _plain_risk(w, p, u, 2000 / 2600)
    assert term >= 0
    for _ in range(200):
        assert _plain_risk(w + rng.normal(0, 0.05, len(w)), p, u, 2000 / 2600)[0] >= least - 1e-9


def test_risk_of_few_positives_stays_non_negative():
    rng = np.random.default_rng(2)
    p, u = (np.column_stack([rng.normal(0, 1, (n, 60)), np.ones(n)]) for n in (30, 400))
    share = np.full(30, 1 / 30)
    free, free_term = pu_quality._newton(_memory_terms(u), p, share, 0.9, 1.0, np.zeros(61))
    w = pu_quality.fit(_memory_terms(u), p, share, 0.9)
    risk, term = _plain_risk(w, p, u, 0.9)
    assert free_term < 0 <= term and risk < _plain_risk(free, p, u, 0.9)[0] + 1e-9


def test_sums_of_tasks_equal_plain_sums(spark, docs, rows):
    texts = docs.repartition(7).select(F.lit(None).cast("double").alias("weight"), "text")
    features = texts.mapInArrow(pu_quality._describe_batches, "weight double, x binary")
    chunk, = common.text_chunks(pa.array([r[1] for r in rows]), 1 << 30)
    x = pu_quality.describe(chunk)
    scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    w = np.random.default_rng(3).normal(0, 0.1, pu_quality.WIDTH + 1)
    got = pu_quality._unlabelled_terms(features, scale, len(rows))(w)
    for mine, plain in zip(got, _memory_terms(pu_quality.standard(x, scale))(w)):
        assert np.allclose(mine, plain, rtol=1e-9, atol=1e-12)


def test_packing(docs, edges, empty):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    for frame in (docs, edges):
        pieces = packing.pack(frame).collect()
        assert len({p["sequence_id"] for p in pieces}) == len(pieces)
        runs, current = [], []
        for p in sorted(pieces, key=lambda p: (p["sequence_id"] >> 32 & 0xFFFFFF, p["doc_id"] or 0, p["start"])):
            current.append(p)
        by_doc = defaultdict(list)
        for p in current:
            by_doc[p["doc_id"]].append(p)
            length = p["length"]
            assert length & (length - 1) == 0 and length <= 1024 and p["offset"] == 0
            assert p["ids_crc32"] == zlib.crc32(p["ids"]) and len(p["ids"]) == 4 * length
            assert p["bucket"] == length.bit_length() - 1 == p["sequence_id"] >> 56
        for r in frame.dropDuplicates(["doc_id"]).collect():
            ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
            mine = {p["start"]: p for p in by_doc[r["doc_id"]]}
            joined = b"".join(mine[s]["ids"] for s in sorted(mine))
            assert np.frombuffer(joined, "<u4").tolist() == ids
            assert all(p["doc_tokens"] == len(ids) for p in mine.values())
    assert packing.pack(empty).count() == 0


def test_both_readers_of_the_vocabulary_agree():
    path = public_tokenizers.path
    encode = packing.encoder(path(packing.VOCABULARY), path(packing.RANKS))
    tokenizer = Tokenizer.from_file(path(packing.VOCABULARY))
    texts = [f"a1{chr(c)}{chr(c)} b {chr(c)}c\n {chr(c)}" for c in range(0x20, 0x3400) if not 0xD800 <= c < 0xE000]
    texts += ["", " ", "\n\n", "a  b   c\n\n d \n", "don't we'll I'M", "  lead", "trail  ", "x\t y", "x<|endoftext|> y"]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_holds_a_bounded_piece_of_the_ids(spark, monkeypatch):
    """Pieces of a long document leave in small batches, and the memory of units forgets those not met lately."""
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda _: 0})())}))
    files = public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS)
    text = " ".join(f"w{i}" for i in range(400_000))
    given = pa.record_batch([pa.array([1, 2]), pa.array([text, "short"])], ["doc_id", "text"])
    out = list(packing._pack([given], files, packing.MAX_LENGTH, True))
    assert max(b.nbytes for b in out) < 1.5 * packing.OUT_BYTES and len(out) > 3
    ids = packing.encoder(*files)(text) + b"\0\0\0\0"
    rows = [r for b in out for r in b.to_pylist()]
    assert b"".join(r["ids"] for r in rows if r["doc_id"] == 1) == ids and rows[-1]["doc_id"] == 2
    monkeypatch.setattr(packing, "MEMO_UNITS", 100)
    asked = []
    memo = packing._Memo(lambda unit: asked.append(unit) or [len(asked)])
    for i in range(1000):
        assert memo["often"] == memo["often"] and memo[f"u{i}"]
        assert len(memo) + len(memo.older) <= 101
    assert asked.count("often") == 1


def test_clashing_column_names(spark):
    rows = [(1, "one two three four five six", "en", "s", 5, 1, 2, 3, "k")]
    names = ("doc_id long, text string, lang string, source string, n_chars long, label int, size int, score int, n_lines string")
    frame = spark.createDataFrame(rows, names)
    assert near_dedup.drop_near_copies(frame).collect() == frame.collect()
    assert balance.mix(frame).distinct().collect() == frame.collect()
    kept = line_runs.drop_shared(frame, counts=("_a", "_b"))
    assert kept.select(*frame.columns).collect() == frame.collect()
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert pu_quality.accept(frame, labels).count() <= 1


def test_stages_hold_a_bounded_piece_of_the_texts(spark, rows):
    """However long the texts of a task are: batches of a few MB, and arrays of a small piece of them."""
    near_dedup.features(spark.createDataFrame(rows, DOCS), 5)
    long = spark.range(0, 24, 1, 1).select(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" words")), 1 << 17).alias("text"))
    sizes = [r["n"] for r in long.mapInArrow(
        lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()]
    assert sum(sizes) > 4 * common.BATCH_BYTES and max(sizes) < 1.5 * common.BATCH_BYTES
    texts = pa.array([" ".join(f"w{(i * k) % 5003}" for i in range(300)) for k in range(2000)])
    ids = pa.array(range(len(texts)), pa.int64())
    for run in (lambda: near_dedup._features([pa.record_batch([ids, ids, texts], ["d", "h", "t"])], 5),
                lambda: pu_quality._describe_batches([pa.record_batch([ids, texts], ["w", "t"])])):
        tracemalloc.start()
        assert sum(b.num_rows for b in run()) == len(texts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 100 * common.SMALL_CHUNK_BYTES

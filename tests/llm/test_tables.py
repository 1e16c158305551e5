"""Search, extraction and audit, the registered queries, and the pipeline stage by stage."""

import gzip
import math
import random
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from harborwatch.llm import components, dom, fixity, html_text, near_dedup, threshold_search
from tests.llm import brute
from tests.llm.conftest import DOCS, EDGES

SF = "/root/testdata/sf0.001"


def test_search_equals_plain_version(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 12)], 0) for i in range(300)]
    rows += [(300 + i, rows[7][1], 0) for i in range(30)] + [(400, [0.0] * 12, 0), (450, None, 0), (500, [], 0)]
    rows += [(550, [1.0, None], 0), (600, [math.nan] * 12, 0), (601, [math.inf] + [0.0] * 11, 0), (None, [1.0] * 12, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {i: [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (12 - len(v))
            for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    got = sorted(tuple(r) for r in threshold_search.search(frame).collect())
    assert got == brute.top(good, 5, 50)


def test_search_stops_early_where_the_bound_allows():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 5, (4000, 3)).astype(float)
    rows[17] = 1000
    ids = np.arange(4000)
    lists = np.argsort(rows, axis=0, kind="stable").T
    ends = np.take_along_axis(rows.T, lists, axis=1)
    found, score = threshold_search.walk(np.array([1.0, 1.0, 1.0]), ids < 0, ids, rows, lists, ends, 1)
    assert found.tolist() == [17] and score.tolist() == [3000]


def test_search_empty_and_few(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert threshold_search.search(spark.createDataFrame([], kind)).count() == 0
    two = spark.createDataFrame([(0, [1.0], 0), (3, [2.0], 1)], kind)
    assert [tuple(r) for r in threshold_search.search(two).collect()] == [(0, 1, 3, 512 * 256)]


def test_search_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0]), (3, [0.5]), (3, [0.25]), (50, [1.0]), (50, [2.0])]
    got = sorted(map(tuple, threshold_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    want = []
    for i, (q, x) in enumerate(rows):
        if q % 50 == 0:
            found = sorted((-int(256 * x[0]) * int(256 * y[0]), v) for j, (v, y) in enumerate(rows) if j != i)[:5]
            want += [(q, r + 1, v, -s) for r, (s, v) in enumerate(found)]
    assert got == sorted(want) and len(got) == 12


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav>
<div class="cookie-notice"><p>We keep crumbs here, and you may agree or not agree with that.</p><button>OK</button></div>
<div class="content"><h1>A title &amp; more</h1><p>First sentence of the   text, with&nbsp;words.<p>Second one, a bit longer, and it has
a line break; it goes on and on.<br>After it.</p><ul><li>item one of the list</li><li>item two of the list</li></ul></div>
<aside class="sidebar"><h3>Related</h3><p>Side text that nobody wants to see in the result, though it is long.</p></aside>
<section class="comments"><div class="comment"><p>I liked this text a lot, thanks for writing all of it.</p></div></section>
<footer>&copy; somebody, all rights kept.</footer></body></html>"""


@pytest.mark.parametrize("name", ["object", "canvas", "svg", "template", "noscript", "iframe"])
def test_unclosed_elements_do_not_swallow_the_page(name):
    page = dom.parse(f"<body><p>before it</p><{name} class=x><p>after it</p><{name}><div>and more</div></body>")
    assert [t for t in page.text if t] == ["before it", "after it", "and more"]
    closed = dom.parse(f"<body><{name}><p>inside</p></{name}><p>after it</p><{name}>no end")
    assert [t for t in closed.text if t] == ["after it", "no end"]


def test_deep_nesting_is_linear():
    def seconds(n):
        source = "<div><ul><li>" * n + "text" + "<p>x</span></b>" * n + "</div>" * n
        best = 9.0
        for _ in range(3):
            begin = time.process_time()
            page = dom.parse(source)
            best = min(best, time.process_time() - begin)
        assert max(page.depth) >= 3 * n
        return best

    seconds(500)
    assert seconds(16_000) < 20 * seconds(2_000)


@pytest.fixture(scope="session")
def forest(spark):
    return html_text.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_main_text_of_an_unseen_layout(forest):
    assert html_text.extract([PAGE], forest) == [
        "A title & more\n\nFirst sentence of the text, with words.\n\nSecond one, a bit longer, and it has a line break; it "
        "goes on and on. After it.\n\nitem one of the list\n\nitem two of the list"]


def test_drawn_layouts_held_out(forest, spark):
    pages = [dom.parse(r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    layout = html_text._Layout([[p.text[i] for i in html_text._articles(p)] for p in pages], [], seed=77)
    right = wrong = missed = 0
    for _ in range(150):
        page = dom.parse(layout.page())
        want = {i for i, t in enumerate(page.text) if html_text.MARK in t}
        page.text = [t.replace(html_text.MARK, "") for t in page.text]
        got = set(html_text.choose(page, html_text.boosting.predict(forest, dom.features([page]))))
        chars = lambda nodes: sum(len(page.text[i]) for i in nodes)
        right, wrong, missed = right + chars(want & got), wrong + chars(got - want), missed + chars(want - got)
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.93


def test_choice_is_hierarchical(forest):
    page = dom.parse(PAGE)
    kept = set(html_text.choose(page, np.where(np.asarray(page.tag) == dom.TEXT_TAG, 1.0, -50.0)))
    assert kept == set()  # no text under dropped ancestors, however sure
    assert len(html_text.choose(page, np.ones(len(page.parent)))) == sum(t == dom.TEXT_TAG for t in page.tag)


def test_extraction_edges(spark, forest):
    odd = ["", "<", "a < b & c", "<p", "<p>x", "<b><i></p></b></div>", "<!-- open", "<script>never closed", "<p>cut &am",
           "<div " + 'a="' * 50, "<div>" * 3000 + "deep" + "</div>" * 10, "\x00<p>�</p>"]
    rows = [(i, None if i % 2 else f"http://x/{i}", h) for i, h in enumerate(odd)] + [(None, None, None), (3, "u", "<p>x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for model in (forest, None):
        got = html_text.main_text(frame, model).collect()
        assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.fit(frame.limit(0)) is None
    assert html_text.main_text(frame.limit(0), None).count() == 0


def test_audit_finds_every_damage(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").unionByName(
        spark.createDataFrame([(None, None, None), (7, "u", "")], "page_id long, url string, html string"))
    segments = fixity.write_segments(pages, segment_bytes=20_000)
    replica = fixity.damaged_copy(segments, flip_every=9, cut_every=4)
    height = fixity.height_of(segments)
    trees = [fixity.tree(s, height) for s in (segments, replica)]
    got = fixity.located(segments, fixity.audit(*trees)).collect()
    assert len(got) == pages.count()
    last = {}
    for r in got:
        last[r["segment"]] = max(last.get(r["segment"], 0), r["record_no"])
    for r in got:
        flipped = r["page_id"] is not None and r["page_id"] % 9 == 0
        assert r["damaged"] == (flipped or (r["segment"] % 4 == 3 and r["record_no"] == last[r["segment"]]))
    assert fixity.audit(trees[0], fixity.tree(segments, height)).count() == 0
    # A replica without one of its segments: all its records are reported.
    lost = segments.agg({"segment": "max"}).first()[0]
    part = fixity.located(segments, fixity.audit(trees[0], fixity.tree(segments.filter(f"segment <> {lost}"), height)))
    assert {r["segment"] for r in part.filter("damaged").collect()} == {lost}
    assert part.filter(f"segment = {lost} and not damaged").count() == 0
    nothing = fixity.write_segments(pages.limit(0))
    assert fixity.audit(fixity.tree(nothing, 1), fixity.tree(nothing, 1)).count() == 0


def _audited(first, second):
    height = fixity.height_of(first)
    found = fixity.audit(fixity.tree(first, height), fixity.tree(fixity.with_manifest(second, first), height))
    return sorted(map(tuple, found.collect()))


def test_bytes_outside_records_are_found(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>text</p>" * i) for i in range(40)], "page_id long, url string, html string")
    segments = fixity.write_segments(pages.coalesce(1), segment_bytes=4000)
    n = {r["segment"]: len(r["ranges"]) for r in segments.collect()}
    longer = segments.withColumn("data", F.concat("data", F.lit(b"tail")))
    assert _audited(segments, longer) == sorted(n.items())
    assert _audited(segments, segments) == []
    extra = segments.unionByName(segments.limit(1).withColumn("segment", F.lit(max(n) + 1).cast("long")))
    assert _audited(segments, extra) == [(max(n) + 1, 0)]


def test_damaged_files_are_differences(spark):
    one, two = (tempfile.mkdtemp(prefix="run-") for _ in range(2))
    whole = [fixity.record(i, f"http://x/{i}", f"<p>{i}</p>" * 9) for i in range(6)]
    damaged = {"cut": b"".join(whole)[:-len(whole[5]) - 300], "header": b"".join(whole)[: len(whole[0]) + 20],
               "gzip": gzip.compress(b"".join(whole)), "length": b"".join(whole).replace(b"Content-Length: 7", b"Content-Length: x"),
               "same": b"".join(whole), "empty": b""}
    for name, data in damaged.items():
        for folder, content in ((one, b"".join(whole)), (two, data)):
            with open(f"{folder}/{name}.warc", "wb") as out:
                out.write(content)
    first, second = fixity.read_files(spark, one), fixity.read_files(spark, two)
    assert second.count() >= 5
    bad = {s for s, _ in _audited(first, second)}
    names = {r["segment"] for r in first.collect()}
    assert len(names) == 6 and len(bad) == 5
    ranges = {n: fixity.record_ranges(d) for n, d in damaged.items()}
    for name, found in ranges.items():
        assert sum(r["length"] for r in found) == len(damaged[name])
        assert [r["offset"] for r in found] == [sum(x["length"] for x in found[:i]) for i in range(len(found))]
    assert len(ranges["same"]) == 6 and len(ranges["gzip"]) == 1 and ranges["empty"] == []


def test_warc_files_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    records = [fixity.record(i, f"http://x/{i}", f"<p>{i}</p>" * i) for i in range(5)]
    for name in ("one", "two"):
        with open(f"{folder}/{name}.warc", "wb") as out:
            out.write(b"".join(records))
    read = fixity.read_files(spark, folder).collect()
    assert len(read) == 2
    for segment in read:
        assert [segment["data"][r["offset"]: r["offset"] + r["length"]] for r in segment["ranges"]] == records


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 150)]
    got = dict(components.components(spark.createDataFrame(links, "u long, v long")).collect())
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {200: 100}


def test_components_of_many_blocks(spark, monkeypatch):
    """Local forests and star steps together give the components, also of long paths, hubs and repeated links."""
    monkeypatch.setattr(components, "LINK_BLOCK", 24)
    rng = random.Random(11)
    links = [(i, i + 1) for i in range(500, 620)] + [(1000, k) for k in range(1001, 1060)] + [(3, 1059), (620, 2), (2, 2)]
    links += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    links = [link if rng.random() < 0.5 else link[::-1] for link in links * 2]
    rng.shuffle(links)
    of = {n: n for link in links for n in link}
    for a, b in links:
        low, high = sorted((of[a], of[b]))
        of = {n: low if c == high else c for n, c in of.items()}
    alone = {n for n in of if list(of.values()).count(of[n]) == 1}
    got = components.components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()
    assert len(got) == len(set(got)) and dict(got) == {n: c for n, c in of.items() if n not in alone}
    half = components.components(spark.createDataFrame(links[::2], "u long, v long"))
    assert set(components.components(spark.createDataFrame(links[1::2], "u long, v long"), half).collect()) == set(got)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_few_links_take_few_steps(spark, monkeypatch):
    written = []
    kept = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: written.append(name) or kept(df, name))
    links = [(i, i + 1) for i in range(300)]
    assert dict(components.components(spark.createDataFrame(links, "u long, v long")).collect()) == {i: 0 for i in range(301)}
    assert len(written) <= 3


def test_pipeline_stage_by_stage(spark, docs, edges, empty):
    labels = f"{SF}"
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), edges, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, labels)
            assert out.columns == frame.columns and out.schema.simpleString() == frame.schema.simpleString(), name
            assert out.count() <= 3 * frame.count()


def test_pipeline_against_plain_versions(spark, rows):
    frame = spark.createDataFrame(rows, DOCS)
    lines = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, frame, SF).collect()}
    assert lines == {d: t for d, (_, _, t) in brute.shared_lines([(r[0], r[1]) for r in rows]).items()}
    near = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, frame, SF).collect()}
    assert near == {d for d, (_, c) in brute.near_copies([(r[0], r[1]) for r in rows], 5, 80).items() if d == c}
    packed = corpus_pipeline.pack(spark, frame, SF).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert len(packed) == len(rows) and all(r[1] == r[2] for r in packed)


def test_registered_queries_cover_whole_tables(spark):
    queries = __spark_entry__.queries()
    for name, table in (("op1_repetition", "documents"), ("op2_html_text", "pages"), ("op8_language", "documents"),
                        ("op9_line_runs", "documents"), ("op7_balance", "documents"), ("op6_fixity", "pages")):
        assert queries[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count(), name
    assert {n.split("_")[0] for n in queries if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in queries
    assert len(EDGES) > 10 and near_dedup.least_matches(80) > 0

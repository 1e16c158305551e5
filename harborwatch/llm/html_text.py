"""Main text of web pages: boosted trees over DOM nodes and a hierarchical choice.

Every block-level element and every block of text is a node with features: size and density of its subtree, share of
links, depth, place among and sizes of its siblings, kind of element, and what the words of its class, id and role
announce, for itself, its ancestors and its descendants. Boosted trees give each node the log-odds z that main text lies
in it. The choice keeps a node only if its parent is kept: a subtree is worth z plus what its worthwhile children are
worth, and goes as a whole where that is not above zero. So no block is kept under a dropped ancestor, nor an element
kept without content.

The trees are fitted on a bounded sample (``SAMPLE`` pages with the least hash of their id, of at most ``SAMPLE_CHARS``
characters each). Their articles are those that the pages themselves mark with ``article`` or ``main``; the sampled blocks
are also set anew into drawn layouts (other containers, side columns, notices, forms, comments, adverts; with and without
telling names), so that the trees do not rest on one site's template. Extraction reads every page whole and shuffles
nothing. Sampled pages without any text give no trees; then everything outside unread elements is kept.

Null or empty html: empty text. Truncated markup, unclosed elements and stray end tags are tolerated. Rows that repeat
get equal results; null ids and urls pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.llm import boosting, common, dom

SAMPLE = 300
SAMPLE_CHARS = 60_000
DRAWN = 700
#: Nodes whose features are made at once.
NODES = 20_000
#: Marks main text in drawn pages; of the private use area.
MARK = "\ue000"

RESULT = "page_id long, url string, text string, n_chars long"


def choose(page: dom.Page, odds: np.ndarray) -> list[int]:
    """Text nodes kept by the hierarchical choice."""
    n = len(page.parent)
    worth = odds.tolist()
    worth[0] = 0.0
    for i in range(n - 1, 0, -1):
        if worth[i] > 0:
            worth[page.parent[i]] += worth[i]
    kept = [False] * n
    kept[0] = True
    for i in range(1, n):
        kept[i] = worth[i] > 0 and kept[page.parent[i]]
    return [i for i in range(n) if kept[i] and page.tag[i] == dom.TEXT_TAG]


def _articles(page: dom.Page) -> list[int]:
    """Text nodes in what a page marks as its article, outside anything that announces something else."""
    inside, found = {-1: False}, []
    for i, parent in enumerate(page.parent):
        inside[i] = inside[parent] or page.name[i] in ("article", "main")
        if page.tag[i] == dom.TEXT_TAG and inside[i] and not page.inherited[i] >> 1:
            found.append(i)
    return found


class _Layout:
    """Draws pages from sampled blocks of text."""

    def __init__(self, mains: list[list[str]], others: list[str], seed: int) -> None:
        self.draw = np.random.default_rng(seed)
        self.mains, self.others = mains, others

    def chance(self, p: float) -> bool:
        return self.draw.random() < p

    def one(self, *options: str) -> str:
        return options[self.draw.integers(len(options))]

    def foreign(self) -> str:
        """A block of another article, as side text."""
        page = self.mains[self.draw.integers(len(self.mains))]
        return page[self.draw.integers(len(page))][:600]

    def short(self) -> str:
        words = (self.one(*self.others) if self.others and self.chance(0.5) else self.foreign()).split()
        return " ".join(words[: self.draw.integers(1, 6)])

    def box(self, tag: str, names: str, content: str) -> str:
        """An element with a telling name, a neutral one or none."""
        r = self.draw.random()
        if r < 0.12 and tag == "div" and not self.hints:
            return f"<div>{content}</div>"
        name = self.one(*names.split("|")) if self.hints else self.one("box", "row", "c1", "col", "x-a", "wrap", "inner")
        key = self.one("class", "class", "id")
        tag = tag if self.semantic else "div"
        return f'<{tag} {key}="{name}">{content}</{tag}>'

    def links(self, most: int = 9) -> str:
        return "<ul>" + "".join(
            f'<li><a href="/{i}">{self.short()}</a></li>' for i in range(self.draw.integers(2, most))) + "</ul>"

    def side_text(self, most: int = 4) -> str:
        kind = self.one("p", "p", "div", "li")
        return "".join(f"<{kind}>{self.foreign()}</{kind}>" for _ in range(self.draw.integers(1, most)))

    def nav(self) -> str:
        if self.chance(0.6):
            return f"<nav>{self.links()}</nav>"
        return self.box("div", "menu|main-nav|navigation|navbar|breadcrumbs|top-menu", self.links())

    def advert(self) -> str:
        inner = self.foreign() if self.chance(0.5) else self.side_text(3)
        return self.box("div", "ad|ads|advert|sponsored|promo-box|advertisement|ad-slot", inner)

    def notice(self) -> str:
        inner = self.side_text(3) + (f"<button>{self.short()}</button>" if self.chance(0.6) else "")
        return self.box(self.one("div", "div", "section", "aside", "dialog"),
                        "cookie-notice|consent|popup|alert|gdpr-banner|notice|newsletter-popup|modal", inner)

    def form(self) -> str:
        fields = "".join(f"<label>{self.short()}</label><input>" for _ in range(self.draw.integers(1, 4)))
        lead = f"<p>{self.foreign()}</p>" if self.chance(0.6) else self.short()
        return f"<form>{lead}{fields}<button>{self.short()}</button></form>"

    def side(self) -> str:
        inner = f"<h3>{self.short()}</h3>" + (self.links() if self.chance(0.5) else "") + self.side_text(5)
        if self.chance(0.5):
            return f"<aside>{inner}</aside>"
        return self.box("div", "sidebar|related|widget|recommended|right-rail|side-bar|more-stories", inner)

    def comments(self) -> str:
        rows = []
        for _ in range(self.draw.integers(1, 7)):
            body = f"<p>{self.foreign()}</p>" if self.chance(0.7) else self.foreign()
            who = f"<b>{self.short()}</b> " if self.chance(0.4) else ""
            rows.append(self.box(self.one("div", "li", "article", "div"), "comment|comment-body|reply|user-comment", who + body))
        title = f"<h2>{self.short()}</h2>" if self.chance(0.6) else ""
        inner = title + "".join(rows) + (self.form() if self.chance(0.4) else "")
        return self.box(self.one("section", "div", "div", "aside"), "comments|discussion|comment-list|reader-comments|responses", inner)

    def foot(self) -> str:
        inner = f"&copy; {self.short()} &middot; {self.foreign()}" if self.chance(0.6) else self.links() + self.side_text(3)
        return f"<footer>{inner}</footer>" if self.chance(0.7) else self.box("div", "footer|bottom|site-footer", inner)

    def head(self) -> str:
        inner = f"<div>{self.short()}</div>" + (f"<p>{self.foreign()}</p>" if self.chance(0.5) else "")
        if self.chance(0.4):
            inner += self.nav()
        return f"<header>{inner}</header>" if self.chance(0.6) else self.box("div", "header|masthead|top-bar|site-header", inner)

    def article(self) -> str:
        page = self.mains[self.draw.integers(len(self.mains))]
        n = int(self.draw.integers(1, 26))
        blocks = [MARK + b for b in page[:n]]
        out = []
        for i, b in enumerate(blocks):
            r = self.draw.random()
            if i == 0 and r < 0.7:
                title = f"<h1>{b}</h1>"
                out.append(f"<header>{title}</header>" if self.chance(0.15) else title)
            elif r < 0.72:
                out.append(f"<p>{b}</p>")
            elif r < 0.76:
                out.append(f"<h2>{b[:80]}</h2>")
            elif r < 0.81:
                out.append(f"<ul><li>{b}</li><li>{MARK}{self.short()}</li></ul>")
            elif r < 0.84:
                out.append(f"<blockquote>{b}</blockquote>")
            elif r < 0.87:
                out.append(f"<table><tr><td>{b}</td><td>{MARK}{self.short()}</td></tr></table>")
            elif r < 0.89:
                out.append(f"<pre>{b}</pre>")
            elif r < 0.94:
                out.append(f"<div>{b}</div>")
            else:
                out.append(f"<p><b>{b}<br>")
            if self.chance(0.03):
                out.append(self.one(self.advert(), self.form(), self.box(
                    "div", "share|social-links|related-links", self.links(5)), self.side(), self.notice()))
        if len(out) > 4 and self.chance(0.2):
            half = len(out) // 2
            out = [f"<section>{''.join(out[:half])}</section>", f"<div>{''.join(out[half:])}</div>"]
        inner = "".join(out)
        r = self.draw.random()
        if r < 0.35:
            return f"<article>{inner}{self.comments() if self.chance(0.2) else ''}</article>"
        if r < 0.5:
            return f"<main>{inner}{self.comments() if self.chance(0.2) else ''}</main>"
        if r < 0.6:
            return f"<main><article>{inner}</article>{self.comments() if self.chance(0.5) else ''}</main>"
        return self.box(self.one("div", "section"), "content|post-body|entry-content|article-body|story|main|main-content|post", inner)

    def page(self) -> str:
        self.hints, self.semantic = self.chance(0.8), self.chance(0.9)
        before = [f() for f, p in ((self.notice, 0.25), (self.head, 0.5), (self.nav, 0.7), (self.advert, 0.4)) if self.chance(p)]
        after = [f() for f, p in ((self.comments, 0.4), (self.side, 0.4), (self.form, 0.25), (self.advert, 0.3),
                                  (self.foot, 0.8), (self.notice, 0.15)) if self.chance(p)]
        if self.chance(0.2):
            before.append(self.side())
        middle = self.article()
        if self.chance(0.4):
            split = int(self.draw.integers(0, len(after) + 1))
            middle = f"<div>{middle}{''.join(after[:split])}</div>"
            after = after[split:]
        page = "".join([*before, middle, *after])
        for _ in range(self.draw.integers(0, 3)):
            page = f'<div class="{self.one("wrap", "page", "container", "site", "row")}">{page}</div>'
        page = f"<!DOCTYPE html><html><head><title>{self.short()}</title></head><body>{page}</body></html>"
        return page[: int(len(page) * self.draw.uniform(0.6, 1))] if self.chance(0.1) else page


def learn(sources: list[str], seed: int = 11) -> boosting.Forest | None:
    """Trees from sampled pages; no random numbers but seeded ones."""
    pages, marks, mains, others = [], [], [], []
    for source in sources:
        page = dom.parse(source)
        found = _articles(page)
        texts = [i for i, t in enumerate(page.tag) if t == dom.TEXT_TAG]
        if found:
            mains.append([page.text[i] for i in found])
            pages.append(page)
            marks.append(set(found))
        others += [page.text[i] for i in texts if i not in set(found)][:40]
    if not mains:
        long = [t for t in others if len(t.split()) >= 8]
        mains = [long[i: i + 12] for i in range(0, len(long), 12)]
    if not mains:
        return None
    layout = _Layout(mains, others, seed)
    for _ in range(DRAWN):
        page = dom.parse(layout.page())
        pages.append(page)
        marks.append({i for i, t in enumerate(page.text) if MARK in t})
        page.text = [t.replace(MARK, "") for t in page.text]
    truth = []
    for page, main in zip(pages, marks):
        holds = np.append(0, np.cumsum([i in main for i in range(len(page.parent))]))
        end = np.asarray(page.end)
        truth.append(holds[end] > holds[: len(end)])
    x, y = dom.features(pages), np.concatenate(truth).astype(float)
    weight = np.ones(len(y))
    weight[np.concatenate([np.asarray(p.tag) == dom.TEXT_TAG for p in pages])] = 2.0
    return boosting.train(x, y, weight)


def extract(sources: list[str], forest: boosting.Forest | None) -> list[str]:
    """Main texts of pages."""
    out: list[str] = []
    waiting: list[dom.Page] = []

    def settle() -> None:
        if forest is None:
            odds = [np.ones(len(p.parent)) for p in waiting]
        else:
            every = boosting.predict(forest, dom.features(waiting))
            odds = np.split(every, np.cumsum([len(p.parent) for p in waiting])[:-1])
        out.extend("\n\n".join(p.text[i] for i in choose(p, z)) for p, z in zip(waiting, odds))
        waiting.clear()

    nodes = 0
    for source in sources:
        waiting.append(dom.parse(source))
        nodes += len(waiting[-1].parent)
        if nodes > NODES:
            settle()
            nodes = 0
    if waiting:
        settle()
    return out


def _extract_batches(batches: Iterator[pa.RecordBatch], forest: boosting.Forest | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in common.text_chunks(batch.column(2)):
            rows = len(chunk.offsets) - 1
            sources = [s or "" for s in batch.column(2).slice(chunk.first, rows).to_pylist()]
            texts = extract(sources, forest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.first, rows), batch.column(1).slice(chunk.first, rows),
                 pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])


def fit(pages: DataFrame, sample: int = SAMPLE) -> boosting.Forest | None:
    """Trees from the sampled pages; the sample is all that reaches the driver."""
    short = pages.select("page_id", "html", F.xxhash64("page_id", "html").alias("h")).filter(
        F.length("html").between(1, SAMPLE_CHARS))
    # First the least hashes, then the pages that have them; at most ``sample`` hashes are sent to the tasks.
    least = short.select("h").distinct().orderBy("h").limit(sample)
    few = short.join(F.broadcast(least), "h").dropDuplicates(["h"]).orderBy("h")
    return learn([r["html"] for r in few.select("h", "html").collect()])


def main_text(pages: DataFrame, forest: boosting.Forest | None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    common.ship(pages.sparkSession)
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return picked.mapInArrow(lambda batches: _extract_batches(batches, forest), RESULT)

"""A tolerant reading of HTML into block-level nodes, and numeric features of the nodes."""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*+(?:>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?P<close>>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop|aria-label|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall

#: Elements whose content is not markup, or not for readers; their text goes unread.
RAW = frozenset("script style template iframe noscript textarea title svg canvas object".split())
#: Those of them that hold markup: without an end tag they end where they begin, and what follows is read.
HOLDS_MARKUP = frozenset("template iframe noscript svg canvas object".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul hr input".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"})}
_KEEPS_P = frozenset("button label option optgroup caption tbody td tfoot th thead tr legend summary input head html body".split())

TAGS = [{"article", "main"}, {"section", "div", "center"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"},
        {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"}, {"nav"}, {"aside"}, {"footer"}, {"header"},
        {"form", "fieldset", "select", "button", "label", "input", "option", "optgroup", "legend"},
        {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"},
        {"blockquote", "pre", "figure", "figcaption", "details", "summary"}, {"html", "body"}, {"dialog"}]
TEXT_TAG = len(TAGS)
_TAG_OF = {name: i for i, group in enumerate(TAGS) for name in group}
#: Words of class, id and role by what they announce.
TOKENS = [
    "article content post entry main body text story prose copy".split(),
    "nav navigation menu breadcrumb breadcrumbs pager pagination toc tabs skip".split(),
    "header masthead banner top logo brand topbar".split(),
    "footer bottom copyright legal colophon contentinfo".split(),
    "sidebar aside related recommended widget rail complementary trending popular more teaser".split(),
    "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted adbox dfp banners".split(),
    "notice cookie cookies consent gdpr popup modal overlay alert newsletter paywall dialog warning toast".split(),
    "comment comments reply replies discussion respond responses disqus thread feedback reviews commentlist".split(),
    "share social sharing follow tweet facebook tools".split(),
    "form subscribe signup login search contact poll survey register".split(),
    "hidden none invisible".split(),
]
_GROUP_OF = {word: i for i, group in enumerate(TOKENS) for word in group}
GROUPS = len(TOKENS)
#: Elements that announce a group by their name.
_GROUP_OF_TAG = {"article": 0, "main": 0, "nav": 1, "header": 2, "footer": 3, "aside": 4, "dialog": 6, "form": 9}


class Page:
    """Nodes in document order. A subtree is the range [i, end[i]); text nodes hold the blocks."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.end: list[int] = []
        self.tag: list[int] = []
        self.name: list[str] = []
        self.groups: list[int] = []
        self.inherited: list[int] = []
        self.depth: list[int] = []
        self.text: list[str] = []
        self.link: list[int] = []

    def add(self, parent: int, name: str, tag: int, groups: int, text: str = "", link: int = 0) -> int:
        self.parent.append(parent)
        self.name.append(name)
        self.tag.append(tag)
        self.groups.append(groups)
        self.inherited.append(groups | (self.inherited[parent] if parent >= 0 else 0))
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.text.append(text)
        self.link.append(link)
        self.end.append(len(self.parent))
        return len(self.parent) - 1


def _groups(name: str, attrs: str) -> int:
    bits = 1 << _GROUP_OF_TAG[name] if name in _GROUP_OF_TAG else 0
    if "=" in attrs or "hidden" in attrs:
        for key, *values in _ATTR.findall(attrs):
            if key.lower() == "hidden":
                bits |= 1 << _GROUP_OF["hidden"]
                continue
            for word in _TOKEN("".join(values)):
                group = _GROUP_OF.get(word.lower())
                if group is not None:
                    bits |= 1 << group
    return bits


def parse(source: str) -> Page:
    page = Page()
    page.add(-1, "#page", TEXT_TAG + 1, 0)
    stack, names = [0], ["#page"]
    open_now: Counter[str] = Counter()  # open elements by name
    unclosed: set[str] = set()  # names without an end tag from here on
    pieces: list[str] = []
    linked, in_link, at, n = 0, False, 0, len(source)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            page.add(stack[-1], "#text", TEXT_TAG, 0, text, min(linked, len(text)))
        pieces.clear()
        linked = 0

    def close(to: int) -> None:
        """Elements above place ``to`` of the stack end here."""
        while len(stack) > to:
            page.end[stack.pop()] = len(page.parent)
            open_now[names.pop()] -= 1

    def innermost(name: str) -> int:
        """Place of the last open element of that name; what lies above it is closed next, so the search is paid for."""
        place = len(names) - 1
        while names[place] != name:
            place -= 1
        return place

    while at < n:
        m = _TAG.search(source, at)
        until = m.start() if m else n
        if until > at:
            piece = source[at:until]
            if "&" in piece:
                piece = html.unescape(piece)
            pieces.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = m["name"]
        if not name or not m["close"]:
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                in_link = False
            elif name in BLOCKS and open_now[name]:
                flush()
                close(innermost(name))
            continue
        if name in RAW:
            if m["attrs"].endswith("/") or name in unclosed:
                continue
            tail = re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I).search(source, at)
            if tail:
                at = tail.end()
            elif name in HOLDS_MARKUP:
                unclosed.add(name)
            else:
                at = n
            continue
        if name == "a":
            in_link = True
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCKS:
            flush()
            if name not in _KEEPS_P and open_now["p"]:
                close(innermost("p"))
            ends, scope = _CLOSES.get(name, ((), ()))
            for place in range(len(names) - 1, 0, -1) if any(open_now[e] for e in ends) else ():
                if names[place] in scope:
                    break
                if names[place] in ends:
                    close(place)
                    if name != "tr":
                        break
            node = page.add(stack[-1], name, _TAG_OF.get(name, 1), _groups(name, m["attrs"]))
            if name not in VOID:
                stack.append(node)
                names.append(name)
                open_now[name] += 1
    flush()
    close(0)
    return page


def _sums(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums over subtrees."""
    total = np.append(0.0, np.cumsum(values))
    return total[end] - total[: len(end)]


WIDTH = 22 + TEXT_TAG + 2 + 3 * GROUPS


def features(pages: list[Page]) -> np.ndarray:
    """A row for every node of all pages, one page after the other."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = lambda name, kind=np.int64: np.concatenate([np.asarray(getattr(p, name), kind) for p in pages])
    parent = np.maximum(whole("parent"), 0) + first
    end = whole("end") + first
    n = len(parent)
    own = np.arange(n)
    tag, groups, inherited, depth = whole("tag"), whole("groups"), whole("inherited"), whole("depth")
    texts = [t for p in pages for t in p.text]
    chars = np.array([len(t) for t in texts], float)
    n_words = np.array([t.count(" ") + 1 if t else 0 for t in texts], float)
    marks = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in texts], float)
    is_text = tag == TEXT_TAG
    sub_chars, sub_links, sub_words = _sums(chars, end), _sums(whole("link", float), end), _sums(n_words, end)
    sub_marks, sub_texts = _sums(marks, end), _sums(is_text, end)
    sub_p, sub_heads = _sums(tag == 2, end), _sums(tag == 3, end)
    below = (end - own - 1).astype(float)
    inner = own != first
    children = np.bincount(parent[inner], minlength=n).astype(float)
    order = np.argsort(parent[inner], kind="stable")
    child = own[inner][order]
    rank = np.zeros(n)
    rank[child] = np.arange(len(child)) - np.searchsorted(parent[child], parent[child])
    before, after = np.zeros(n), np.zeros(n)
    same = parent[child[1:]] == parent[child[:-1]]
    before[child[1:][same]] = sub_chars[child[:-1][same]]
    after[child[:-1][same]] = sub_chars[child[1:][same]]
    page_chars = np.maximum(sub_chars[first], 1)
    ahead = np.append(0.0, np.cumsum(chars))[:n]
    ahead = ahead - ahead[first]
    long_texts = _sums((n_words >= 15) & is_text, end)
    cols = [
        depth, np.log1p(sub_chars), sub_links / np.maximum(sub_chars, 1), np.log1p(below),
        np.log1p(sub_chars / (below + 1)), np.log1p(children), rank / np.maximum(children[parent], 1),
        np.log1p(children[parent]), sub_chars / page_chars, ahead / page_chars,
        100 * sub_marks / np.maximum(sub_chars, 1), sub_words / np.maximum(sub_texts, 1), sub_p / (below + 1),
        np.log1p(sub_heads), sub_chars / np.maximum(sub_chars[parent], 1), np.log1p(before), np.log1p(after),
        np.log1p(long_texts), long_texts / np.maximum(sub_texts, 1), sub_chars[parent] / page_chars,
        sub_links[parent] / np.maximum(sub_chars[parent], 1), np.log1p(sub_p[parent]),
    ]
    cols += [tag == i for i in range(TEXT_TAG + 2)]
    for g in range(GROUPS):
        bit = (groups >> g & 1).astype(float)
        cols += [bit, inherited >> g & 1, _sums(bit, end) > 0]
    return np.column_stack(cols).astype(np.float32)

"""Main text of web pages by tag-path ratios (operator 5).

Text blocks are grouped by the path of tags above them. A path's ratios are its text length outside links and
its punctuation per block; both are smoothed over the page's order of blocks and multiplied, so that long,
written prose stands out from lists of links and labels. Tags and names only weigh a path's ratio: less below
nav, footer or an element named as an advert, more below article or main. Paths above a share of the best one
are content. They decide the element that holds the article, and headings and short lines there belong to it
as well, unless their path is weighed down.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwright.llm.common import free_name

TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、؟]")
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
# Never text that a reader of the article sees.
UNSEEN = frozenset("head title form button select textarea input script style noscript template iframe svg canvas object dialog xmp noembed noframes audio video map datalist".split())
IN_HEAD = frozenset("head title meta link base script style noscript template".split())
# Parts of a page that aren't the article.
APART = frozenset("nav footer aside menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
# Reader comments read like an article. These names tell them; a thread under another name shows by its entries.
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
# Names that a thread may bear and a chapter as well.
THREAD_WORDS = frozenset("discussion response responses respond reply replies thread forum".split())
# Who wrote an entry, and when.
AUTHOR_WORDS = frozenset("author user username nick nickname commenter avatar byline fn poster".split())
DATE_WORDS = frozenset("date time timestamp datetime posted ago published".split())
ENTRIES = frozenset("div li article section blockquote dd p tr".split())
# Matched in a name's parts between hyphens only if all of its other parts are such words or plain ones of layout.
APART_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar
    breadcrumb breadcrumbs pagination pager sidebar side aside rail widget widgets footer foot site-header masthead topbar toolbar header comment comments
    commentlist disqus replies reply respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter
    subscribe subscription signup login share sharing social related recommended recommendations more-stories outbrain taboola copyright legal disclaimer
    skip hidden search form""".split()
)
PLAIN_WORDS = frozenset("area bar block box cell container content feed group inner item items left list main outer page panel post posts right section site slot top bottom unit wrap wrapper".split())
# Only these are left out for their names; headings and inline elements name a topic, not a part of the page.
CONTAINERS = frozenset("div section ul ol dl table td header details figure p fieldset center".split())
#: Share of the best path's score that makes a path content.
SHARE = 0.25
#: Weights of the ratios below an element of APART, below one named as something else, and below article or main.
TAG_WEIGHT, NAME_WEIGHT, ARTICLE_WEIGHT = 0.02, 0.05, 4.0
#: Share of the content paths' text that the element with the article holds.
HELD = 0.95

AUTHOR, DATE = 1, 2


class Paths:
    """Tag paths of a page as numbers: 0 is the empty one, each other has a parent of a lower number and a label."""

    def __init__(self):
        self.parent, self.label, self.depth, self.article, self.known = [0], [""], [0], [False], {}

    def below(self, path: int, label: str) -> int:
        key = path, label
        if key not in self.known:
            self.known[key] = len(self.parent)
            self.parent.append(path)
            self.label.append(label)
            self.depth.append(self.depth[path] + 1)
            self.article.append(self.article[path] or _is_article(label))
        return self.known[key]

    def tag(self, path: int) -> str:
        return self.label[path].split(".")[0]


class _Node:
    __slots__ = ("block", "comment", "entries", "marks", "number", "parent", "path", "tag", "text", "thread", "unseen", "weight")

    def __init__(self, tag: str, path: int, number: int, parent: _Node | None):
        self.tag, self.path, self.number, self.parent = tag, path, number, parent
        self.block = parent.block if tag in INLINE and parent else None if tag in INLINE else self
        self.unseen, self.comment, self.weight = (parent.unseen, parent.comment, parent.weight) if parent else (False, False, 1.0)
        self.marks, self.text, self.thread, self.entries = 0, False, False, None


class Block:
    """A run of text in one block element: its tag path, its text, characters of it in links, the path's weight, whether it
    lies in reader comments (known by name, or in a thread, known by its entries)."""

    __slots__ = ("comment", "linked", "node", "path", "text", "weight")

    def __init__(self, node: _Node | None, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked
        self.path, self.weight, self.comment = (node.path, node.weight, node.comment) if node else (0, 1.0, False)


def _is_article(label: str) -> bool:
    return label.split(".")[0] in ("article", "main")


def _about(name: str, words: frozenset[str]) -> bool:
    """Whether a whole class or id is made of these words and plain ones of layout, as sidebar-left, but not has-sidebar."""
    name = name.lower()
    parts = [x for x in re.split("[-_]+", name) if x]
    return name in words or (any(x in words for x in parts) and all(x in APART_WORDS or x in PLAIN_WORDS or x in words for x in parts))


def _opened(tag: str, attributes: str, above: _Node | None, paths: Paths, number: int) -> _Node:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    path = above.path if above else 0
    node = _Node(tag, paths.below(path, f"{tag}.{' '.join(names)}" if names else tag), number, above)
    node.unseen = node.unseen or tag in UNSEEN or ("hidden" in found and tag != "input") or found.get("aria-hidden", "").lower() == "true"
    in_article, weight = paths.article[path], node.weight
    if tag in ("article", "main") and not in_article and weight == 1.0:
        weight = ARTICLE_WEIGHT
    if tag in APART or (tag == "header" and not in_article) or found.get("role", "").lower() in APART_ROLES:
        weight = min(weight, TAG_WEIGHT)
    elif tag in CONTAINERS and any(_about(x, APART_WORDS) for x in names):
        weight = min(weight, NAME_WEIGHT)
        node.comment = node.comment or any(_about(x, COMMENT_WORDS) for x in names)
    node.weight = weight
    words = {x for name in names for x in re.split("[-_]+", name.lower())}
    if tag == "time" or not words.isdisjoint(DATE_WORDS):
        node.marks |= DATE
    if found.get("itemprop", "").lower() == "author" or not words.isdisjoint(AUTHOR_WORDS):
        node.marks |= AUTHOR
    return node


def _left(node: _Node, paths: Paths) -> None:
    """Close an element: what it shows of writers and dates counts for its parent, and so do its entries.

    A thread has two entries or more of one label that name a writer and a date each, or one of both where its own name may be
    that of a thread.
    """
    if node.entries:
        named = any(_about(x, THREAD_WORDS) for x in paths.label[node.path].partition(".")[2].split())
        node.thread = any(both >= 2 or (named and some >= 2) for both, some in node.entries.values())
    above = node.parent
    if above is None:
        return
    above.marks |= node.marks
    above.text = above.text or node.text
    if node.text and node.marks and node.tag in ENTRIES:
        if above.entries is None:
            above.entries = {}
        both, some = above.entries.get(node.path, (0, 0))
        above.entries[node.path] = both + (node.marks == AUTHOR | DATE), some + 1


class _Scanner:
    """Tags of a page one after another, in time linear in its length whatever quotes are open or tags unclosed."""

    def __init__(self, page: str):
        self.page, self.last, self.hopeless = page, page.rfind(">"), set()

    def _end(self, at: int) -> int:
        """Where the tag whose attributes begin at `at` ends: the first > outside quotes, else the first at all, else -1."""
        page, first, seen = self.page, at, []
        while at <= self.last:
            m = STOP.search(page, at)
            if m is None or m[0] == ">":
                return m.start() if m else page.find(">", first)
            if m.start() in self.hopeless:
                break
            seen.append(m.start())
            close = page.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.hopeless.update(seen)  # from these quotes on, no > follows outside quotes
        return page.find(">", first) if first <= self.last else -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, tag, attributes) of the next tag from `at`; comments and declarations have no tag."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start) if start <= self.last else -1
                if end >= 0:
                    return start, end + 1, "", "", ""
            elif m := TAG.match(page, start + 1):
                end = self._end(m.end())
                if end >= 0:
                    return start, end + 1, m[1], m[2], page[m.end() : end]
            at = start + 1
        return None


def text_blocks(page: str) -> tuple[list[Block], Paths]:
    """The page's blocks of text in page order, without what is never seen, and their tag paths."""
    stack: list[_Node] = []
    nodes: list[_Node] = []
    open_: dict[str, int] = {}
    blocks: list[Block] = []
    pending: list[str] = []
    paths, scanner = Paths(), _Scanner(page)
    holder: _Node | None = None
    linked = 0

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(pending)).split())
        if text:
            blocks.append(Block(holder, text, linked))
        pending.clear()
        linked = 0

    def pop() -> str:
        node = stack.pop()
        open_[node.tag] -= 1
        _left(node, paths)
        return node.tag

    def leave_head():
        if open_.get("head"):
            flush()
            while pop() != "head":
                pass

    def add(text: str):
        nonlocal holder, linked
        if not text:
            return
        if stack and stack[-1].tag == "head" and not text.isspace():
            leave_head()  # its closing tag may be left out
        if stack and stack[-1].unseen:
            return
        if not pending:
            holder = stack[-1].block if stack else None
        pending.append(text)
        if not text.isspace():
            if stack:
                stack[-1].text = True
            if open_.get("a"):
                linked += len(text.strip())

    at = 0
    while found := scanner.next(at):
        start, end, closing, tag, attributes = found
        add(page[at:start])
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag not in INLINE:
                flush()
            if open_.get(tag):
                while pop() != tag:
                    pass
            continue
        if tag not in INLINE:
            flush()
        if tag not in IN_HEAD:
            leave_head()
        if tag in CLOSES_P and open_.get("p"):
            while pop() != "p":
                pass
        if tag in SAME_LEVEL:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in SAME_LEVEL[tag] or stack[i].tag in ("ul", "ol", "dl", "table")), -1)
            if depth >= 0 and stack[depth].tag in SAME_LEVEL[tag]:
                while len(stack) > depth:
                    pop()
        if tag in VOID:
            continue
        node = _opened(tag, attributes, stack[-1] if stack else None, paths, len(nodes))
        if attributes.rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not node.unseen:
                add(page[at : close.start() if close else len(page)])
            at = close.end() if close else len(page)
            continue
        stack.append(node)
        nodes.append(node)
        open_[tag] = open_.get(tag, 0) + 1
    rest = page[at:]
    add(rest if "<" not in rest else re.sub(r"<[a-zA-Z/][^>]*\Z", "", rest))
    flush()
    while stack:
        pop()
    within = [False] * len(nodes)
    for node in nodes:
        within[node.number] = node.thread or (node.parent is not None and within[node.parent.number])
    for block in blocks:
        if block.node is not None:
            block.comment = block.comment or within[block.node.number]
    return blocks, paths


def _smooth(values: list[float]) -> list[float]:
    """Each value's geometric mean with the Gaussian average around it, so that prose lends a label next to it little."""
    kernel = [math.exp(-0.5 * (d / 1.0) ** 2) for d in (-2, -1, 0, 1, 2)]
    out = []
    for i in range(len(values)):
        near = [(k, values[i + d]) for k, d in zip(kernel, (-2, -1, 0, 1, 2), strict=True) if 0 <= i + d < len(values)]
        out.append(math.sqrt(values[i] * sum(k * v for k, v in near) / sum(k for k, _ in near)))
    return out


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """Fused ratio of each tag path: smoothed unlinked length per block x (1 + smoothed punctuation per block), weighed."""
    total: dict[int, list[float]] = {}
    for b in blocks:
        t = total.setdefault(b.path, [0.0, 0.0, 0.0, b.weight])
        own = max(0, len(b.text) - b.linked)
        t[0] += own
        t[1] += len(PUNCTUATION.findall(b.text)) * own / len(b.text)
        t[2] += 1
    size = _smooth([total[b.path][0] / total[b.path][2] for b in blocks])
    marks = _smooth([total[b.path][1] / total[b.path][2] for b in blocks])
    out = dict.fromkeys(total, 0.0)
    for b, s, m in zip(blocks, size, marks, strict=True):
        out[b.path] += s * (1 + m) / total[b.path][2]
    return {p: v * math.log1p(total[p][0]) * total[p][3] for p, v in out.items()}


def content_paths(scores: dict[int, float]) -> set[int]:
    """The paths that score at least SHARE of the best."""
    least = SHARE * max(scores.values())
    return {p for p, v in scores.items() if v >= least}


def container(blocks: list[Block], chosen: set[int], paths: Paths) -> int:
    """The deepest element that holds HELD of the content paths' text, or the first article or main on the way there."""
    held = [0] * len(paths.parent)
    for b in blocks:
        if b.path in chosen:
            held[b.path] += len(b.text)
    need = HELD * sum(held)
    best = [0] * len(held)
    for p in range(len(held) - 1, 0, -1):  # a parent comes before what lies below it
        above = paths.parent[p]
        held[above] += held[p]
        if held[p] and (not best[above] or held[p] >= held[best[above]]):
            best[above] = p
    here = 0
    while not (here and _is_article(paths.label[here])):
        most = best[here]
        if not most or held[most] < need or most in chosen:
            break
        here = most
    return here


def _without_comments(blocks: list[Block]) -> list[Block]:
    """The blocks without reader comments, if anything that could be an article is left; a thread on which it ends counts as
    such only if prose that isn't weighed down comes before it."""
    rest = [b for b in blocks if not b.comment]
    named = [b for b in blocks if b.comment and not (b.node and b.node.comment)]
    if named:
        first = next(i for i, b in enumerate(blocks) if b is named[0])
        if not any(not b.comment and b.weight >= 1 and PUNCTUATION.search(b.text) for b in blocks[:first]):
            rest = [b for b in blocks if not (b.node and b.node.comment)]  # the page is the thread
    return rest or blocks


def main_text(page: str | None) -> str:
    """The article's text: blocks joined by one space, in page order; empty if there is none."""
    blocks, paths = text_blocks(page or "")
    blocks = _without_comments(blocks)
    if not any(b.weight > TAG_WEIGHT for b in blocks):  # nothing but menus and footers
        return ""
    scores = path_scores(blocks)
    chosen = content_paths(scores)
    here = container(blocks, chosen, paths)
    deep = paths.depth[here]
    # what of each path lies right below the element with the article, 0 if it lies elsewhere
    under = [0] * len(paths.parent)
    inside = [False] * len(paths.parent)
    inside[here] = True
    for p in range(1, len(under)):
        above = paths.parent[p]
        if p != here:
            inside[p] = inside[above] and p > here
            under[p] = p if above == here else under[above]
    # an element that's no narrower than the body holds other things too: only what lies beside or with content
    wide = deep <= 2 and not (here and _is_article(paths.label[here]))
    with_content = {under[p] for p in chosen if inside[p]}
    out, title = [], None
    for b in blocks:
        p = b.path
        if inside[p]:
            beside = not wide or (under[p] == p and p != here and paths.tag(p) in PROSE) or under[p] in with_content
            if p in chosen or (b.weight >= 1 and beside and 2 * b.linked <= len(b.text)):
                out.append(b.text)
        elif not out and b.weight >= 1 and p and paths.tag(p) == "h1":
            title = b.text  # a headline outside the element with the text
    return " ".join(out if title is None else [title, *out])


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The rows with all their columns and a last one, out_col: the main text of the whole html.

    Null and empty html give an empty text; repeated rows are treated alike. Where pages have a column of that
    name, the new one gets underscores behind it. Empty input: no rows.
    """
    import pandas as pd

    def run(batches):
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    run.__annotations__ = {}
    text = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col(html_col).cast("string"))
    return pages.withColumn(free_name(pages, out_col), text)

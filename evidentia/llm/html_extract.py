"""Main text of web pages by tree scoring.

A page is read into a light tree: comments, scripts and styles are skipped, end
tags that browsers imply are supplied, unclosed elements end with their parent.
Text is gathered into blocks, which end wherever a block element starts or ends.
Subtrees whose tag, role, class or id names page furniture (menus, headers,
footers, sidebars, notices, adverts, forms, comments) are set aside.  A name is read
by its parts: what counts is the whole name, or its last part after words for boxes
and lists (``cookie-banner``, ``comments-area``), or a first part that hardly names
anything else (``sidebar-left``); states such as ``has-sidebar`` say nothing.  An
element with most of the page's text is no furniture, whatever its name, if it holds
an article or the page's title, is named like one too, or the page has neither (of
comments: with nearly all of the text, and the title); neither is the header of an
article.

Every remaining paragraph gives 1 point, 1 for each comma and up to 3 for its
length to its parent, half of that to the grandparent and a falling share to
further ancestors.  A container's points are scaled by 1 - link density.  The
best container, or the article or main element around it, is kept.  Where there is no
such element, it is widened to the element around it as long as that isn't the page's
body and holds less text besides; what lies beside the container there is kept however
short it is (lists, tables, code, quotes, captions, leads), but for what is mostly links.
In the body, siblings are kept that score well themselves, are plain running text, go on
from the container as text elements without a break, or lie between two that are kept.

Reading and scoring take time in proportion to the page: an unclosed tag or quote
is looked for once, ends of tags that are not open are skipped, and sums over
ancestors are taken once for each element.

Cases: a null or empty page, and one without text, give an empty text; a page
with no scoring container keeps the blocks outside furniture that are not mostly
links; between equal containers the outer or earlier one is kept; null ids and URLs
are carried; repeated rows are extracted alike; length and depth of a page are not
limited (no recursion); an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Generator, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head option select button".split()
)
CLOSES_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
FURNITURE = frozenset("nav header footer aside form button select dialog menu".split())
ALWAYS = frozenset("nav footer button select".split())  # furniture however much text they hold
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promotions banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail footer foot header masthead topbar comment comments commentlist respond replies reply disqus discussion thread threads share sharing social related recommend recommended recommendation recommendations newsletter subscribe subscription signup login signin cookie cookies consent gdpr notice notices alert alerts popup modal overlay toolbar widget widgets pagination pager tags copyright legal search searchform skip".split()
)
FIRST = frozenset("ad ads advert advertisement nav navbar breadcrumb breadcrumbs sidebar footer comment comments cookie cookies newsletter related sponsored masthead disqus".split())
COMMENTS = frozenset("comment comments commentlist respond replies reply disqus discussion thread threads".split())
FLOW = frozenset("p ul ol dl table pre blockquote figure details section h1 h2 h3 h4 h5 h6".split())  # text elements that may follow a container
BOXES = frozenset("wrap wrapper container box inner outer holder area section block list row col column item items left right top bottom bar slot links link buttons button posts articles stories group panel region zone unit primary secondary global site".split())
STATES = frozenset("has with no without is not hide show js".split())
LIKELY = re.compile(r"article|content|entry|main|post|story|text|body", re.I)
PARAGRAPH = frozenset("p pre blockquote td dd li div section article main body figcaption".split())
LEAVES = frozenset("p pre blockquote td dd li figcaption".split())  # that pass their points to the parent
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>=]")
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
SPACES = re.compile(r"\s+")
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


@lru_cache(maxsize=4096)
def named(token: str) -> int:
    """0: a class or id that says nothing of furniture, 1: furniture, 2: reader comments."""
    parts = [p.lower() for p in PARTS.findall(token)]
    if not parts or parts[0] in STATES:
        return 0
    heads = {"".join(parts), parts[0] if parts[0] in FIRST else ""}
    while len(parts) > 1 and (parts[-1] in BOXES or parts[-1].isdigit()):
        parts.pop()
    found = (heads | {parts[-1]}) & NAMES
    return 2 if found & COMMENTS else int(bool(found))


def named_comment(token: str) -> bool:
    """Whether an article's class or id calls it a comment: the whole name, or its last part after boxes and numbers."""
    parts = [p.lower() for p in PARTS.findall(token)]
    while len(parts) > 1 and (parts[-1] in BOXES or parts[-1].isdigit()):
        parts.pop()
    return bool(parts) and parts[0] not in STATES and parts[-1] in COMMENTS - {"discussion", "thread", "threads"}


class Node:
    __slots__ = ("block", "branch", "chars", "holds", "likely", "link_chars", "mark", "parent", "points", "role", "sealed", "tag")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.block = self if parent is None or tag in BLOCK else parent.block  # the innermost block element
        self.role = self.likely = self.holds = 0  # holds: bit 0 an article, bit 1 a title; role: 0 page, 1 furniture, 2 comments, 3 always furniture
        self.points, self.chars, self.link_chars = 0.0, 0, 0
        self.branch: Node | None = None
        self.mark = self.sealed = False


class Tags:
    """Tags of a page and the text between them, found in one pass."""

    def __init__(self, page: str):
        self.page, self.no_end = page, False
        self.no_quote = {'"': False, "'": False}

    def end_of(self, at: int) -> int:
        """Place of the > that ends the tag at ``at``, quoted values skipped; -1 if none follows."""
        page = self.page
        while not self.no_end:
            m = STOP.search(page, at)
            if m is None or (m[0] == "=" and page.find(">", m.end()) < 0):
                break
            if m[0] == ">":
                return m.start()
            at = m.end()
            while at < len(page) and page[at].isspace():
                at += 1
            quote = page[at : at + 1]
            if quote in self.no_quote and quote and not self.no_quote[quote]:
                close = page.find(quote, at + 1)
                if close < 0:
                    self.no_quote[quote] = True
                else:
                    at = close + 1
        self.no_end = page.find(">", at) < 0
        return -1

    def __iter__(self) -> Generator[tuple[str, str, str, int], int | None]:
        """(kind, name or text, attributes, where it ends); kind: text, < or /.  A place sent back is where to go on."""
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            if page[at] != "<":
                to = page.find("<", at)
                to = size if to < 0 else to
                yield "text", page[at:to], "", to
                at = to
                continue
            if page.startswith("<!--", at):
                to = page.find("-->", at + 4)
                at = size if to < 0 else to + 3
                continue
            closing = page.startswith("/", at + 1)
            m = NAME.match(page, at + 1 + closing)
            if m is None and page[at + 1 : at + 2] not in ("!", "?", "/") or self.no_end:
                yield "text", "<", "", at + 1
                at += 1
                continue
            to = self.end_of(m.end()) if m else page.find(">", at)
            if to < 0:  # never ended: text
                yield "text", "<", "", at + 1
                at += 1
                continue
            if m:
                onward = yield ("/" if closing else "<"), m[0].lower(), page[m.end() : to], to + 1
                if onward is not None:
                    yield "", "", "", onward
                    at = onward
                    continue
            at = to + 1


def parse(page: str) -> tuple[list[tuple[Node, str, int]], list[Node]]:
    """Blocks in page order (innermost block element, text, characters that are link text), and all elements, parents first."""
    root = Node("html", None)
    stack, nodes, blocks, text, links, in_link = [root], [root], [], [], 0, 0
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal links
        if text:
            joined = SPACES.sub(" ", "".join(text)).strip()
            if joined:
                blocks.append((stack[-1].block, joined, min(links, len(joined))))
            text.clear()
        links = 0

    def close(to: int) -> None:
        nonlocal in_link
        for node in stack[to:]:
            in_link -= node.tag == "a"
            opened[node.tag] -= 1
        del stack[to:]

    tags = iter(Tags(page))
    for kind, tag, attributes, at in tags:
        if kind == "text":
            piece = html.unescape(tag) if "&" in tag else tag
            text.append(piece)
            if in_link:
                links += len(piece.strip())
            continue
        if kind == "/":
            if tag in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in ("table", "article", "main", "body") and tag not in BLOCK:
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = _ENDS[tag].search(page, at)
                tags.send(end.end() if end else len(page))
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and opened["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in BLOCK:
                        break
            if tag in IMPLIED and any(opened[t] > 0 for t in IMPLIED[tag]):
                last = None
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in FENCE[tag]:
                        break
                    if stack[k].tag in IMPLIED[tag]:
                        last = k
                if last is not None:
                    close(last)
        node = Node(tag, stack[-1])
        describe(node, attributes, opened["article"] + opened["main"] > 0)
        stack.append(node)
        nodes.append(node)
        opened[tag] += 1
        in_link += tag == "a"
    flush()
    return blocks, nodes


def describe(node: Node, attributes: str, in_article: bool) -> None:
    """Whether an element's tag, role and names say furniture or text."""
    tag, role = node.tag, 0
    if tag in FURNITURE and not (tag == "header" and in_article):
        role = 3 if tag in ALWAYS else 1
    likely = False
    for name, a, b, c in ATTRIBUTE.findall(attributes) if "=" in attributes or "hidden" in attributes else ():
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            likely = likely or LIKELY.search(value) is not None
            if tag not in ("html", "body", "article", "main"):
                role = max([role, *map(named, value.split())])
            elif tag == "article" and any(map(named_comment, value.split())):
                role = 2
        elif name == "role" and value.lower() in ROLES:
            role = max(role, 1)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            role = 3
    node.role, node.likely = role, 25 * likely + {"article": 25, "main": 20}.get(tag, 0)


def seal(blocks: list[tuple[Node, str, int]], nodes: list[Node]) -> None:
    """Mark what lies in furniture: whatever is named so and does not hold the page's article, by its text and headings."""
    for node in nodes:
        node.sealed = node.role == 3 or (node.parent is not None and node.parent.sealed)
    free = 0
    for node, text, _ in blocks:
        if not node.sealed:
            node.chars += len(text)
            free += len(text)
    for node in reversed(nodes):
        node.holds |= {"article": 1, "main": 3, "h1": 3}.get(node.tag, 0) * (not node.sealed)
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.holds |= node.holds
    for node in nodes:
        text = (node.role == 1 and node.chars > 0.5 * free and (node.likely or node.holds)) or (node.role == 2 and node.chars > 0.9 * free and node.holds > 1)
        text = text or (node.role < 3 and node.chars > 0.9 * free and not nodes[0].holds)
        node.sealed = node.role == 3 or (node.role > 0 and not text) or (node.parent is not None and node.parent.sealed)
    for node in nodes:
        node.chars = 0


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by an empty line."""
    if not page:
        return ""
    blocks, nodes = parse(page)
    seal(blocks, nodes)
    blocks = [b for b in blocks if not b[0].sealed]
    if not blocks:
        return ""
    scored: list[Node] = []
    for node, text, links in blocks:
        node.chars += len(text)
        node.link_chars += links
        if node.tag not in PARAGRAPH or len(text) < 25:
            continue
        points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)) * (1 - links / len(text))
        up, level = (node.parent if node.tag in LEAVES and node.parent else node), 0
        while up is not None and level < 6:
            if not up.points:
                up.points = float(up.likely) + 1e-9
                scored.append(up)
            up.points += points / (1, 2, 6, 9, 12, 15)[level]
            up, level = up.parent, level + 1
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars

    def final(node: Node) -> float:
        return node.points * (1 - node.link_chars / max(node.chars, 1))

    place = {id(n): i for i, n in enumerate(nodes)}
    some = [n for n in scored if n.tag != "html"]
    semantic = [n for n in nodes if n.tag in ("article", "main") and n.chars]
    if some:
        top = max(some, key=lambda n: (final(n), -place[id(n)]))
    elif semantic:
        top = max(semantic, key=lambda n: (n.chars, -place[id(n)]))
    else:
        return "\n\n".join(t for _, t, links in blocks if links <= len(t) / 2)
    up = top
    while up is not None:  # the article around the best container
        if up.tag in ("article", "main"):
            top = up
            if up.tag == "article":
                break
        up = up.parent
    children: dict[int, list[Node]] = {}
    for node in nodes:
        if node.parent is not None and node.chars and not node.sealed:
            children.setdefault(id(node.parent), []).append(node)
    alone = top.tag in ("article", "main")
    linked = lambda n: n.link_chars > n.chars / 2
    dropped: set[int] = set()
    while not alone and top.parent is not None and top.parent.tag not in ("body", "html"):  # widened
        beside = [n for n in children[id(top.parent)] if n is not top]
        if sum(n.chars for n in beside if not linked(n) and n.tag not in FLOW) >= top.chars:
            break
        dropped.update(id(n) for n in beside if linked(n))
        top = top.parent
    for node in nodes:
        up = node.parent
        node.mark = node is top or (up is not None and up.mark and id(node) not in dropped)
        node.branch = node if up is not None and up is top.parent else up.branch if up is not None else None
    row = children.get(id(top.parent), []) if top.parent is not None else []
    run = beside_top(row, top, linked) if not alone else set()
    floor = 0.2 * final(top)
    keeps = []
    for node, text, links in blocks:
        child = node.branch
        keep = node.mark
        if not keep and child is not None and child is not top and top.tag != "body":
            loose = links / len(text)
            running = child is node and child.tag == "p" and ((len(text) > 80 and loose < 0.25) or (loose == 0 and len(text) > 25 and text.endswith((".", "!", "?"))))
            good = child.points and final(child) >= floor and not linked(child)
            keep = bool(good or (not alone and (running or id(child) in run or (child is node and re.match("h[1-6]$", child.tag)))))
        keeps.append(keep)
    if not alone and any(keeps):
        first, last = keeps.index(True), len(keeps) - 1 - keeps[::-1].index(True)
        for i in range(first, last + 1):  # between two that are kept
            child = blocks[i][0].branch
            keeps[i] = keeps[i] or (child is not None and child is not top and not linked(child) and not blocks[i][2] > len(blocks[i][1]) / 2)
    return "\n\n".join(text for (_, text, _), keep in zip(blocks, keeps, strict=True) if keep)


def beside_top(row: list[Node], top: Node, linked) -> set[int]:
    """Text elements that go on from the container without a break, on either side."""
    out: set[int] = set()
    at = next((i for i, n in enumerate(row) if n is top), None)
    if at is not None:
        for side in (row[at + 1 :], row[:at][::-1]):
            for n in side:
                if n.tag not in FLOW or linked(n):
                    break
                out.add(id(n))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

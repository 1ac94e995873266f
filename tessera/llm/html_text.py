"""Main text of web pages by composite text density.

A lenient parser builds a page's tree of elements, from which an outline of blocks and runs of text is made: formatting
and links belong to the run that they stand in. Every node of the outline gets its composite density: its characters per
tag (blocks and links; formatting does not count), scaled down by the share of characters and tags in links. The
densities of a block's children are summed. The block with the largest sum is the densest; the threshold is the smallest
density on the path from it to the body, the body included. From the body on, every block that reaches the threshold
gives up the subtree with the largest sum in it, and every run that reaches it counts by itself; of what is taken, the
nearest headings before it belong to it. The runs of all that are the main text, in page order.

Menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles and reader comments are cut
from the tree first, by their elements or by the words of their class, id and role attributes. Such a word or a form cuts
nothing that holds the page's article: a main element, an article of its own or a first heading with paragraphs (or, for
a form, paragraphs with half of the page's text). If the words leave no text at all, they are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard: elements without content, elements whose content is text, and what ends a paragraph.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section summary table ul".split()
)
_BLOCK = _ENDS_P | frozenset("body html br li dt dd tr td th thead tbody tfoot caption option legend iframe".split())
#: An opening tag of the key closes an open element of the values, up to the nearest container of the kind.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are never part of the main text.
_CUT = frozenset("head script style noscript template nav aside footer button select textarea input label legend iframe object embed svg math canvas audio video dialog menu noembed noframes title xmp".split())
_CUT_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: First words of class and id names that cut an element, and those that also cut as last words.
_FIRST_WORD = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar sidebars footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations comment comments commentlist disqus replies reply respond pagination pager toolbar widget widgets skip".split()
)
_LAST_WORD = frozenset("ad ads advert adverts advertisement navigation menu sidebar footer comment comments".split())
#: First words that say what a page or a wrapper has, not what it is.
_STATES = frozenset("with without no not has have is js show hide layout content".split())
_COMMENT_WORD = frozenset("comment comments commentlist reply replies respond".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)[^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element. ``cut``: never text; ``flag``: cut unless it holds the article ("word") or most of the text ("form")."""

    __slots__ = ("name", "parent", "children", "cut", "flag", "holds", "chars")

    def __init__(self, name: str, parent: Node | None, cut: bool = False, flag: str = ""):
        self.name, self.parent, self.cut, self.flag = name, parent, cut, flag
        self.children: list[Node | str] = []


def _named(value: str, words: frozenset[str], last: frozenset[str]) -> bool:
    for token in value.split():
        parts = _WORD.findall(token)
        if parts and (parts[0] in words or parts[-1] in last and parts[0] not in _STATES):
            return True
    return False


def _judged(name: str, attributes: str, inside_article: bool) -> tuple[bool, str]:
    """Whether an element is cut, and its flag."""
    if name in _CUT or name == "header" and not inside_article:
        return True, ""
    flag = "form" if name in ("form", "fieldset") else ""
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True, ""
        if name in ("html", "body", "main"):
            continue
        if key == "role" and value in _CUT_ROLE:
            flag = "form" if value == "form" else "word"
        elif key in ("class", "id") and (_named(value, _COMMENT_WORD, _COMMENT_WORD) if name == "article" else _named(value, _FIRST_WORD, _LAST_WORD)):
            flag = "word"
    return False, flag


def parse(page: str) -> Node:
    """The tree of a page. Unclosed elements end with their parents, stray closing tags and broken markup are passed over."""
    root = Node("body", None)
    here, at, n = root, 0, len(page)
    articles = 0
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            here.children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            here.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[1]:
            name = m[1].lower()
            node: Node | None = here
            # A closing tag of an inline element doesn't reach beyond the block that it stands in.
            while node is not None and node.name != name and (name in _BLOCK or name in _CUT or node.name not in _BLOCK):
                node = node.parent
            if node is not None and node.name == name and node.parent is not None:
                while here is not node.parent:
                    articles -= here.name == "article"
                    here = here.parent
        elif m[2] or m[4]:  # the latter with quotes that don't end
            name = (m[2] or m[4]).lower()
            if name in ("html", "body"):
                continue
            if name in _ENDS_P or name in _CLOSES:
                ends, within = ({"p"}, {"body", "article", "section", "div", "td", "th", "li", "blockquote"}) if name in _ENDS_P else _CLOSES[name]
                node = here
                while node.parent is not None and node.name not in ends and node.name not in within:
                    node = node.parent
                if node.parent is not None and node.name in ends:
                    here = node.parent
            if here.name == "head" and name not in ("meta", "title", "link", "style", "script", "base", "noscript", "template"):
                here = here.parent
            node = Node(name, here, *_judged(name, m[3] or "", articles > 0))
            here.children.append(node)
            if name in _VOID or (m[3] or "").endswith("/") and name not in _BLOCK:
                continue
            if name in _RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
                continue
            articles += name == "article"
            here = node
    return root


def settle(root: Node) -> None:
    """Cut the flagged elements, but for those that hold the page's article."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and not c.cut]
    flagged = False
    for node in reversed(nodes):
        below = [c for c in node.children if isinstance(c, Node) and not c.cut]
        node.chars = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(c.chars for c in below)
        node.holds = {c.name for c in below if c.name in ("h1", "p", "main") or c.name == "article" and not c.flag}.union(*(c.holds for c in below))
        flagged = flagged or bool(node.flag)
    if not flagged:
        return
    for node in nodes:
        if node.flag:
            wraps = "main" in node.holds or "article" in node.holds or node.holds >= {"h1", "p"}
            node.cut = not (wraps or node.flag == "form" and "p" in node.holds and 2 * node.chars >= root.chars)


class Run:
    """Text between two block boundaries, white space made one space; ``heading`` is the place of the last heading beside and before it."""

    __slots__ = ("text", "parent", "heading", "chars", "tags", "link_chars", "link_tags", "density")


class Block:
    """``items`` are runs and blocks; ``total`` sums their densities, ``best`` is the block of the largest total in the subtree."""

    __slots__ = ("name", "parent", "heading", "items", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "taken")

    def __init__(self, name: str, parent: Block | None):
        self.name, self.parent, self.items, self.taken = name, parent, [], False


def outline(root: Node) -> list[Block]:
    """All blocks of what isn't cut, parents first, in page order."""
    here = Block("body", None)
    found = [here]
    held: list[str] = []
    link_chars = link_tags = 0

    def close() -> None:
        nonlocal link_chars, link_tags
        text = _SPACE.sub(" ", "".join(held)).strip()
        if text:
            run = Run()
            run.parent = here
            run.text, run.chars, run.link_chars, run.tags, run.link_tags = text, len(text), min(link_chars, len(text)), link_tags, link_tags
            here.items.append(run)
        held.clear()
        link_chars = link_tags = 0

    todo: list[tuple[Node | str | None, bool]] = [(c, False) for c in reversed(root.children)]
    while todo:
        item, link = todo.pop()
        if item is None:
            close()
            here = here.parent
        elif isinstance(item, str):
            held.append(item)
            link_chars += len(_SPACE.sub(" ", item).strip()) if link else 0
        elif item.cut:
            if item.name in _BLOCK:
                close()
        elif item.name in _BLOCK and item.name not in _VOID:
            close()
            here.items.append(block := Block(item.name, here))
            found.append(block)
            here = block
            todo.append((None, False))
            todo += [(c, link) for c in reversed(item.children)]
        elif item.name in _BLOCK:
            close()
        else:
            link_tags += item.name == "a"
            todo += [(c, link or item.name == "a") for c in reversed(item.children)]
    close()
    return found


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Composite density; one is added to each count, so that none of them is zero."""
    if not chars:
        return 0.0
    unlinked = math.log((chars + 1) / (link_chars + 1) * (tags + 1) / (link_tags + 1))
    base = math.log((chars + 1) / (chars - link_chars + 1) * (link_chars + 1) + body_share * chars + math.e)
    return chars / max(tags, 1) * unlinked / math.log(base)


def weigh(blocks: list[Block]) -> None:
    """Fill in counts, densities, sums and best subtrees of an outline."""
    for b in reversed(blocks):
        own = [i for i in b.items if isinstance(i, Block)]
        b.chars, b.link_chars, b.link_tags = (sum(getattr(i, f) for i in b.items) for f in ("chars", "link_chars", "link_tags"))
        b.tags = len(own) + sum(i.tags for i in b.items)
    share = blocks[0].link_chars / max(blocks[0].chars, 1)
    for b in reversed(blocks):
        heading = -1
        for place, i in enumerate(b.items):
            i.heading = heading
            if isinstance(i, Block):
                heading = place if i.name in _HEADING else heading
            else:
                i.density = _density(i.chars, i.tags, i.link_chars, i.link_tags, share)
        b.density = _density(b.chars, b.tags, b.link_chars, b.link_tags, share)
        b.total = sum(i.density for i in b.items)
        b.best = b
        for i in b.items:
            if isinstance(i, Block) and i.best.total > b.best.total:
                b.best = i.best


def threshold(body: Block) -> float:
    """The smallest density on the path from the block of the largest sum to the body, both included."""
    node: Block | None = body.best
    least = node.density
    while node is not None:
        least, node = min(least, node.density), node.parent
    return least


def _take(item: Block | Run, taken: list[Run]) -> None:
    todo: list[Block | Run] = [item]
    while todo:
        x = todo.pop()
        if isinstance(x, Block):
            if x.taken:
                continue
            x.taken = True
            todo += x.items
        else:
            taken.append(x)


def article(blocks: list[Block]) -> list[Run]:
    """The runs of the main text, in page order; none if nothing has a density above zero."""
    body = blocks[0]
    weigh(blocks)
    if body.best.total <= 0:
        return []
    least = threshold(body)
    taken: list[Run] = []
    picks: list[Block | Run] = []
    todo: list[Block] = [body]
    while todo:
        node = todo.pop()
        if node.taken or node.density < least:
            continue
        picks.append(node.best)
        _take(node.best, taken)
        for i in node.items if not node.taken else ():
            if isinstance(i, Block):
                todo.append(i)
            elif i.density >= least:
                picks.append(i)
                taken.append(i)
    # The nearest headings before what is taken, beside it or beside what it stands in.
    done: set[int] = set()
    for item in picks:
        while item.parent is not None and id(item) not in done:
            done.add(id(item))
            items, at = item.parent.items, item.heading
            while at >= 0 and isinstance(items[at], Block) and items[at].name in _HEADING and not items[at].taken:
                _take(items[at], taken)
                at -= 1
            item = item.parent
    chosen = {id(r) for r in taken}
    return [r for r in _runs(body) if id(r) in chosen]


def _runs(body: Block) -> Iterator[Run]:
    todo: list[Block | Run] = [body]
    while todo:
        item = todo.pop()
        if isinstance(item, Run):
            yield item
        else:
            todo += reversed(item.items)


def main_text(page: str) -> str:
    """The article's runs joined by one space; empty if the page has none."""
    root = parse(page)
    settle(root)
    found = article(outline(root))
    if not found:
        todo = [root]
        while todo:  # without the words' cuts
            node = todo.pop()
            node.cut = node.cut and not node.flag
            todo += [c for c in node.children if isinstance(c, Node)]
        found = article(outline(root))
    return " ".join(r.text for r in found)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = [main_text(page) if page else "" for page in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    A null, empty or text-free page has the empty text; broken markup is parsed as far as it goes and nothing is cut off
    by length; repeated rows are each extracted; of two blocks with equal sums the outer or earlier one counts; a page of links only
    has no main text; an empty table gives
    an empty result; further columns are ignored.
    """
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to the containers above them, less with distance; a
container's points are discounted by the share of its text that is links. The best container, or its parent
where siblings score alike, and those siblings that read like it are kept with the headings right before
them, without whatever is named or marked as something else.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp svg math template".split())
NEVER = frozenset("script style textarea title iframe noscript noembed noframes xmp svg math template head nav footer aside button select input object embed dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "dd", "dt", "li"}
SCORED = frozenset("p pre td blockquote dd li".split())
CONTAINERS = frozenset("div section td".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
OTHER_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices banner alert popup modal overlay "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments respond replies disqus discussion related recommended share sharing social "
    "newsletter subscribe subscription signup login widget widgets masthead toolbar skip".split()
)
#: What an id inside the chosen text may consist of and still name a part of the page; one with any other word is the slug of a chapter.
PAGE_PARTS = OTHER_NAMES - {"discussion"} | frozenset("posts articles links stories list box section form area container wrapper buttons block bar items content thread count".split())
#: Words that make a name a state of the page and not a part of it: with-sidebar, ad-free, no-comments, menu-open.
STATES = frozenset("with without no non not has have is enabled disabled free open opened closed collapsed hidden visible active".split())
#: What holds this share of all text and a title is no mere part of the page, whatever it is called.
MOST = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Siblings with this share of the best one's points belong to it; with the second, they score alike.
BAR, ALIKE = 0.2, 0.5
HEADER_NAMES = frozenset("header topbar".split())
BONUS = {"article": 40.0, "main": 30.0}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element, its parts in order (texts and elements), and what it is called."""

    __slots__ = ("tag", "parent", "parts", "names", "slug", "dropped", "doubtful", "score", "length", "linked")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.parts: list[str | Node] = []
        self.names: frozenset[str] = frozenset()
        self.slug: frozenset[str] = frozenset()  # the words of the id, if it is dropped for them alone
        self.doubtful = tag == "form"  # dropped, unless it holds the text
        self.dropped = tag in NEVER or self.doubtful
        self.score = BONUS.get(tag, 0.0)
        self.length = self.linked = 0


def _read_attributes(node: Node, text: str) -> None:
    slug: frozenset[str] = frozenset()
    for name, value in _ATTRIBUTE.findall(text):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "class" or name == "id":
            words = frozenset().union(*(w for token in value.split() if not STATES & (w := {x.lower() for x in _NAME.findall(token)})))
            node.names, slug = (node.names | words, slug) if name == "class" else (node.names, slug | words)
        elif name == "role":
            node.dropped |= value.strip().lower() in OTHER_ROLES
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            node.dropped = True
    if node.tag not in ("article", "main", "body", "html") and not node.dropped:
        if node.names & OTHER_NAMES:
            node.dropped = node.doubtful = True
        elif slug & OTHER_NAMES:
            node.dropped, node.doubtful, node.slug = True, True, slug
    node.names |= slug


def parse(page: str) -> Node:
    """The tree of a page. End tags may be missing or stray; an unclosed element ends with its parent."""
    root = here = Node("#root", None)
    at = 0
    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            here.parts.append(_cut(page[at:]))
            return root
        if tag.start() > at:
            here.parts.append(page[at : tag.start()])
        at = tag.end()
        closing, name, rest = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            node = here
            while node is not None and node.tag != name:
                if name not in BLOCKS and node.tag in BLOCKS:  # an inline end tag reaches no further than its block
                    node = None
                    break
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if name in CLOSES_P:
            here = _close(here, {"p"}, BLOCKS - {"p"})
        if name in CLOSED_BY:
            here = _close(here, *CLOSED_BY[name])
        node = Node(name, here)
        here.parts.append(node)
        if name in VOID:
            continue
        if rest:
            _read_attributes(node, rest)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if not rest.endswith("/"):
            here = node


def _cut(rest: str) -> str:
    """Text at the page's end without a tag that was cut off in the middle."""
    cut = re.search(r"<[!/?a-zA-Z][^>]*\Z", rest)
    return rest[: cut.start()] if cut else rest


def _close(here: Node, tags: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> Node:
    """Leave the nearest open element of these tags, unless one of the others stands before it."""
    node = here
    while node.parent is not None and node.tag not in within:
        if node.tag in tags:
            return node.parent
        node = node.parent
    return here


def _restore_wrappers(root: Node) -> None:
    """What is dropped for its name, or as a form, stays if it holds most of the page's text and, but for a form, a title or the main element."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        linked |= node.tag == "a"
        node.length = 0 if linked else sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        stack += [(x, linked) for x in node.parts if isinstance(x, Node) and (not x.dropped or x.doubtful)]
    titled = set()
    for node in reversed(order):
        if node.tag in ("h1", "main") or id(node) in titled:
            titled.add(id(node))
            titled.add(id(node.parent))
        if node.parent is not None:
            node.parent.length += node.length
    for node in order:
        if node.doubtful and node.length > MOST * root.length and (node.tag == "form" or id(node) in titled):
            node.dropped = node.doubtful = False


def _measure(root: Node) -> list[Node]:
    """Lengths and linked lengths of all kept elements, and the elements in page order."""
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        order.append(node)
        linked |= node.tag == "a"
        node.length = sum(len(" ".join(x.split())) for x in node.parts if isinstance(x, str))
        node.linked = node.length if linked else 0
        stack += [(x, linked) for x in reversed(node.parts) if isinstance(x, Node) and not x.dropped]
    for node in reversed(order):
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
    return order


def _own_text(node: Node) -> str:
    """Text of an element without what stands in blocks inside it."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or x.tag not in BLOCKS and not x.dropped:
            stack += reversed(x.parts)
    return "".join(out)


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _drop_headers(order: list[Node]) -> None:
    """A header outside article and main is the page's; inside, it is the article's own if it holds a heading."""
    for node in order:
        if node.tag == "header" or node.names & HEADER_NAMES and node.tag not in ("article", "main", "body", "html"):
            above = node.parent
            while above is not None and above.tag not in ("article", "main"):
                above = above.parent
            node.dropped = above is None or not any(isinstance(x, Node) and x.tag in ("h1", "h2", "hgroup") for x in node.parts)


def _is_chapter(node: Node) -> bool:
    """Whether what is dropped for its id alone is the text's own: a heading, or a section whose id is the slug of a title."""
    if node.tag in HEADINGS:
        return bool(node.slug)
    titled = node.tag == "section" or node.tag == "div" and any(isinstance(x, Node) and x.tag in HEADINGS for x in node.parts)
    return titled and not node.slug <= PAGE_PARTS


def _restore_chapters(root: Node, nodes: list[Node]) -> None:
    """Chapters below the chosen nodes are not dropped."""
    found, stack = False, list(nodes)
    while stack:
        node = stack.pop()
        if node.dropped and _is_chapter(node):
            node.dropped, found = False, True
        if not node.dropped:
            stack += [x for x in node.parts if isinstance(x, Node)]
    if found:
        _drop_headers(_measure(root))


def main_nodes(root: Node) -> list[Node]:
    """The best container and its siblings that belong to it, in page order."""
    _restore_wrappers(root)
    _drop_headers(_measure(root))
    order = _measure(root)
    scored: list[Node] = []
    for node in order:
        if node.tag not in SCORED and not (node.tag in CONTAINERS and not any(isinstance(x, Node) and x.tag in BLOCKS for x in node.parts)):
            continue
        text = " ".join(_own_text(node).split())
        if not text:
            continue
        points = min(len(text) / 25.0, 1.0) + text.count(",") + min(len(text) / 100.0, 3.0)
        above, level = node.parent, 0
        while above is not None and level < 5:
            above.score += points / (1, 2, 6, 9, 12)[level]
            above, level = above.parent, level + 1
    scored = [n for n in order if n.score > 0 and n.length and n.tag not in ("#root", "html") and (n.tag in BLOCKS or n.tag == "body")]
    if not scored:
        return [root] if root.length else []
    points = {id(n): n.score * (1.0 - _density(n)) for n in scored}
    best = max(scored, key=lambda n: points[id(n)])
    while best.parent is not None and id(best.parent) in points and best.parent.tag != "body":
        if not any(isinstance(x, Node) and x is not best and points.get(id(x), 0.0) >= ALIKE * points[id(best)] for x in best.parent.parts):
            break
        best = best.parent
    if best.parent is None:
        return [best]
    bar = BAR * points[id(best)]
    siblings = [x for x in best.parent.parts if isinstance(x, Node)]
    out: list[Node] = []  # in reverse
    between: list[Node] | None = None  # short blocks before something that is kept; they stay if a heading or something kept precedes them
    for x in reversed(siblings):
        if x.tag in HEADINGS and (not x.dropped or x.slug):
            if between is not None:
                out += [*between, x]
                between = []
            continue
        if x.dropped:
            between = None if x.tag == "nav" else between
            continue
        alike = x.tag == best.tag and x.names and x.names == best.names
        reads = x.tag == "p" and x.length > 80 and _density(x) < 0.25
        has = points.get(id(x), 0.0)
        if x is best or reads or best.tag != "body" and has > 0 and has + (bar if alike else 0.0) >= bar:
            out += [*(between or ()), x]
            between = []
        elif x.tag in BLOCKS and x.length:
            between = [*between, x] if between is not None and _density(x) < 0.25 else None
    out.reverse()
    _restore_chapters(root, out)
    return out


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below the nodes: references decoded, white space as one space, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list[str | Node | None] = list(reversed(nodes))  # None: a block ends
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif not x.dropped:
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack += reversed(x.parts)
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text of a whole page, a line for each block; empty if there is none."""
    return "\n".join(_blocks(main_nodes(parse(page)))) if page else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, in one pass without a shuffle.

    Null and empty pages, and pages without text, give an empty text; repeated rows give repeated results; other
    columns are ignored.
    """

    def run(rows: dict) -> list:
        texts = [extract(h) for h in rows["html"]]
        return [rows["page_id"], rows["url"], texts, [len(t) for t in texts]]

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return map_rows(source, "page_id long, url string, text string, n_chars long", run)

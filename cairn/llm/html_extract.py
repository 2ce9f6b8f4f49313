"""Main text of HTML pages by composite text density (after Sun, Song and Liao, 2011).

A page becomes a DOM tree. For every node: C characters and T tags in its subtree, LC and LT of them in
links. Its density is characters per tag, adjusted by a logarithm for how much of it is links, against
what the body has. A node's score is the sum of its children's densities; the subtree with the largest
score is the core. The threshold is KEEP times the smallest density on the path from the core up to the
body, as the page stands, with its furniture; subtrees beside the path must reach it to be kept. (A node's
density is an average of what is in it, so with KEEP = 1 every second part of a plain article would go.)
A run of text and inline elements between blocks counts as a subtree, a heading stays with what it heads,
and prose (paragraphs, lists, quotations) inside the core's article or beside a core that is itself prose
stays unless it is links.

What is no content before densities count: scripts, styles, controls and hidden elements always; and
suspects: nav, header, footer, aside, form, and elements whose role or whole class or id names furniture
(``cookie-notice``, ``ad``; but ``has-sidebar`` or ``no-sidebar`` says something of another element). A
suspect is content nevertheless if beside it hardly anything stands outside suspects (a tenth of it; for
comments, nav, footer and aside 3 in 100), if it has an article, a main part or a first heading and half
of the body's characters outside links (none of these four), or if it is also named as content (``post``,
``content``) and at most half of it is links. Names of headings say nothing, and inside an article an id says
nothing of an element with a heading and prose that is not mostly links (its id is an anchor), but for the ids
that reader comments have.

Defined cases: null and empty pages give an empty text; pages cut off anywhere are parsed as far as they
go (an unfinished tag is dropped); a page without tags is text as a whole; repeated rows stay; further
columns of the input are not read. Texts of any length are taken whole, on an explicit stack.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_token = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""",
    re.S,
)
# HTML's element classes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes title textarea noscript template".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body head html option td th tr tbody thead tfoot title legend".split())
_CLOSES = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "body": ("head", "title")}
_SCOPE = frozenset("table ul ol dl select html body article section div main button object".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NEVER = frozenset("script style noscript template iframe object embed svg canvas button select textarea input title head link meta audio video map".split())
_ASIDE = frozenset("nav footer aside".split())
_SUSPECT = frozenset("header form dialog menu".split())
_PROSE = frozenset("p blockquote pre ul ol dl table figure #run".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
# Words of class names that stand for furniture, for reader comments and for content, and words that deny what follows.
_FURNITURE = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banners?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|widgets?|header|footer|masthead|topbar|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modal|overlay|newsletters?|subscri\w+|signup|login|share|sharing|social|related|recommend\w*|toolbar|pagination|pager|copyright|disclaimer|skip|search|hidden"
)
_COMMENTS = re.compile(r"comments?|respond|repl(?:y|ies)|discussions?|disqus")
_READERS = re.compile(r"comments?|respond|replies|disqus(?:_thread)?", re.I)  # ids that stand for reader comments, not for a heading's words
_CONTENT = frozenset("post article entry content story hentry page site main".split())
_DENIAL = frozenset("has no with without is not".split())
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
_attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Node:
    __slots__ = ("tag", "parent", "parts", "noise", "anchor", "chars", "tags", "link_chars", "link_tags", "density", "score", "whole", "main")

    def __init__(self, tag: str, parent: Node | None, noise: float, anchor: bool = False):
        """noise: the share of the body's characters above which the node is content all the same; 0 for content, 2 for never.

        anchor: only an id inside an article speaks against it.
        """
        self.tag, self.parent, self.noise, self.anchor = tag, parent, noise, anchor
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.score = 0.0
        self.whole = (0, 0, 0, 0)  # characters, tags, link characters and link tags with suspects
        self.main = False  # whether an article, a main part or a first heading is in it


MAYBE, HARDLY, NEVER, NAMED = 0.9, 0.97, 2.0, -1.0
KEEP = 0.5


@functools.lru_cache(maxsize=20_000)
def name_noise(value: str) -> float:
    """What a class or id attribute says: 0, MAYBE, HARDLY, or NAMED if it also names content."""
    found, content = 0.0, False
    for name in value.split():
        words = [w.lower() for w in _words.findall(name.replace("side-bar", "sidebar").replace("pop-up", "popup").replace("sign-up", "signup").replace("top-bar", "topbar"))]
        if not words or words[0] in _DENIAL:
            continue
        content = content or len(words) == 1 and words[0] in _CONTENT
        ends = {words[0], words[-1]}  # what a compound is, or is of
        if any(map(_COMMENTS.fullmatch, ends)):
            found = HARDLY
        elif any(map(_FURNITURE.fullmatch, ends)):
            found = max(found, MAYBE)
    return NAMED if found and content else found


def _noise(tag: str, attributes: str, inside_article: bool) -> tuple[float, bool]:
    """What speaks against an element, and whether that is only an id inside an article.

    Ids and classes of headings say nothing: they are mostly made from the heading's own words.
    """
    if tag in _NEVER:
        return NEVER, False
    worst = HARDLY if tag in _ASIDE else MAYBE if tag in _SUSPECT and not (tag == "header" and inside_article) else 0.0
    if not attributes or tag in ("html", "body", "main"):
        return worst, False
    by_id = 0.0
    for name, value in _attribute.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return NEVER, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return NEVER, False
        if name == "role" and value.lower() in _ROLES:
            worst = max(worst, MAYBE)
        if name in ("class", "id") and tag not in _HEADINGS:
            value = unescape(value)
            said = name_noise(value)
            if name == "id" and inside_article and said > 0 and not _READERS.fullmatch(value.strip()):
                by_id = max(by_id, said)
            else:
                worst = said if said == NAMED and not worst else max(worst, said)
    return (by_id, True) if by_id and not worst else (max(worst, by_id), False)


def parse(page: str) -> Node:
    """A tree with the end tags that HTML lets writers leave out. Places of open elements are kept by tag, so no step walks the stack."""
    root = Node("#root", None, 0.0)
    stack, places, scopes, at, size = [root], {}, [0], 0, len(page)

    def close(place: int) -> None:
        while len(stack) > place:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in _SCOPE:
                scopes.pop()

    while at < size:
        found = _token.search(page, at)
        end = found.start() if found else size
        if end > at:
            stack[-1].parts.append(page[at:end])
        if not found:
            break
        at = found.end()
        closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        tag = name.lower()
        if closing:
            if places.get(tag):
                close(places[tag][-1])
            continue
        ends = _CLOSES.get(tag, ())
        if tag in _CLOSES_P:
            ends = (*ends, "p")
        # The outermost of these that is open inside the last scope, with all that is open in it.
        inner = [held[k] for e in ends if (held := places.get(e)) and (k := bisect_right(held, scopes[-1])) < len(held)]
        if inner:
            close(min(inner))
        node = Node(tag, stack[-1], *_noise(tag, attributes, bool(places.get("article"))))
        stack[-1].parts.append(node)
        if tag in _VOID:
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        if attributes.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _SCOPE:
            scopes.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


def _walk(root: Node) -> list[Node]:
    """Content nodes, parents before children."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in reversed(node.parts) if type(x) is Node and not x.noise)
    return order


def judge_suspects(root: Node) -> Node:
    """Count each node as the page stands; leave noise at 0 for content and above 0 for what is none. The body."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.parts if type(x) is Node and x.noise < NEVER)
    for node in reversed(order):
        inner = [x for x in node.parts if type(x) is Node and x.noise < NEVER]
        chars = sum(len("".join(x.split())) for x in node.parts if type(x) is str) + sum(x.whole[0] for x in inner)
        links = chars if node.tag == "a" else sum(x.whole[2] for x in inner)
        node.whole = (chars, len(inner) + sum(x.whole[1] for x in inner), links, sum(x.whole[3] + (x.tag == "a") for x in inner))
        node.main = node.tag in ("article", "main", "h1") or any(x.main for x in inner)
    body = next((n for n in order if n.tag == "body"), root)
    plain = lambda n: n.whole[0] - n.whole[2]
    suspects, todo = 0, [body]
    while todo:
        for x in todo.pop().parts:
            if type(x) is Node and x.noise < NEVER:
                if x.noise > 0:
                    suspects += plain(x)
                else:
                    todo.append(x)
    for node in order:
        if node.anchor and 2 * node.whole[2] <= node.whole[0] and _is_section(node):
            node.noise = 0.0
        if node.noise == NAMED:
            node.noise = float(2 * node.whole[2] > node.whole[0])
    for node in sorted((n for n in order if 0 < n.noise < NEVER), key=plain, reverse=True):
        alone = plain(node) > node.noise * (plain(body) - suspects + plain(node))
        if alone or node.noise == MAYBE and node.main and 2 * plain(node) > plain(body):
            node.noise = 0.0
            suspects -= plain(node)  # what is inside or beside it is now judged against it
    return body


def _is_section(node: Node) -> bool:
    """Whether it has a heading of its own and prose, so that its id is an anchor."""
    tags = {x.tag for x in node.parts if type(x) is Node}
    inner = {y.tag for x in node.parts if type(x) is Node and x.tag in ("div", "header", "hgroup") for y in x.parts if type(y) is Node}
    prose = not tags.isdisjoint(_PROSE) or not inner.isdisjoint(_PROSE) or any(type(x) is str and not x.isspace() for x in node.parts)
    return prose and not _HEADINGS.isdisjoint(tags | inner)


def wrap_runs(root: Node) -> None:
    """Make a node of each run of text and inline elements that stands between blocks."""
    for node in _walk(root):
        inline = lambda x: type(x) is str or x.tag not in _BLOCK
        if all(map(inline, node.parts)) or not any(map(inline, node.parts)):
            continue
        parts: list[Node | str] = []
        for is_run, run in itertools.groupby(node.parts, inline):
            run = list(run)
            if is_run and any(type(x) is Node and not x.noise or type(x) is str and not x.isspace() for x in run):
                made = Node("#run", node, 0.0)
                made.parts = run
                for x in run:
                    if type(x) is Node:
                        x.parent = made
                parts.append(made)
            else:
                parts.extend(run)
        node.parts = parts


def measure(root: Node) -> list[Node]:
    """Counts, densities and scores of the content nodes."""
    order = _walk(root)
    for node in reversed(order):
        for part in node.parts:
            if type(part) is str:
                node.chars += len("".join(part.split()))
            elif not part.noise:
                node.chars += part.chars
                node.tags += part.tags + (part.tag != "#run")
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = next((n for n in order if n.tag == "body"), root)
    for node in order:
        if not node.chars:
            continue
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, body.chars, body.link_chars)
        if node.parent is not None:
            node.parent.score += node.density
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_chars: int, body_link_chars: int) -> float:
    """Composite text density; counts of tags and of links are one at least."""
    if not chars or link_chars and chars <= link_chars:
        return 0.0
    tags, links, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_link_chars / max(1, body_chars) * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / links * tags / link_tags) + 1e-9) / base


def _above(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def select(root: Node) -> list[Node]:
    """The subtrees that are content, in page order."""
    body = judge_suspects(root)
    wrap_runs(root)
    order = measure(root)
    core = max(order, key=lambda n: n.score)
    if core.score <= 0:
        return [root]
    path = []
    for node in _above(core):
        path.append(node)
        if node is body:
            break
    threshold = KEEP * min(density(*n.whole, body.whole[0], body.whole[2]) for n in path if n.tag != "#run")
    chosen, on_path = {id(core)}, set(map(id, path))
    articles = [k for k, n in enumerate(path) if n.tag == "article"]
    for k, up in enumerate(path[1:], 1):
        prose = path[k - 1].tag in _PROSE or articles and k <= articles[-1]
        kept = False  # whether what follows is kept: its heading then stays too
        for node in reversed([x for x in up.parts if type(x) is Node and not x.noise]):
            if id(node) in on_path:
                kept = True
            elif node.chars:
                kept = node.density >= threshold or kept and node.tag in _HEADINGS or prose and node.tag in _PROSE and 2 * node.link_chars < node.chars
                if kept:
                    chosen.add(id(node))
    return [n for n in order if id(n) in chosen]


def blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks, white space made one space, without empty ones."""
    line: list[str] = []
    todo: list[Node | str | None] = [node]
    while todo:
        part = todo.pop()
        if type(part) is str:
            line.append(unescape(part))
            continue
        if part is None or part.tag in _BLOCK:  # a border of a block
            if text := " ".join("".join(line).split()):
                yield text
            line = []
        if part is None or part.noise and part is not node:
            continue
        if part.tag == "br":
            line.append(" ")
        if part.tag in _BLOCK:
            todo.append(None)
        todo.extend(reversed(part.parts))
    if text := " ".join("".join(line).split()):
        yield text


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return " ".join(text for node in select(parse(page)) for text in blocks(node))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(page) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [f"{name} {narrow.schema[name].dataType.simpleString()}" for name in ("page_id", "url")]
    return narrow.mapInArrow(work, f"{', '.join(kinds)}, text string, n_chars long")

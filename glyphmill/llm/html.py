"""HTML extraction by tree scoring.

A tolerant parser builds the element tree and cuts the text into blocks (runs of
text between block-level boundaries). Boilerplate subtrees - menus, headers and
footers of the page, sidebars, notices, adverts, forms, reader comments, scripts
and styles - carry no text. Every block then passes points to its ancestors: one,
plus one for each comma, plus one for each hundred characters up to three; the
nearest container gets them whole, the next a half, further ones a third of their
distance less. A container's points are discounted by its link density. The best
container is kept together with those of its siblings that read like text; their
blocks, in page order, are the main text. If the best container stands within an
``article``, or else a ``main``, all of that is kept, short sections too.

Only void elements, and those of drawings and formulas, close themselves by a slash.

Defined cases: null or empty html gives an empty text; unclosed elements are
closed where the next block or their parent ends; a tag that the end of the page
cuts off is dropped; a page whose text is all boilerplate gives an empty text.
Repeated rows give repeated rows; a page of any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose descendants may close themselves.
FOREIGN = frozenset("svg math".split())
#: Blocks that hold running text; their parent is the container they pass points to.
PARAGRAPH = frozenset("p pre h1 h2 h3 h4 h5 h6 li dt dd td th blockquote figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold main text.
PRUNED = frozenset("nav aside footer form button select script style noscript template textarea title head svg math canvas iframe object embed noembed noframes audio video dialog menu fieldset".split())
PRUNED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or id that mark boilerplate.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|sponsor\w*|promo\w*|banner|side-?bar|menu\w*|nav|navbar|navigation|breadcrumbs?|header|masthead|foot|footer|footnav|"
    r"comments?|comment-?list|commentlist|disqus|replies|reply|respond|discussion|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|subscribe|subscription|newsletter|signup|login|search|"
    r"share|sharing|social|related|recommend\w*|widget|widgets|toolbar|pagination|pager|skip|copyright|disclaimer|rail|teaser|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
#: Class words that only say how a page is laid out, and the header of an article itself.
LAYOUT = re.compile(r"(?<![\w-])(?:(?:has|with|no|without|is|show|hide)[_-][\w-]+|(?:entry|post|article|story|content|title)[_-]+header)(?![\w-])", re.I)
#: Words that mark reader comments, on any element.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|commentlist|disqus|replies|reply|respond)(?:$|[\s_-])", re.I)
#: Words of a class or id that mark main text.
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|hentry|main|page|post|story|text|blog)(?:$|[\s_-])", re.I)
#: A start of one of these closes an open element of the set.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: The search for such an open element stops at these.
SCOPE = frozenset("table ul ol dl select body html article section div main td th".split())

RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}
#: A slash that ends a tag, not an unquoted value.
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
TAG = re.compile(r"<(?:(?P<comment>!--)|(?P<odd>[!?])|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*))")
ATTRIBUTES_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


class _Tree:
    """Elements in page order, and the blocks of text between them."""

    def __init__(self) -> None:
        self.tags, self.parents, self.pruned, self.weights, self.linked = ["#page"], [-1], [False], [0], [False]
        self.weighted, self.block, self.foreign = [False], [0], [False]  # of the element or one around it; the nearest block
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters in links)
        self._parts: list[str] = []
        self._links: list[str] = []

    def open(self, tag: str, attributes: str, parent: int) -> int:
        pruned, weight = self.pruned[parent] or tag in PRUNED, 25 if tag in ("article", "main") else 0
        if attributes and not pruned:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}".strip()
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
            pruned = hidden or found.get("role", "").lower() in PRUNED_ROLES
            if names and not pruned and tag not in ("html", "body"):
                pruned = bool((COMMENTS if tag in ("article", "main") else BOILERPLATE).search(LAYOUT.sub("", names)))
            if (names and CONTENT.search(names)) or found.get("role") == "main" or found.get("itemprop") == "articleBody":
                weight = max(weight, 25)
        if tag == "header" and not pruned:  # the page's header; an article's own header holds its title
            pruned = not self.weighted[parent]
        self.tags.append(tag)
        self.parents.append(parent)
        self.pruned.append(pruned)
        self.weights.append(weight)
        self.linked.append(self.linked[parent] or tag == "a" and "href" in attributes.lower())
        self.weighted.append(self.weighted[parent] or weight > 0)
        self.block.append(len(self.tags) - 1 if tag in BLOCK else self.block[parent])
        self.foreign.append(self.foreign[parent] or tag in FOREIGN)
        return len(self.tags) - 1

    def text(self, at: int, raw: str) -> None:
        if not self.pruned[at]:
            value = unescape(raw) if "&" in raw else raw
            self._parts.append(value)
            if self.linked[at]:
                self._links.append(value)

    def cut(self, at: int) -> None:
        """End the current block, whose text stands in element ``at``."""
        if self._parts:
            if text := " ".join("".join(self._parts).split()):
                self.blocks.append((self.block[at], text, len(" ".join("".join(self._links).split()))))
            self._parts, self._links = [], []


def parse(html: str) -> _Tree:
    """The tree of a page, however broken."""
    tree, at, stack, size = _Tree(), 0, [0], len(html)
    depths: dict[str, list[int]] = {}  # of the open elements, by name

    def deepest(names: Iterable[str]) -> int:
        """The depth of the last open element of these names; 0 if there is none."""
        return max((d[-1] for name in names if (d := depths.get(name))), default=0)

    def shut(depth: int) -> None:
        """Close all elements from ``depth`` of the stack on."""
        if any(tree.tags[e] in BLOCK for e in stack[depth:]):
            tree.cut(stack[-1])
        for e in stack[depth:]:
            depths[tree.tags[e]].pop()
        del stack[depth:]

    while at < size:
        m = TAG.search(html, at)
        if not m:
            tree.text(stack[-1], html[at:])
            break
        if m.start() > at:
            tree.text(stack[-1], html[at : m.start()])
        if m["comment"]:
            end = html.find("-->", m.end() - 2)
            at = size if end < 0 else end + 3
            continue
        if m["odd"]:
            end = html.find(">", m.end())
            at = size if end < 0 else end + 1
            continue
        tag = m["name"].lower()
        rest = ATTRIBUTES_END.match(html, m.end())
        if rest is None:  # an open quote or a tag that the page's end cuts off
            end = html.find(">", m.end())
            if end < 0:
                break
            attributes, at = html[m.end() : end], end + 1
        else:
            attributes, at = html[m.end() : rest.end() - 1], rest.end()
        if m["end"]:
            depth = deepest((tag,))
            # An inline end tag does not close blocks; elements are numbered as they open.
            if depth and (tag in BLOCK or tree.block[stack[-1]] < stack[depth]):
                shut(depth)
            elif tag == "br":
                tree.text(stack[-1], " ")
            continue
        if tag in BLOCK:
            if tag not in ("html", "head"):
                ends = deepest(("p", *CLOSES.get(tag, ()), *(HEADINGS if tag in HEADINGS else ())))
                if ends and ends >= deepest(SCOPE):
                    shut(ends)
            if tag == "body" and depths.get("head"):
                shut(depths["head"][0])
            tree.cut(stack[-1])
        elif tag == "br":
            tree.text(stack[-1], " ")
        if tag in VOID or (tag in FOREIGN or tree.foreign[stack[-1]]) and SELF_CLOSED.search(attributes):
            continue
        element = tree.open(tag, attributes, stack[-1])
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            if end is None:
                break
            at = end.start()
        depths.setdefault(tag, []).append(len(stack))
        stack.append(element)
    tree.cut(stack[-1])
    return tree


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by a newline."""
    if not html:
        return ""
    tree = parse(html)
    if not tree.blocks:
        return ""
    n = len(tree.tags)
    points, length, links = [0.0] * n, [0] * n, [0] * n
    for element, text, linked in tree.blocks:
        gain = 1 + text.count(",") + min(len(text) / 100, 3.0)
        up, level = tree.parents[element] if tree.tags[element] in PARAGRAPH else element, 0
        while up >= 0 and level < 5:
            points[up] += gain / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = tree.parents[up], level + 1
        length[element] += len(text)
        links[element] += linked
    for element in range(n - 1, 0, -1):  # children come after their parents
        length[tree.parents[element]] += length[element]
        links[tree.parents[element]] += links[element]
    density = [links[e] / length[e] if length[e] else 1.0 for e in range(n)]
    score = [(points[e] + tree.weights[e]) * (1 - density[e]) if points[e] else -1.0 for e in range(n)]
    best = max(range(n), key=lambda e: (score[e], -e))
    around = [best]
    while around[-1] > 0:
        around.append(tree.parents[around[-1]])
    for whole in ("article", "main"):
        if (outer := next((e for e in around if tree.tags[e] == whole), None)) is not None:
            best = outer
            break
    chosen = {best}
    enough = max(10.0, 0.2 * score[best])
    prose = {tree.parents[e] if tree.tags[e] in PARAGRAPH else e for e, _, _ in tree.blocks}
    for e in range(1, n):
        if e != best and tree.parents[e] == tree.parents[best] and length[e]:
            bonus = tree.weights[e] * (1 - density[e]) if tree.tags[e] == tree.tags[best] == "article" else 0  # another article must earn its place
            if score[e] - bonus >= enough or tree.tags[e] in HEADINGS and density[e] < 0.5:
                chosen.add(e)
            elif tree.tags[e] == "p" and (density[e] < 0.25 and length[e] > 80 or density[e] == 0 and best in prose):
                chosen.add(e)
    kept = [False] * n
    for e in range(n):
        kept[e] = e in chosen or (e > 0 and kept[tree.parents[e]])
    return "\n".join(text for element, text, _ in tree.blocks if kept[element])


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """Add the main text of each page to ``pages``; a map over rows without any exchange."""

    @F.arrow_udf("string")
    def extracted(column: pa.Array) -> pa.Array:
        release()
        return pa.array((main_text(x.as_py()) for x in column), pa.string())

    return pages.withColumn(into, extracted(F.col(html)))

"""Main text of a page by composite text density.

A page becomes a tree; what is never article text (scripts, menus, page headers and so
on, told by tag) is left out with all below it. Forms, and nodes whose role or a word of whose class or
id names an advert, a sidebar, readers' comments or the like, are in doubt: comments are left out, and
so are the others where enough text stands outside them (see :func:`without_doubtful`); a word that
is denied or only mentioned, as in has-sidebar or comments-open, does not count. Of an article's
own header the headings are text. Every node then has a density: characters per tag,
adjusted by the share of linked characters,

    C/T * log(C/LC * T/LT) to the base ln(C/(C-LC) * LC + LCb/Cb * C + e)

with C characters and T tags in the node, LC and LT those in links, and Cb and
LCb those of the body; a zero divisor counts as one. The node with the largest sum of
its children's densities is the content. The least density on the way from
it to the body is the threshold: every node that reaches it adds its own
subtree with the largest sum. An ``article`` or ``main`` that holds a chosen node is
taken whole, so is what surrounds a chosen list or table, and headings beside a
chosen node or what holds it are added, since parts of an article are not left out
for being short.

Character references are decoded, white space becomes single spaces, blocks
are joined in page order by one space. A null or empty page, or one without
text, gives an empty text. Unclosed tags end with their parent. Equal pages give
equal texts; other columns are carried along.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser
from math import e, log

from pyspark.sql import DataFrame

from tidewheel.llm.common import append

# Names of HTML elements, and words of class, id and role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set(
    "aside button canvas datalist dialog footer head header iframe map menu nav noscript object "
    "script select style svg template textarea title video audio".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
TEXT_BLOCKS = set("p h1 h2 h3 h4 h5 h6 pre blockquote dt dd li figcaption caption address".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
LISTS = set("ul ol dl table tbody thead tfoot tr td th figure blockquote".split())
UNWANTED = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted related replies reply respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
COMMENTS = set("comment comments disqus replies reply respond".split())
#: Words beside which a word of a class or id says what a page has, not what the node is.
MENTIONS = set("closed disabled enabled has hide no off on open opened show with without".split())
#: Least share of a page's text outside links that doubtful nodes must leave to be left out.
LEFT = 0.1
ROLES = set("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"},
}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
WORD = re.compile(r"[A-Za-z]+")


def unwanted(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in NEVER:
        return True
    if tag in ("html", "body", "main"):
        return False
    return any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs)


def doubtful(tag: str, attrs: list[tuple[str, str | None]]) -> set[str]:
    """Words that speak against a node, those of names that only mention something left aside."""
    if tag in ("html", "body", "main"):
        return set()
    barred = COMMENTS if tag == "article" else UNWANTED
    found = {"form"} if tag == "form" else set()
    for name, value in attrs:
        if name in ("class", "id"):
            for token in (value or "").lower().split():
                words = set(WORD.findall(token))
                if not words & MENTIONS:
                    found |= words & barred
        elif name == "role" and (value or "").lower() in ROLES:
            found.add("role")
    return found


class Page(HTMLParser):
    """Nodes in page order: tag, parent and last node below; and the texts with their nodes."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.last = ["#root"], [0], [0]
        self.texts: list[tuple[int, str]] = []
        self.open = [0]
        self.closed_off = 0  # open nodes that are left out
        self.left_out: dict[int, str] = {}  # their tags; they have negative numbers
        self.doubts: dict[int, set[str]] = {}
        # Places among the open nodes: of each tag, of blocks, and of blocks but paragraphs.
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks, self.walls = [0], [0]
        self.feed(html)
        self.close()
        while len(self.open) > 1:
            self._pop()
        self.last[0] = len(self.tags) - 1

    def _pop(self) -> None:
        node = self.open.pop()
        self.places[self._tag(node)].pop()
        for stack in (self.blocks, self.walls):
            if stack[-1] == len(self.open):
                stack.pop()
        if node < 0:
            self.closed_off -= 1
        else:
            self.last[node] = len(self.tags) - 1

    def _push(self, node: int) -> None:
        tag = self._tag(node)
        self.places[tag].append(len(self.open))
        if tag not in INLINE:
            self.blocks.append(len(self.open))
            if tag != "p":
                self.walls.append(len(self.open))
        self.open.append(node)

    def _tag(self, node: int) -> str:
        return self.tags[node] if node >= 0 else self.left_out[node]

    def _nearest(self, tags) -> int:
        """The place of the innermost open node of these tags, or 0."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end_implied(tag)
        # An article's header is looked into for its headings.
        own = tag == "header" and not self.closed_off and self.places["article"]
        if self.closed_off or (unwanted(tag, attrs) and not own):
            if tag not in VOID:
                self.left_out[-len(self.open)] = tag
                self._push(-len(self.open))
                self.closed_off += 1
            return
        if tag == "br" or tag in VOID:
            self._add(tag)
            self.last[-1] = len(self.tags) - 1
            return
        self._push(self._add(tag))
        doubts = doubtful(tag, attrs)
        if doubts and not own:
            self.doubts[self.open[-1]] = doubts

    def _add(self, tag: str) -> int:
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.last.append(0)
        if tag not in INLINE:
            self.texts.append((self.open[-1], " "))
        return len(self.tags) - 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _close_at(self, at: int) -> None:
        while len(self.open) > at:
            self._pop()

    def _end_implied(self, tag: str) -> None:
        """A block ends an open paragraph; list items and cells end their like."""
        if tag in CLOSES:
            at = self._nearest(CLOSES[tag])
            if at > self._nearest(SCOPES.get(tag, ())):
                self._close_at(at)
        elif tag not in INLINE and tag not in VOID and tag not in ("script", "style"):
            if self._tag(self.open[self.blocks[-1]]) == "p":
                self._close_at(self.blocks[-1])

    def handle_endtag(self, tag: str) -> None:
        at = self._nearest((tag,))
        # An inline end does not reach out of a block; an end without a start is nothing.
        if not at or (tag in INLINE and self.walls[-1] > at):
            return
        while len(self.open) > at:
            node = self.open[-1]
            self._pop()
            if node > 0 and self.tags[node] not in INLINE:
                self.texts.append((self.open[-1] if self.open[-1] >= 0 else node, " "))

    def handle_data(self, data: str) -> None:
        if not self.closed_off:
            self.texts.append((self.open[-1], data))


def densities(page: Page, body: int) -> list[float]:
    n = len(page.tags)
    chars, links = [0] * n, [0] * n
    tags, link_tags = [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[page.parents[i]] or page.tags[i] == "a"
    for node, text in page.texts:
        size = len(text.strip())
        chars[node] += size
        if linked[node]:
            links[node] += size
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (page.tags[i] == "a")
    share = links[body] / (chars[body] or 1)
    out = []
    for c, lc, t, lt in zip(chars, links, tags, link_tags):
        if not c:
            out.append(0.0)
            continue
        base = log(c / ((c - lc) or 1) * lc + share * c + e)
        inside = c / (lc or 1) * (t or 1) / (lt or 1)
        out.append(max(0.0, c / (t or 1) * log(inside) / log(base)) if base > 1 else c / (t or 1) * log(inside))
    return out


def densest(page: Page) -> tuple[int, list[float], list[float], int]:
    """The body, all densities, the sums of the children's densities, and the node with the largest sum."""
    n = len(page.tags)
    body = next((i for i in range(n) if page.tags[i] == "body"), 0)
    density = densities(page, body)
    sums = [0.0] * n
    for i in range(1, n):
        sums[page.parents[i]] += density[i]
    holder = [t not in INLINE and t not in TEXT_BLOCKS for t in page.tags]
    best = max((i for i in range(body, page.last[body] + 1) if holder[i]), key=lambda i: (sums[i], -i), default=body)
    return body, density, sums, best


def without(page: Page, nodes: set[int]) -> Page:
    """The page without these nodes and all below them."""
    if not nodes:
        return page
    out = Page("")
    number = {0: 0}
    for i in range(1, len(page.tags)):
        p = number.get(page.parents[i])
        if p is not None and i not in nodes:
            number[i] = len(out.tags)
            out.tags.append(page.tags[i])
            out.parents.append(p)
    out.last = list(range(len(out.tags)))
    for i in range(len(out.tags) - 1, 0, -1):
        p = out.parents[i]
        out.last[p] = max(out.last[p], out.last[i])
    out.texts = [(number[i], t) for i, t in page.texts if i in number]
    out.doubts = {number[i]: d for i, d in page.doubts.items() if i in number}
    return out


def own_text(page: Page) -> int:
    """Characters outside links."""
    linked = [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        linked[i] = linked[page.parents[i]] or page.tags[i] == "a"
    return sum(len(t.strip()) for i, t in page.texts if not linked[i])


def with_headings_only(page: Page) -> Page:
    """The page with the headings of articles' headers, and without what else these hold."""
    inside = [0] * len(page.tags)  # 1 in a header, 2 in a heading of one
    for i in range(1, len(page.tags)):
        inside[i] = inside[page.parents[i]] or int(page.tags[i] == "header")
        if inside[i] and page.tags[i] in HEADINGS:
            inside[i] = 2
    if any(inside):
        page.texts = [(i, " " if inside[i] == 1 else t) for i, t in page.texts]
    return page


def without_doubtful(page: Page) -> Page:
    """The page without its doubtful nodes, except those that the page's text is in.

    A node stays that holds an ``article`` or ``main``, if no other stands outside all doubtful
    nodes. First comments go. Then all other doubtful nodes go, if they leave the share ``LEFT`` of
    the text outside links; if not, nodes stay that hold the node with the largest
    sum of densities, or most of the text. If no text would be left, all nodes stay.
    """
    if not page.doubts:
        return page
    doubted = [0] * len(page.tags)  # doubtful nodes from the root to each node
    for i in range(1, len(page.tags)):
        doubted[i] = doubted[page.parents[i]] + (i in page.doubts)
    marks = [i for i, t in enumerate(page.tags) if t in ("article", "main") and i not in page.doubts]
    held = set()
    if not any(doubted[i] == 0 for i in marks):
        for i in marks:
            i = page.parents[i]
            while i and i not in held:
                held.add(i)
                i = page.parents[i]
    for i in held:
        page.doubts.pop(i, None)
    rest = without(page, {i for i, d in page.doubts.items() if d & COMMENTS})
    if rest.doubts:
        clear = without(rest, set(rest.doubts))
        if own_text(clear) > LEFT * own_text(rest):
            rest = clear
        else:
            best = densest(rest)[3]
            chars = [0] * len(rest.tags)
            for i, text in rest.texts:
                chars[i] += len(text.strip())
            for i in range(len(chars) - 1, 0, -1):
                chars[rest.parents[i]] += chars[i]
            rest = without(
                rest, {i for i in rest.doubts if not i <= best <= rest.last[i] and 2 * chars[i] <= chars[0]}
            )
    return rest if any(t.strip() for _, t in rest.texts) else page


def main_text(html: str) -> str:
    if not html:
        return ""
    page = without_doubtful(with_headings_only(Page(html)))
    n = len(page.tags)
    body, density, sums, best = densest(page)
    threshold, at = density[best], best
    while at != body:
        at = page.parents[at]
        threshold = min(threshold, density[at])
    # The node with the largest sum at or below each node, from the leaves up.
    top = list(range(n))
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        if (sums[top[i]], -top[i]) > (sums[top[p]], -top[p]):
            top[p] = top[i]
    chosen = {best} | {top[i] for i in range(body, page.last[body] + 1) if density[i] >= threshold and density[i] > 0}
    whole = set()
    for i in chosen:
        up, outer = i, i
        while up != body and up != 0:
            if page.tags[up] in ("article", "main"):
                outer = up
            up = page.parents[up]
        if outer == i:
            while page.tags[outer] in LISTS and outer != body:
                outer = page.parents[outer]
        whole.add(outer)
    # Headings beside what is chosen, or beside what holds it, belong to it.
    beside = set()
    for i in whole:
        while i != body and i != 0:
            i = page.parents[i]
            beside.add(i)
    whole |= {i for i in range(1, n) if page.tags[i] in HEADINGS and page.parents[i] in beside}
    taken = bytearray(n)
    for i in sorted(whole):
        if not taken[i]:
            taken[i : page.last[i] + 1] = b"\x01" * (page.last[i] + 1 - i)
    # A separator that stands between two chosen nodes is always kept.
    return " ".join("".join(t if taken[i] else " " for i, t in page.texts).split())


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds ``text``, the main text of ``html``."""

    def make():
        return lambda column: [[main_text(x) for x in column.to_pylist()]]

    return append(pages, make, [html], f"`{text}` string")

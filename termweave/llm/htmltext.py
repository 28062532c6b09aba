"""Operator 12: main text of web pages by scoring the tree of their elements.

A page is read once into elements and blocks of text, with end tags that authors leave out made up for. Menus, headers,
footers, sidebars, notices, adverts, forms, scripts and reader comments are known by their elements, roles and class
names and left out. Paragraphs pass points for their length and commas to their ancestors; an element's sum is
discounted by the share of its text that lies in links. The best element is the container (an article around it takes
its place), and those of its siblings stay that read like a part of it.

Each page is one row's work and pages never meet, so the job is one pass without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import arrow_batch, carried, carried_schema, sliced, table

# Element names of HTML, and the words by which page parts are named.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rb rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("head script style title textarea xmp iframe noembed noframes noscript template nav footer aside form button select option datalist fieldset dialog menu object applet canvas svg math audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tooltip".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense adslot advertorial sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices disclaimer alert alerts "
    "newsletter subscribe subscription signup login paywall sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond replies popup popups modal overlay widget widgets skip skiplink hidden".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words that also name the layout around an article: an element of these alone stays if the only article lies in it.
LAYOUT = frozenset("sidebar sidebars menu menus nav navbar".split())
GOOD = frozenset("article articles body blog content contents entry hentry main page post posts story text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is a paragraph of its own; text in other ones counts as a paragraph of the element itself.
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th figcaption address h1 h2 h3 h4 h5 h6".split())
TAG_POINTS = {"article": 25, "main": 15, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "dd": -3, "dl": -3, "dt": -3, "li": -3, "ol": -3, "ul": -3, "th": -5}
CLASS_POINTS, LEVELS, SHORT, SIBLING_SHARE, SIBLING_LEAST = 25, 6, 25, 0.2, 10
#: What an element closes that its author left open, up to an element that stops the search.
_LISTS, _TABLES = frozenset(("ul", "ol", "menu", "dir")), frozenset(("table",))
CLOSES = {
    "li": (frozenset(("li",)), _LISTS), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))), "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "tr": (frozenset(("tr", "td", "th")), _TABLES), "td": (frozenset(("td", "th")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tbody": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th")), _TABLES), "thead": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th")), _TABLES), "tfoot": (frozenset(("tbody", "thead", "tfoot", "tr", "td", "th")), _TABLES),
    "body": (frozenset(("head",)), frozenset()),
}
#: Elements in which an open paragraph of the outside is not closed.
KEEPS_P = frozenset("table td th caption button object applet template svg math".split())
#: Elements open at once; what is nested deeper is taken as beside its parent, as browsers do.
DEPTH = 512

NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
#: The rest of a tag: quoted values may hold ">"; possessive, so that a failure is found in one pass.
REST = re.compile(r"""(?:[^>"']++|"[^"]*"|'[^']*')*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
COMMA = re.compile("[,،、，；;]")
ENDS = re.compile(r"[.!?。！？…](?:[\"'»”’)\]]|\s)*$")


class Page:
    """Elements in page order (parent, name, points, the number after their last descendant) and blocks of text in them."""

    def __init__(self) -> None:
        self.parent, self.name, self.end, self.good, self.semantic, self.doubtful = [-1], [""], [0], [0], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of it in links

    def open(self, parent: int, name: str, good: int, semantic: bool, doubtful: bool) -> int:
        self.parent.append(parent)
        self.name.append(name)
        self.end.append(0)
        self.good.append(good)
        self.semantic.append(semantic)
        self.doubtful.append(doubtful)
        return len(self.parent) - 1


def words_of(value: str) -> set[str]:
    """The words of class names and ids: `siteHeader post-body` gives site, header, post and body."""
    return {w.lower() for part in value.split() for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])", part) if w}


def judged(name: str, attributes: str, inside: bool) -> tuple[bool, int, bool, bool]:
    """Whether an element is left out, the points of its class names, whether it is marked as an article, and whether it is left out unless the article lies in it. inside: it lies in an article."""
    if name in DROPPED and not (name == "form" and "aspnetForm" in attributes):  # that one holds a whole page
        return True, 0, False, False
    semantic = name in ("article", "main")
    if not attributes.strip(" /\t\r\n\f"):
        return name == "header" and not inside, 0, semantic, False
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    role = found.get("role", "").lower().strip()
    semantic |= role in ("article", "main") or found.get("itemprop", "").lower() == "articlebody"
    style = re.sub(r"\s", "", found.get("style", "").lower())
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return True, 0, False, False
    if role in ROLES:
        return True, 0, False, False
    words = words_of(found.get("class", "") + " " + found.get("id", ""))
    if name in ("html", "body"):
        return False, 0, False, False
    good = bool(words & GOOD)
    # `no-sidebar` and `with-menu` tell of an element beside those
    named = bool(words & PARTS) and not words & {"no", "has", "with", "without"}
    if named and words & COMMENTS and name != "main":
        return True, 0, False, False
    if named and not (semantic and (good or name != "article")):
        doubtful = not semantic and name not in INLINE and words & PARTS <= LAYOUT
        return not doubtful, CLASS_POINTS if good and doubtful else 0, False, doubtful
    if (name == "header" or "header" in words) and not inside and not semantic and not (good and name != "header"):
        return True, 0, False, False
    return False, CLASS_POINTS if good else 0, semantic, False


def read(html: str) -> Page:
    """The page's elements and blocks, in one pass over the text."""
    page = Page()
    # Open elements: (name, number in the page or that of the nearest block, left out, in a link, inside an article)
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    opened: dict[str, int] = {}
    pieces: list[str] = []
    linked = 0
    owner = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.blocks.append((owner, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def close(to: int) -> None:
        """Close open elements until `to` are left."""
        nonlocal owner
        while len(stack) > to:
            name, number, out, _, _ = stack.pop()
            opened[name] -= 1
            if name not in INLINE:
                if not out:
                    flush()
                    page.end[number] = len(page.parent)
                owner = stack[-1][1]

    def left_open(names: frozenset, stops: frozenset) -> None:
        """Close the outermost open element of these names above one that stops the search."""
        if not any(opened.get(n) for n in names):
            return
        at, found = len(stack) - 1, 0
        while at > 0 and stack[at][0] not in stops:
            if stack[at][0] in names:
                found = at
                # Only cells lie in rows and rows in their groups; other elements close one of their kind
                if len(names) < 3:
                    break
            at -= 1
        if found:
            close(found)

    def text(s: str) -> None:
        nonlocal linked
        if s and not stack[-1][2]:
            s = unescape(s) if "&" in s else s
            pieces.append(s)
            if stack[-1][3]:
                linked += len(s) - s.count(" ")

    at, size, quotes, unclosed = 0, len(html), True, set()
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        follows = html[lt + 1 : lt + 2]
        if not (follows.isascii() and (follows.isalpha() or follows in ("/", "!", "?"))) or not follows:
            text(html[at : lt + 1])
            at = lt + 1
            continue
        text(html[at:lt])
        if follows in "!?":
            end = html.find("-->", lt + 4) if html.startswith("<!--", lt) else html.find(">", lt)
            if html.startswith(("<!-->", "<!--->"), lt):
                at = html.find(">", lt) + 1
                continue
            if end < 0:
                break
            at = end + (3 if html.startswith("<!--", lt) else 1)
            continue
        closing = follows == "/"
        m = NAME.match(html, lt + 1 + closing)
        if not m:  # "</" before anything but a name is a comment
            end = html.find(">", lt)
            if end < 0:
                break
            at = end + 1
            continue
        name = m[0].lower()
        rest = REST.match(html, m.end()) if quotes else None
        if rest:
            after = rest.end()
        else:
            quotes = False  # a quote is never closed: from here on a tag ends at the next ">"
            after = html.find(">", m.end()) + 1
            if not after:
                break
        at = after
        if closing:
            if name == "br":
                pieces.append(" ")
            elif name == "p" and not opened.get("p"):
                flush()
            elif opened.get(name):
                i = len(stack) - 1
                if name in INLINE:
                    while i > 0 and stack[i][0] != name and stack[i][0] in INLINE:
                        i -= 1
                else:
                    while stack[i][0] != name:
                        i -= 1
                if stack[i][0] == name:
                    close(i)
            continue
        if name in VOID:
            if not stack[-1][2]:
                if name == "br":
                    pieces.append(" ")
                elif name == "hr":
                    flush()
            continue
        if name in RAW:
            end = None if name in unclosed else re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
            if not end:
                if name in ("script", "style", "title", "textarea"):
                    break
                unclosed.add(name)
                continue
            at = html.find(">", end.end()) + 1
            if not at:
                break
            continue
        if name in ("svg", "math") and html[after - 2] == "/":
            continue
        inline = name in INLINE
        if not inline and opened.get("p") and name not in KEEPS_P:
            i = len(stack) - 1
            while i > 0 and stack[i][0] != "p" and stack[i][0] not in KEEPS_P:
                i -= 1
            if i > 0 and stack[i][0] == "p":
                close(i)
        if name in CLOSES:
            left_open(*CLOSES[name])
        if name == "a" and opened.get("a"):  # links hold no links
            i = len(stack) - 1
            while i > 0 and stack[i][0] != "a" and stack[i][0] in INLINE:
                i -= 1
            if stack[i][0] == "a":
                close(i)
        if len(stack) > DEPTH:
            if stack[-1][2]:
                continue
            close(len(stack) - 1)
        _, above, out, link, inside = stack[-1]
        dropped, good, semantic, doubtful = (True, 0, False, False) if out else judged(name, html[m.end() : after - 1], inside)
        number = above
        if not inline and not out:
            flush()
            if not dropped:
                number = owner = page.open(above, name, good, semantic, doubtful)
        elif dropped and not out and pieces:
            pieces.append(" ")
        stack.append((name, number, out or dropped, link or name == "a", inside or semantic))
        opened[name] = opened.get(name, 0) + 1
    close(1)
    flush()
    page.end[0] = len(page.parent)
    return page


def settled(page: Page) -> None:
    """Leave out the elements in doubt and their blocks, but for those around the page's only articles."""
    n, out = len(page.parent), [False] * len(page.parent)
    for i in range(1, n):
        out[i] = out[page.parent[i]] or page.doubtful[i]
    if not any(out):
        return
    if not any(s and not o for s, o in zip(page.semantic, out, strict=True)):
        for i in [i for i in range(n) if page.semantic[i]]:
            while i > 0:
                page.doubtful[i] = False
                i = page.parent[i]
        for i in range(1, n):
            out[i] = out[page.parent[i]] or page.doubtful[i]
    page.blocks = [b for b in page.blocks if not out[b[0]]]


def main_blocks(page: Page) -> list[str]:
    """The blocks of the container and of the siblings that go with it, in page order."""
    settled(page)
    n = len(page.parent)
    points, text, links = [0.0] * n, [0] * n, [0] * n
    scored = [False] * n
    last: dict[int, str] = {}
    for element, block, linked in page.blocks:
        text[element] += len(block)
        links[element] += linked
        last[element] = block
        value = 0.0 if page.name[element] in HEADINGS else min(len(block) / 100, 3.0) + len(COMMA.findall(block)) + (len(block) >= SHORT)
        value *= 1 - linked / len(block)
        at = page.parent[element] if page.name[element] in PARAGRAPHS else element
        for level in range(LEVELS):
            if at < 0:
                break
            points[at] += value if level == 0 else value / 2 if level == 1 else value / (3 * level)
            scored[at] = True
            at = page.parent[at]
    for i in range(n - 1, 0, -1):
        text[page.parent[i]] += text[i]
        links[page.parent[i]] += links[i]
    density = [links[i] / text[i] if text[i] else 0.0 for i in range(n)]
    score = [(points[i] + page.good[i] + TAG_POINTS.get(page.name[i], 0)) * (1 - density[i]) if scored[i] else 0.0 for i in range(n)]
    candidates = [i for i in range(n) if scored[i]]
    if not candidates:
        return [b for _, b, _ in page.blocks]
    best = max(candidates, key=lambda i: (score[i], -i))
    at = best
    while at > 0 and page.name[at] != "article" and not page.semantic[at]:
        at = page.parent[at]
    kept = []
    if at > 0:
        # Of an article and the body marked inside it, the article
        up = page.parent[at]
        while page.name[at] != "article" and up > 0:
            if page.name[up] == "article":
                at = up
                break
            up = page.parent[up]
        best = at
    else:
        # An only child stands for its parent, which may hold the title
        while page.parent[best] > 0 and page.name[best] != "body" and text[best] == text[page.parent[best]]:
            best = page.parent[best]
    kept.append((best, page.end[best]))
    above, marked = page.parent[best], page.semantic[best]
    loose = set()  # blocks that lie in the parent itself
    if best > 0:
        least = max(SIBLING_LEAST, SIBLING_SHARE * score[best])
        child = above + 1
        while child < page.end[above]:
            name = page.name[child]
            if child != best and text[child]:
                fits = score[child] >= least and scored[child]
                if marked:
                    fits &= name == page.name[best]
                elif name in HEADINGS:
                    fits = density[child] < 0.5
                elif name in PARAGRAPHS or page.end[child] == child + 1:  # an element of text alone is one too
                    fits |= density[child] < 0.25 if text[child] > 80 else density[child] == 0 and bool(ENDS.search(last.get(child, "")))
                if fits:
                    kept.append((child, page.end[child]))
            child = page.end[child]
        if not marked:
            loose = {i for i, (e, b, k) in enumerate(page.blocks) if e == above and len(b) > 80 and k / len(b) < 0.25}
    kept.sort()
    begin = [a for a, _ in kept]
    # Blocks come in page order of their text, which may return to an element after its children
    return [b for i, (e, b, _) in enumerate(page.blocks) if i in loose or (at := bisect_right(begin, e)) and e < kept[at - 1][1]]


def extracted(html: str | None) -> str:
    return " ".join(main_blocks(read(html))) if html else ""


def main_text(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html), with the columns named in `keep`.

    A null html is empty; a page without text, or with none that is not left out, gives the empty text. A page in which no
    element gathers points (headings alone, say) gives all that is not left out. Of equally good containers the
    first in the page is taken. Null ids and urls stay null, repeated rows give a row each, an empty table none;
    columns other than those used are not looked at.
    """
    ddl = "page_id long, url string, text string, n_chars long"

    def run(batches) -> Iterator:
        for batch in sliced(batches):
            text = [extracted(h) for h in batch.column("html").to_pylist()]
            yield carried(arrow_batch(ddl, batch.column("page_id"), batch.column("url"), text, list(map(len, text))), batch, keep)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), *keep)
    return rows.mapInArrow(run, carried_schema(ddl, rows, keep))


def op12_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))

"""Main text of web pages by tree scoring.

Paragraphs earn points for length and commas and pass them to their nearest
ancestors, the further the fewer; a container's points are discounted by the
share of its text inside links; the best container is kept with those siblings
that score alike and with what stands between them.  Menus, page headers and
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are left out by element, role and class.

Decoded character references; white space inside a block is one space; blocks in
page order are joined by a newline.  Headings inside the article belong to it.
Work is linear in the length of the page, however deep it is nested.

Defined results: null, empty and text-free pages give the empty string; a page
without any paragraph gives all text that is not left out; text without markup
is one block; of containers that score alike the first counts; an unclosed
script, style or title swallows the rest of the page, as in browsers, an
unclosed ``svg`` or ``math`` ends at the next HTML element; repeated rows give
equal texts; columns besides those kept are not read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coterie.llm.common import prepare, rows_in_slices

#: Elements of HTML by role in this extraction.
LEFT_OUT_BLOCKS = frozenset("head nav footer aside form dialog menu".split())
LEFT_OUT = LEFT_OUT_BLOCKS | frozenset("script style noscript template button select option textarea iframe svg math canvas object audio video map title".split())
RAW = frozenset("script style iframe textarea title".split())
FOREIGN = frozenset(["svg", "math"])
#: Elements whose content inside a foreign element is HTML again.
INTEGRATION = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
PARAGRAPH = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("html body div section article main header figure ul ol dl table thead tbody tfoot tr center fieldset details hgroup".split())
BLOCK = PARAGRAPH | CONTAINER | LEFT_OUT_BLOCKS
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar sidebar aside widget widgets "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login search share sharing social comment comments disqus respond replies related recommended recommendations outbrain taboola copyright legal skip".split()
)
#: Of these, the ones that also leave out a single paragraph; the others may merely describe it.
CHROME_PARAGRAPH = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter comment comments disqus copyright".split())
CONTENT = frozenset("article content main body post entry story text page".split())
#: An open element that a start tag of the key ends.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: The least length of a scored paragraph; points for an article element; the share of the best score that keeps a sibling; ancestors that get points.
LEAST, FAVOUR, SIBLING, LEVELS = 25, 25.0, 0.2, 5
#: The share of text in links above which a list is a menu, and up to which a block between kept siblings is text.
MENU, PROSE = 0.8, 0.25


def is_chrome(tag: str, raw: str, inside: bool) -> bool:
    """Whether an element is left out; ``inside``: it stands in an article or main element."""
    if tag in LEFT_OUT or tag == "header" and not inside:
        return True
    if "=" not in raw and "hidden" not in raw:
        return False
    names: set[str] = set()
    for key, *values in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), next(filter(None, values), "")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value) or key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id"):
            names.update(x.lower() for x in _PARTS.findall(value))
    if tag in PARAGRAPH:
        return bool(names & CHROME_PARAGRAPH) and not names & CONTENT or bool(names & {"comment", "comments", "disqus"})
    return bool(names & CHROME) and not names & CONTENT and tag not in ("body", "html", "article", "main") or bool(names & {"comment", "comments", "disqus"}) and tag not in ("body", "html")


class Page:
    """Elements as parallel lists and blocks ``(owner, text, characters in links)`` in page order."""

    def __init__(self, html: str):
        self.tags, self.parents = ["#root"], [-1]
        self.blocks: list[tuple[int, str, int]] = []
        self.forms: list[tuple[int, str, int]] = []
        self.read(html)

    def read(self, html: str) -> None:
        stack = [(0, "#root", False, True)]  # the element that owns text here, tag, left out, whether text around it is taken
        at_tag: dict[str, list[int]] = {}  # where in the stack each open tag stands
        foreign: list[int] = []  # where its foreign elements and their integration points stand
        text: list[str] = []
        links = 0
        in_link, dropping, form, article = False, 0, 0, 0

        def taken() -> bool:
            return not dropping or form > 0 and dropping == form

        def flush() -> None:
            nonlocal links
            joined = " ".join("".join(text).split())
            if joined:
                (self.forms if form else self.blocks).append((stack[-1][0], joined, min(links, len(joined))))
            text.clear()
            links = 0

        def close(to: int) -> None:
            nonlocal dropping, form, article
            while len(stack) > to:
                _, tag, out, _ = stack.pop()
                at_tag[tag].pop()
                if foreign and foreign[-1] == len(stack):
                    foreign.pop()
                dropping -= out
                form -= tag == "form"
                article -= tag in ("article", "main")

        def say(piece: str) -> None:
            nonlocal links
            if piece and taken():
                piece = unescape(piece) if "&" in piece else piece
                text.append(piece)
                if in_link:
                    links += len(piece.strip())

        at = 0
        while m := _TOKEN.search(html, at):
            say(html[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if tag == "a":
                in_link = not m[1]
            elif tag == "br":
                say(" ")
            elif tag == "hr":
                flush()
            if tag in VOID or tag == "a":
                continue
            if m[1]:
                if at_tag.get(tag):
                    depth = at_tag[tag][-1]
                    if tag in BLOCK and (stack[depth][3] or taken()):  # else no text of this block has been read
                        flush()
                        in_link = False
                    close(depth)
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\b", re.I).search(html, at)
                at = end.start() if end else len(html)
                close_tag = _TOKEN.match(html, at)
                at = close_tag.end() if close_tag else len(html)
                continue
            if foreign and stack[foreign[-1]][1] in FOREIGN:
                if tag in BLOCK:  # HTML elements end a foreign element
                    close(foreign[-1])
                elif tag not in INTEGRATION and tag not in FOREIGN:
                    continue
            out = is_chrome(tag, m[3], article > 0)
            empty = m[3].endswith("/>")
            if tag not in BLOCK and not out and not (foreign and tag in INTEGRATION) or empty and (tag in FOREIGN or tag not in BLOCK):
                continue
            around = taken()
            if tag in BLOCK:
                if around:
                    flush()
                ends = {"p", *HEADING} if tag not in HEADING else {"p"}
                while len(stack) > 1 and (stack[-1][1] in ends and stack[-1][1] == "p" or stack[-1][1] in ENDS.get(tag, ())):
                    close(len(stack) - 1)
                self.tags.append(tag)
                self.parents.append(stack[-1][0])
                element = len(self.tags) - 1
            else:
                element = stack[-1][0]
            if tag in FOREIGN or foreign and tag in INTEGRATION:
                foreign.append(len(stack))
            at_tag.setdefault(tag, []).append(len(stack))
            stack.append((element, tag, out, around))
            dropping += out
            form += tag == "form"
            article += tag in ("article", "main")
        say(html[at:])
        flush()

    def scores(self, blocks: list[tuple[int, str, int]]) -> tuple[list[float], list[float]]:
        """Score and share of text in links of every element."""
        n = len(self.tags)
        points, chars, linked = [0.0] * n, [0] * n, [0] * n
        for owner, text, links in blocks:
            tag = self.tags[owner]
            chars[owner] += len(text)
            linked[owner] += links
            if len(text) < LEAST or tag in HEADING:
                continue
            worth = 1 + text.count(",") + text.count("\N{FULLWIDTH COMMA}") + min(len(text) / 100, 3)
            at, level = (self.parents[owner] if tag in PARAGRAPH else owner), 0
            while at >= 0 and level < LEVELS:
                points[at] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
                at, level = self.parents[at], level + 1
        for e in range(n - 1, 0, -1):  # an element follows its parent
            chars[self.parents[e]] += chars[e]
            linked[self.parents[e]] += linked[e]
        density = [x / c if c else 0.0 for x, c in zip(linked, chars, strict=True)]
        favoured = [self.tags[e] in ("article", "main") and chars[e] > 0 for e in range(n)]
        return [(p + FAVOUR * f) * (1 - d) for p, f, d in zip(points, favoured, density, strict=True)], density

    def main_text(self) -> str:
        blocks = self.blocks or self.forms
        n = len(self.tags)
        score, density = self.scores(blocks)
        best = max(range(n), key=score.__getitem__)
        if score[best] <= 0:
            return "\n".join(text for _, text, _ in blocks)
        at = self.parents[best]
        while at >= 0:  # an article or main element around it that scores too holds the rest of the text
            if self.tags[at] in ("article", "main") and score[at] >= SIBLING * score[best]:
                best = at
            at = self.parents[at]
        around = self.parents[best]
        kept = {best}
        if around >= 0:
            kept |= {e for e in range(n) if self.parents[e] == around and score[e] >= SIBLING * score[best]}
        inside, in_article = [False] * n, [False] * n
        for e in range(n):
            up = self.parents[e]
            in_article[e] = self.tags[e] in ("article", "main") or up >= 0 and in_article[up]
            menu = self.tags[e] in ("ul", "ol", "table") and density[e] > MENU and not in_article[e]
            inside[e] = (e in kept or up >= 0 and inside[up]) and not menu
        holds = [inside[owner] for owner, _, _ in blocks]
        if any(holds) and len(kept) > 1:
            # headings and prose of the same parent between kept siblings, and headings right before the first
            first, last = holds.index(True), n_last(holds)
            beside = lambda e: e == around or self.parents[e] == around
            for i in range(first, last):
                owner, text, links = blocks[i]
                holds[i] = holds[i] or beside(owner) and links <= PROSE * len(text)
            while first and beside(blocks[first - 1][0]) and self.tags[blocks[first - 1][0]] in HEADING:
                first -= 1
                holds[first] = True
        return "\n".join(text for (_, text, _), hold in zip(blocks, holds, strict=True) if hold)


def n_last(holds: list[bool]) -> int:
    return len(holds) - 1 - holds[::-1].index(True)


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and ``text`` for every page."""
    prepare(pages.sparkSession)
    source = pages.select(*keep, F.col(html).cast("string").alias("__html"))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("text", T.StringType())])

    def run(batches):
        for whole in batches:
            for batch in rows_in_slices(whole, "__html"):
                texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], schema.names)

    return source.mapInArrow(run, schema)

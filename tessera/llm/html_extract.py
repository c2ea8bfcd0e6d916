"""HTML extraction: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clustering, content regions.

The standard library's parser streams events. Block elements cut the page into lines; a line knows its text, how many tags stand in it,
how much of it is link text, and the element that holds it. What stands in elements that are never content (scripts,
controls, navigation, asides, page footers, hidden elements) is left out at once. Forms, page headers and elements whose class, id or role names a menu,
advert, notice, comment list and the like are only proposed: once the page is read they go, unless they hold the page's text (see settled()). Of the other lines the ratio of text to tags is smoothed over neighbouring lines; lines above a threshold set by the page's own
spread are content. The content region is the innermost element that holds all of those lines (but for lines of links), or an article or main element with most
of their text, and the page's text is every line of that region, so short lines between long ones stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml
    audio button canvas iframe input object script select style svg template textarea video""".split()
)
#: Elements that hold no article text.
NEVER = frozenset(
    "head script style noscript template iframe object svg canvas audio video select button textarea input nav aside footer menu dialog map annotation annotation-xml".split()
)
#: Elements that hold no article text unless they hold most of the page's text; a header in an article may hold its title.
SELDOM = frozenset(("form", "header"))
#: Words in class, id or role that propose that an element is no article text.
NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice
    notices alert alerts popup modal overlay newsletter subscribe subscription paywall sidebar sidenav aside menu menus nav navbar navigation navigational breadcrumb breadcrumbs header masthead
    topbar footer bottombar comment comments commentlist respond reply replies disqus discussion share sharing social related recommended
    widget widgets toolbar login signup search searchbox pagination pager complementary contentinfo dialog alertdialog toc skip""".split()
)
#: Those of them whose elements may well hold sentences that are no article text; the others also name parts of articles, which are known by their sentences.
PLAIN = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted banner cookie cookies consent gdpr popup modal overlay newsletter
    subscribe subscription paywall sidebar sidenav aside footer bottombar comments commentlist respond reply replies disqus complementary contentinfo dialog alertdialog""".split()
)
#: Words of reader comments, notices and boxes of other texts, but also of parts of articles: they count like PLAIN where the token has no other words than these and BOX.
BOXED = frozenset("comment notice notices alert alerts related recommended share sharing social widget widgets promotion discussion".split())
BOX = frozenset(
    """area article articles author bar block body box boxes button buttons card cards cell col column container content danger date error feed foot footer form group head heading icons info inline
    inner item items left links list main media message meta more news outer panel parent post posts primary right row rows section small stories story success text thread title user view warning wrap wrapper""".split()
)
#: Words that say that what follows is not there, or beside.
BEHIND = frozenset("has no not with without hide".split())
#: Words before "header" that make it the header of a text.
OWN = frozenset("entry post article story content section chapter".split())
#: A line of so many characters outside links is a sentence.
SENTENCE = 80
#: Elements whose own names are not looked at: they hold the article or the page.
WHOLE = frozenset(("html", "body", "article", "main"))
#: Elements that an open paragraph inside them doesn't reach out of.
HOLD = ("article", "main", "section", "div", "body", "td", "th", "li", "blockquote", "table", "ul", "ol")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that a new one of the same kind ends if they are still open, up to the holder.
ENDS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_COMMENT_END, _COMMENT_CLOSE = re.compile("-?>"), re.compile("--!?>")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Line:
    __slots__ = ("holder", "item", "link", "pieces", "tags", "text")

    def __init__(self, text: str, tags: int, link: int, holder: int, item: bool, pieces: list[tuple[int, str, bool]] = ()):
        self.text, self.tags, self.link, self.holder, self.item, self.pieces = text, tags, link, holder, item, pieces


@lru_cache(1 << 14)
def _level(value: str, inside: bool) -> int:
    """Whether a class, id or role proposes that its element is no article text: 0 not, 1 by a word that also names parts of articles, 2 by another."""
    level = 0
    for token in value.split():
        last = ""
        parts = [x.lower() for x in _PART.findall(token)]
        boxed = parts != ["discussion"] and all(x in BOXED or x in BOX or x.isdigit() for x in parts)
        for word in parts:
            if word in BEHIND:
                break
            if word in NAMES and not (word == "header" and (inside or last in OWN)):
                level = max(level, 1 + (word in PLAIN or (boxed and word in BOXED)))
            last = word
    return level


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(n == "hidden" or (n == "aria-hidden" and v == "true") or (n == "style" and v and _HIDDEN.search(v)) for n, v in attrs)


class Lines(HTMLParser):
    """Collects a page's lines. holders: for each element that may hold lines, (its parent's number, its tag).

    proposals: for each element that may be no article text, (the number of the one around it, its level, its holder); number 0 is the page.
    at: for each holder the innermost proposal around it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.holders: list[tuple[int, str]] = [(-1, "")]
        self.at = [0]
        self.proposals: list[tuple[int, int, int]] = [(-1, 0, 0)]
        self.stack: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]  # tag, left out, holder, proposal
        self.pieces: list[tuple[int, str, bool]] = []  # proposal, text, in a link
        self.tags = self.in_link = 0
        self.where: dict[str, list[int]] = {}  # of each tag name the places of its open elements in the stack
        self.ending = False

    def flush(self) -> None:
        pieces = self.pieces
        text = " ".join("".join([t for _, t, _ in pieces]).split())
        if text:
            link = sum([len(t) for _, t, on in pieces if on])
            self.lines.append(Line(text, self.tags, link, self.stack[-1][2], any(x[0] == "li" for x in self.stack[-3:]), pieces))
        self.pieces = []
        self.tags = 0

    def _close(self, tag: str, until: tuple[str, ...] = ()) -> None:
        """Closes the innermost open element of the tag and what is open in it, unless one of `until` is open in it. Takes the time of what it closes."""
        where = self.where
        own = where.get(tag)
        if not own:
            return
        k = own[-1]
        for other in until:
            if (at := where.get(other)) and at[-1] > k:
                return
        for x in self.stack[k:]:
            where[x[0]].pop()
        del self.stack[k:]

    def close(self):
        self.ending = True
        super().close()

    def _or_end(self, k: int) -> int:
        """What the page's end cuts off within markup is no text."""
        return len(self.rawdata) if k < 0 and self.ending else k

    def parse_comment(self, i, report=1):
        """As HTML has it: a comment ends with `-->` or `--!>`, is empty before `>` or `->`, and without an end goes on to the end of the page."""
        found = _COMMENT_END.match(self.rawdata, i + 4) or _COMMENT_CLOSE.search(self.rawdata, i + 4)
        return found.end() if found else self._or_end(-1)

    def parse_starttag(self, i):
        return self._or_end(super().parse_starttag(i))

    def parse_endtag(self, i):
        return self._or_end(super().parse_endtag(i))

    def parse_pi(self, i):
        return self._or_end(super().parse_pi(i))

    def parse_html_declaration(self, i):
        """`<![` that is not CDATA is a bogus comment up to the next `>`; the base class raises on it, or looks for a far `]>`."""
        if self.rawdata.startswith("<![", i) and self.rawdata[i + 3 : i + 9].upper() != "CDATA[":
            return self.parse_bogus_comment(i)  # without any `>` it is text
        return self._or_end(super().parse_html_declaration(i))

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.pieces.append((self.stack[-1][3], " ", False))
            self.tags += 1
            return
        block = tag not in INLINE and not self.stack[-1][1]  # what is left out cuts no lines
        if block:
            self.flush()
            if tag == "body":
                self._close("head")
            self._close("p", HOLD)
            if tag in ENDS:
                self._close(tag, ENDS[tag])
        self.tags += 1
        if tag in VOID:
            return
        _, out, holder, proposal = self.stack[-1]
        if not out:
            out = (tag in NEVER and not self._of_quotation(tag, attrs)) or (tag not in WHOLE and bool(attrs) and _hidden(attrs))
            level = 0 if out else self._proposed(tag, attrs)
            if level:
                self.proposals.append((proposal, level, holder))
                proposal = len(self.proposals) - 1
        if block and not out and tag != "p" and tag not in HEADINGS:
            self.holders.append((holder, "main" if ("role", "main") in attrs else tag))
            self.at.append(proposal)
            holder = len(self.holders) - 1
        self.where.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, out, holder, proposal))
        self.in_link += tag == "a"

    def _of_quotation(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """The source below a quotation, or a quotation of the text beside it."""
        if tag == "footer":
            return any(x[0] == "blockquote" for x in self.stack[-2:])
        return tag == "aside" and any(v and n in ("class", "role", "epub:type") and "quote" in v.lower() for n, v in attrs)

    def _proposed(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in WHOLE or tag in HEADINGS or (not attrs and tag not in SELDOM):
            return 0
        values = [v for n, v in attrs if v and n in ("class", "id", "role")]
        level = max((_level(v, False) for v in values), default=0)
        if level or tag == "header":
            inside = bool(self.where.get("article") or self.where.get("main"))
            level = max((_level(v, inside) for v in values), default=0)
            if tag == "header" and not inside:
                level = 2
        return 2 if tag == "form" else level

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        own = self.where.get(tag)
        if tag not in INLINE and not self.stack[own[-1] if own else -1][1]:
            self.flush()
        self.tags += 1
        if tag == "a" and self.in_link:
            self.in_link -= 1
        self._close(tag, () if tag not in INLINE else ("div", "section", "article", "main", "body", "td", "li"))

    def handle_data(self, data):
        if not self.stack[-1][1]:
            self.pieces.append((self.stack[-1][3], data, self.in_link > 0))


def settled(page: Lines, most: float = 0.5, rest: float = 0.2) -> list[Line]:
    """The lines without those of proposed elements that are no article text.

    A proposed element stays if it holds the page's largest article or main element, or `most` of the page's text outside links while less than `rest`
    of that text stands elsewhere in the largest article. One proposed by a word that also names parts of articles stays as well if it has a
    sentence and at most half of its text is in links. If nothing would be left of a page without article or main, all lines stay.
    """
    proposals, holders = page.proposals, page.holders
    if len(proposals) == 1:
        return page.lines
    free, whole, longest = ([0] * len(proposals) for _ in range(3))
    top = [0] * len(holders)  # the outermost article or main element around a holder
    for k in range(1, len(holders)):
        top[k] = top[holders[k][0]] or (k if holders[k][1] in ("article", "main") else 0)
    article = {k: 0 for k in top if k}
    for x in page.lines:
        own: dict[int, int] = {}
        for k, text, linked in x.pieces:
            n = len(text.strip())
            whole[k] += n
            if not linked:
                free[k] += n
                own[k] = own.get(k, 0) + n
        for k, n in own.items():
            longest[k] = max(longest[k], n)
        if top[x.holder]:
            article[top[x.holder]] += sum(own.values())
    for k in range(len(proposals) - 1, 0, -1):  # inner ones come after those around them
        up = proposals[k][0]
        free[up] += free[k]
        whole[up] += whole[k]
        longest[up] = max(longest[up], longest[k])
    best = max(article, key=article.get, default=0)
    holds, k = set(), page.at[best]
    while k > 0:
        holds.add(k)
        k = proposals[k][0]
    gone = [False] * len(proposals)
    for k in range(1, len(proposals)):
        up, level, holder = proposals[k]
        other = article[best] - (free[k] if top[holder] == best else 0) if best else 0
        large = free[k] >= most * free[0] > 0 and other < rest * free[0] and (not best or article[best] > 0)
        sentences = level == 1 and longest[k] >= SENTENCE and 2 * free[k] >= whole[k]
        gone[k] = gone[up] or not (k in holds or large or sentences)
    lines = []
    for x in page.lines:
        if any(gone[k] for k, _, _ in x.pieces):
            pieces = [y for y in x.pieces if not gone[y[0]]]
            text = " ".join("".join([t for _, t, _ in pieces]).split())
            if not text:
                continue
            x = Line(text, x.tags, sum([len(t) for _, t, on in pieces if on]), x.holder, x.item, pieces)
        lines.append(x)
    return lines if lines or best else page.lines


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is weighed by what lies inside."""
    radius = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    whole = np.convolve(np.ones(len(values)), kernel, "full")[radius : radius + len(values)]
    return np.convolve(values, kernel, "full")[radius : radius + len(values)] / whole


def content_lines(lines: list[Line], sigma: float, spread: float) -> np.ndarray:
    """Which lines are content: the smoothed ratio of text to tags is above the threshold."""
    ratio = np.array([(len(x.text) - x.link) / max(1, x.tags) for x in lines], dtype=float)
    smooth = smoothed(ratio, sigma)
    return smooth >= min(spread * float(smooth.std()), float(smooth.mean())) if len(lines) > 1 else np.ones(1, dtype=bool)


def region(lines: list[Line], holders: list[tuple[int, str]], chosen: np.ndarray, most: float = 0.5) -> list[int]:
    """The elements that hold the article: article or main elements with `most` of the chosen text, or else the innermost element that holds every chosen line.

    Of several article or main elements beside each other the largest counts, and each with half its chosen text or more. Lines that are mostly links are chosen for their
    neighbours only and don't count for the innermost element.
    """
    weight, firm = [0] * len(holders), [0] * len(holders)
    for x, on in zip(lines, chosen.tolist()):
        if on:
            weight[x.holder] += len(x.text)
            firm[x.holder] += 2 * x.link < len(x.text)
    for k in range(len(holders) - 1, 0, -1):  # children come after their parents
        weight[holders[k][0]] += weight[k]
        firm[holders[k][0]] += firm[k]
    whole = [k for k in range(len(holders)) if holders[k][1] in ("article", "main") and weight[k] > 0]
    if whole:
        large = [k for k in whole if weight[k] >= most * weight[0]]
        best = max(large or whole, key=lambda k: (weight[k], -k))
        around = {best}
        k = best
        while (k := holders[k][0]) >= 0:
            around.add(k)
        found = [best]
        chosen_at, covered = {best}, [False] * len(holders)
        for k, (parent, tag) in enumerate(holders):  # parents come first
            covered[k] = k in chosen_at or (parent >= 0 and covered[parent])
            if not covered[k] and tag in ("article", "main") and k not in around and weight[k] > 0 and 2 * weight[k] >= weight[best]:
                found.append(k)
                chosen_at.add(k)
                covered[k] = True
        if sum(weight[k] for k in found) >= most * weight[0]:
            return found
    children: dict[int, list[int]] = {}
    for k in range(1, len(holders)):
        children.setdefault(holders[k][0], []).append(k)
    at = 0
    while own := [k for k in children.get(at, ()) if firm[k] == firm[at] > 0]:
        at = own[0]
    return [at]


def extract(html: str | None, sigma: float = 1.5, spread: float = 1.0) -> str:
    """The main text of a page, its blocks joined by a blank line; empty for null, empty or textless pages."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = settled(parser)
    if not lines:
        return ""
    holders = parser.holders
    top = region(lines, holders, content_lines(lines, sigma, spread))
    inside, lists, article = [False] * len(holders), [0] * len(holders), [False] * len(holders)
    for k, (parent, tag) in enumerate(holders):
        inside[k] = k in top or (parent >= 0 and inside[parent])
        lists[k] = k if tag in ("ul", "ol") else lists[parent] if parent >= 0 else 0
        article[k] = tag in ("article", "main") or (parent >= 0 and article[parent])
    return "\n\n".join(x.text for x in without_menus([x for x in lines if inside[x.holder]], lists, article))


def without_menus(lines: list[Line], lists: list[int], article: list[bool]) -> list[Line]:
    """Without lists that are nothing but links, unless they stand in an article or main element. lists: the list around each holder, 0 for none."""
    other = {lists[x.holder] for x in lines if x.link < 0.9 * len(x.text)}
    return [x for x in lines if not lists[x.holder] or lists[x.holder] in other or article[x.holder]]


def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extracted(table: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of table(page_id, url, html).

    Every row is taken for itself, its whole html: null, empty and textless pages give an empty text, repeated rows equal ones, an empty table none.
    Null page_id and url pass through; other columns are ignored.
    """
    ship(table.sparkSession)
    own = table.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"))
    return own.mapInArrow(pages, "page_id long, url string, text string, n_chars long")

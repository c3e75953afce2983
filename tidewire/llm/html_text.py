"""Main text of web pages: parser events make lines, text-to-tag ratios make a curve, its high part is the content.

The standard library's parser streams events; each block element ends a line, and a line has its pieces of text, its tags
and the element each piece stands in. A line's ratio is its characters outside links over its tags. The ratios are smoothed
by a Gaussian and split in two clusters; lines of the upper one are dense, and select the content region: the articles that
hold most of them, else the main element, else the smallest element that holds them all. All that is text in the region is
returned, so that short headings beside long paragraphs stay; runs of lines that are links alone are menus and go.

Menus, headers, footers, sidebars, notices, adverts, forms, comments and scripts are left out by the element they are in,
which its tag, its role or a name in its class or id tells. Such a mark is no proof: an element that holds an article,
main or first heading and most of the page's text is a wrapper and stays, whatever it is called; so does one that is
called after a layout (with-sidebar, nav-page) and holds most of the dense lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the method: width of the Gaussian in lines; elements without text of their own, that are never shown,
#: that end a line, and that are left out.
SIGMA = 1.5
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas head title audio video select textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
ASIDE = frozenset("nav footer aside form menu dialog button search".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar".split())
#: Words in names of what is said beside an article, and of where things stand on a page.
SAID = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus "
    "reply replies respond disclaimer".split()
)
PLACED = frozenset(
    "banner sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead related recommended share sharing "
    "social pagination pager widget widgets toolbar skip contentinfo complementary".split()
)
#: Words that make a name the state of a page or a part (has-sidebar, comments-open), and words of content itself.
STATES = frozenset("with has have no not without is enabled disabled on off open opened closed left right wrap wrapper".split())
CONTENT = frozenset("content main article post entry story body text page".split())
#: Elements that are named after reader comments or adverts as a whole, articles too.
REPLIES = frozenset("comment comments reply replies ad ads advert advertisement sponsored".split())
#: A line is a link if so much of its text is; so many on end are a menu.
LINKED, MENU = 0.8, 3
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: What headings of reader comments say.
COMMENTS = re.compile(r"(?:\d+ )?(?:(?:reader|user|recent|latest|top|all) )?(?:comments?|replies|responses)(?: ?[(:\[]? ?\d* ?[)\]]?)|(?:leave|post|add|write) (?:a|your) (?:comment|reply)|join the (?:conversation|discussion)", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = re.compile(r"[^a-z0-9]+")
_OPEN = re.compile(r"<[a-zA-Z/!?]")
KEEP, PLACE, SAY, NEVER = range(4)


def mark_of(tag: str, attrs: list) -> int:
    """What an element's tag and attributes make of it: KEEP, PLACE (left out for where it stands), SAY (left out for what
    it says), NEVER (not shown at all)."""
    if tag in SILENT:
        return NEVER
    found = PLACE if tag in ASIDE else KEEP
    names: list[str] = []
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and v and v.lower() == "true":
            return NEVER
        if k == "role" and v and v.lower() in ROLES:
            found = PLACE
        elif k == "class" and v or k == "id" and v and tag not in ("article", "main"):
            names += v.lower().split()
    if tag in ("html", "body"):
        return KEEP
    content = False
    for name in names:
        words = [w for w in _WORDS.split(name) if w]
        if not words or not STATES.isdisjoint(words):
            continue
        if tag in ("article", "main"):
            if words[0] in REPLIES:
                return SAY
        elif not SAID.isdisjoint(words):
            found = max(found, SAY)
        elif not PLACED.isdisjoint(words):
            found = max(found, PLACE)
        elif not CONTENT.isdisjoint(words):
            content = True
    return KEEP if content and tag not in ASIDE and found == PLACE else found


class _Lines(HTMLParser):
    """Collects elements (tag, parent, mark) and lines (pieces of text with their element and whether in a link, tags)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.mark, self.stack = [""], [0], [KEEP], [0]
        self.link = [False]
        self.bare: list[int] = []  # headers of a page, that nothing but their tag marks
        self.open: dict[str, int] = {}
        self.pieces: list[tuple[str, int]] = []
        self.tags = 0
        self.lines: list[tuple[list[tuple[str, int]], int]] = []

    def end_line(self) -> None:
        if self.pieces:
            self.lines.append((self.pieces, self.tags))
            self.pieces, self.tags = [], 0

    def pop(self, k: int) -> None:
        for n in self.stack[k:]:
            self.open[self.tag[n]] -= 1
        del self.stack[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        stack = self.stack
        if tag in BLOCK:
            self.end_line()
            ends = ENDED_BY.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                name = self.tag[stack[k]]
                if name == "p" or name in ends:
                    self.pop(k)
                    break
                if name in BLOCK:
                    break
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        top, mark = stack[-1], mark_of(tag, attrs)
        if mark == KEEP and tag == "header" and not any(self.tag[x] in ("article", "main") for x in stack):
            mark = PLACE
            self.bare.append(len(self.tag))
        self.tag.append(tag)
        self.parent.append(top)
        self.mark.append(NEVER if self.mark[top] == NEVER else mark)
        self.link.append(self.link[top] or tag == "a")
        stack.append(len(self.tag) - 1)
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if not self.open.get(tag):
            return  # nothing to end
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[k]]
            if name == tag:
                self.pop(k)
                break
            if tag not in BLOCK and name in BLOCK:
                break  # a stray end of an inline element

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if self.mark[top] != NEVER:
            self.pieces.append((data, top))

    def unknown_decl(self, data: str) -> None:
        """Odd declarations are markup."""

    def parse_html_declaration(self, i: int) -> int:
        """Broken declarations are comments, as in browsers; the page goes on after them."""
        try:
            return super().parse_html_declaration(i)
        except (AssertionError, ValueError):
            return self.parse_bogus_comment(i)

    def finish(self) -> None:
        """End of the page. A tag, comment or declaration that is not finished by then is no text."""
        if _OPEN.match(self.rawdata):
            self.rawdata = ""
        self.close()
        self.end_line()


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; beyond the ends nothing counts."""
    r = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full, norm = np.convolve(values, kernel), np.convolve(np.ones(len(values)), kernel)
    return (full / norm)[r : r + len(values)]


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Two clusters in one dimension, by moving the threshold to the middle of their means: which values are in the upper."""
    lo, hi = float(values.min()), float(values.max())
    if lo == hi:
        return values > 0
    cut = (lo + hi) / 2
    for _ in range(50):
        up = values > cut
        new = (float(values[up].mean()) + float(values[~up].mean())) / 2
        if new == cut:
            break
        cut = new
        if not (values > cut).any():
            break
    return values > cut if (values > cut).any() else values == hi


class _Page:
    """A parsed page: which elements are left out, which lines are dense, where the content is."""

    def __init__(self, html: str):
        p = _Lines()
        p.feed(html)
        p.finish()
        self.tag, self.parent, self.mark, self.link = p.tag, p.parent, p.mark, p.link
        self.lines = [(pieces, tags) for pieces, tags in p.lines if any(not t.isspace() for t, _ in pieces)]
        #: Characters of each element's own text, outside links; then of its whole subtree. Parents come before children.
        self.chars = [0] * len(self.tag)
        for pieces, _ in self.lines:
            for t, n in pieces:
                if not self.link[n]:
                    self.chars[n] += len(t)
        self.chars = self._summed(self.chars)
        #: Headers that hold a first heading, which is no link, and nothing else: the article's, not the site's.
        said, first, h1 = [0] * len(self.tag), [0] * len(self.tag), self.inside(("h1",))
        for pieces, _ in self.lines if p.bare else ():
            for t, n in pieces:
                size = len("".join(t.split()))
                said[n] += size
                first[n] += size if h1[n] >= 0 and not self.link[n] else 0
        said, first = self._summed(said), self._summed(first)
        self.titles = frozenset(n for n in p.bare if 0 < said[n] == first[n])

    def _summed(self, own: list[int]) -> list[int]:
        """Sums over subtrees, of numbers of elements."""
        total = list(own)
        for n in range(len(total) - 1, 0, -1):
            total[self.parent[n]] += total[n]
        return total

    def heads(self) -> list[int]:
        """For each element, how many articles, mains and first headings it holds or is that no mark is on."""
        own = [int(t in ("article", "main", "h1") and m == KEEP) for t, m in zip(self.tag, self.mark, strict=True)]
        return self._summed(own)

    def left_out(self, dense: list[int] | None = None) -> list[bool]:
        """Which elements are left out. ``dense``: characters of dense lines in each element's subtree."""
        heads, out = self.heads(), [False] * len(self.tag)
        for n in range(1, len(out)):
            m = self.mark[n]
            if out[self.parent[n]]:
                out[n] = True
            elif m != KEEP:
                wrapper = heads[n] > 0 and 2 * self.chars[n] > self.chars[0]
                full = m == PLACE and self.tag[n] not in ASIDE and dense is not None and 2 * dense[n] > dense[0]
                out[n] = m == NEVER or not (wrapper or full or n in self.titles)
        return out

    def told(self, out: list[bool]) -> list[tuple[str, int, int]]:
        """(text that stays, characters of it in links, element of its first piece) of each line."""
        rows = []
        for pieces, _ in self.lines:
            text = " ".join("".join(t for t, n in pieces if not out[n]).split())
            linked = sum(len(t) for t, n in pieces if not out[n] and self.link[n])
            rows.append((text, min(linked, len(text)), next((n for t, n in pieces if not out[n] and not t.isspace()), 0)))
        return rows

    def without_comments(self, rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Lines without those from a heading of comments on, to the end of the element that the heading stands in."""
        above = None
        for i, (text, _, n) in enumerate(rows):
            if text and len(text) < 60 and COMMENTS.fullmatch(text):
                above = above or self.inside(tuple(HEADINGS))
                if above[n] < 0:
                    continue
                around = self.inside(some=frozenset([self.parent[above[n]]]))
                left = [r if j < i or around[r[2]] < 0 else ("", 0, r[2]) for j, r in enumerate(rows)]
                if any(r[0] for r in left):
                    rows = left
        return rows

    def headline(self, rows: list[tuple[str, int, int]], inside: list[int]) -> list[str]:
        """The nearest first heading before the content, if the content has none."""
        own = [i for i, (text, _, n) in enumerate(rows) if text and inside[n] >= 0]
        h1 = self.inside(("h1",))
        if not own or any(h1[rows[i][2]] >= 0 for i in own):
            return []
        return next(([rows[i][0]] for i in range(own[0] - 1, -1, -1) if rows[i][0] and h1[rows[i][2]] >= 0), [])

    def dense(self, rows: list[tuple[str, int, int]]) -> list[int]:
        """The lines of the upper cluster of the smoothed text-to-tag ratio."""
        ratio = np.array([(len(t) - linked) / max(1, n) for (t, linked, _), (_, n) in zip(rows, self.lines, strict=True)], dtype=float)
        if not len(ratio) or not ratio.any():
            return [i for i, r in enumerate(rows) if r[0]]
        return [i for i, up in enumerate(upper_cluster(smooth(ratio))) if up and rows[i][0]] or [int(np.argmax(ratio))]

    def inside(self, kinds: tuple[str, ...] = (), some: frozenset[int] = frozenset()) -> list[int]:
        """For each element the outermost one around it (or itself) of some tags or numbers; -1 if there is none."""
        out = []
        for n, tag in enumerate(self.tag):
            above = out[self.parent[n]] if n else -1
            out.append(above if above >= 0 else n if tag in kinds or n in some else -1)
        return out

    def region(self, rows: list[tuple[str, int, int]], chosen: list[int]) -> frozenset[int]:
        """The elements whose text is the content."""
        total = sum(len(rows[i][0]) for i in chosen)
        for kind in ("article", "main"):
            around, held = self.inside((kind,)), {}
            for i in chosen:
                if (found := around[rows[i][2]]) >= 0:
                    held[found] = held.get(found, 0) + len(rows[i][0])
            if held and 2 * sum(held.values()) >= total:
                return frozenset(held)
        own = [0] * len(self.tag)
        for i in chosen:
            own[rows[i][2]] += 1
        # Elements that hold all chosen lines are a chain; children have higher numbers than their parents.
        common = max(n for n, x in enumerate(self._summed(own)) if x == len(chosen))
        while common and self.tag[common] not in ("div", "section", "main", "article", "body", "html"):
            common = self.parent[common]  # one block alone: its parent's blocks are its neighbours
        return frozenset([common])

    def text(self) -> str:
        out = self.left_out()
        rows = self.without_comments(self.told(out))
        # Lines as if nothing were left out for its place: where most of the dense ones are is no menu, whatever its name.
        if any(self.mark[n] == PLACE and self.tag[n] not in ASIDE for n in range(len(self.tag))):
            spoken = [m in (SAY, NEVER) or t in ASIDE for m, t in zip(self.mark, self.tag, strict=True)]
            for n in range(1, len(spoken)):
                spoken[n] = spoken[n] or spoken[self.parent[n]]
            open_rows = self.without_comments(self.told(spoken))
            own = [0] * len(self.tag)
            if any(r[0] for r in open_rows):
                for i in self.dense(open_rows):
                    own[open_rows[i][2]] += len(open_rows[i][0])
            out = self.left_out(self._summed(own))
            rows = self.without_comments(self.told(out))
        if not any(r[0] for r in rows):
            return ""
        around, inside = self.inside(("article", "main")), self.inside(some=self.region(rows, self.dense(rows)))
        own = [(text, around[n] < 0 and linked >= LINKED * len(text)) for text, linked, n in rows if text and inside[n] >= 0]
        runs = [(links, [text for text, _ in run]) for links, run in groupby(own, lambda r: r[1])]
        # Many links on end are a menu where no article is marked and no prose stands on both sides of them.
        lines = [text for k, (links, part) in enumerate(runs) for text in part if not (links and len(part) >= MENU and k in (0, len(runs) - 1))]
        return "\n".join(self.headline(rows, inside) + lines)


def main_text(html: str | None) -> str:
    """The text of a page's content, its blocks joined by newlines; empty where there is none."""
    return _Page(html).text() if html else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars (code points). The whole html is read; null or empty gives empty text.
    Repeated rows give repeated results; other columns are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages``."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The same by regular expressions, for pages of one plain ``<article>`` without elements in it that are left out.
OP8_SQL = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(regexp_replace(x, '</?(p|h1)>', chr(1), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), chr(1)) AS parts FROM a),
c AS (SELECT page_id, url, list_filter([trim(regexp_replace(regexp_replace(regexp_replace(p, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) FOR p IN parts], lambda q: q <> '') AS parts FROM b)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10))) AS n_chars FROM c
"""

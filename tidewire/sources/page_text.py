"""Article text out of a page: the article's paragraphs without boilerplate, squeezed and cut at a word."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that go, classes that hold an article, phrases of boilerplate.
REMOVED = frozenset("script style noscript nav header footer aside form svg button iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BODY_CLASS = re.compile(r"article[-_]?(content|body)|story[-_]?content|post[-_]?content", re.I)
BOILERPLATE = ("cookie policy", "terms of service", "privacy policy", "all rights reserved", "subscribe to read", "sign up for newsletter", "advertisement")
MOST_CHARS = 6000
#: Characters of a paragraph that counts (more than), of a page that is used, and of a text that is no short
#: excerpt.
PARAGRAPH_CHARS, PAGE_CHARS, WHOLE_CHARS = 25, 50, 250


class _Reader(HTMLParser):
    """Text runs with the elements they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[int] = []
        self.nodes: list[tuple[str, str]] = []
        self.runs: list[tuple[str, tuple[int, ...]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p":
            self._close("p")
        if tag not in VOID:
            self.stack.append(len(self.nodes))
            self.nodes.append((tag, next((v or "" for k, v in attrs if k == "class"), "")))

    def _close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[k]][0] == tag:
                del self.stack[k:]
                return

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if data.strip() and not any(self.nodes[i][0] in REMOVED for i in self.stack):
            self.runs.append((data.strip(), tuple(self.stack)))


def article_text(html: str | None, most: int = MOST_CHARS) -> str:
    """Paragraphs of the first article, main or article-like element (else the body) that are longer than 25 characters
    and no boilerplate, with blank lines between; all text where there is no paragraph."""
    if not html:
        return ""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    alive = lambda i, n: not n[0] in REMOVED
    pick = [lambda n: n[0] == "article", lambda n: n[0] == "main", lambda n: bool(n[1] and BODY_CLASS.search(n[1])), lambda n: n[0] == "body"]
    box = next((i for test in pick for i, n in enumerate(reader.nodes) if alive(i, n) and test(n)), None)
    inside = [r for r in reader.runs if box is None or box in r[1]]
    paragraphs: dict[int, list[str]] = {}
    for i, n in enumerate(reader.nodes):
        if n[0] == "p":
            paragraphs[i] = []
    held = False
    for text, path in inside:
        for i in path:
            if i in paragraphs and (box is None or path.index(i) > path.index(box)):
                paragraphs[i].append(text)
                held = True
    if held or any(True for i in paragraphs if box is None):
        parts = [" ".join(p) for p in paragraphs.values() if p]
        clean = "\n\n".join(p for p in parts if len(p) > PARAGRAPH_CHARS and not any(b in p.lower() for b in BOILERPLATE))
    else:
        clean = "\n".join(t for t, _ in inside)
    clean = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", clean)).strip()
    return clean[:most].rsplit(" ", 1)[0] + "…" if len(clean) > most else clean


@F.pandas_udf(T.StringType())
def page_text(html: pd.Series) -> pd.Series:
    return html.map(article_text)


def usable_text(content: Column, encoded: Column, summary: Column, page: Column, excerpt: Column, title: Column) -> Column:
    """The first text there is, as a struct (text, source_type, is_short_excerpt): the feed's content, its encoded
    content, its summary, the page if it has 50 characters, the excerpt, the title."""
    some = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    text = F.coalesce(some(content), some(encoded), some(summary), F.when(F.length(F.trim(page)) >= PAGE_CHARS, page), F.trim(some(excerpt)), F.trim(title), F.lit(""))
    kind = (
        F.when(some(content).isNotNull() | some(encoded).isNotNull(), "rss_content").when(some(summary).isNotNull(), "rss_summary")
        .when(F.length(F.trim(page)) >= PAGE_CHARS, "page_extraction").otherwise("fallback")
    )
    return F.struct(text.alias("text"), kind.alias("source_type"), (F.length(text) < WHOLE_CHARS).alias("is_short_excerpt"))


__all__ = ["article_text", "page_text", "usable_text"]

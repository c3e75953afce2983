"""Pages of many shapes: headlines outside the body of an article, lists of links in it, comments that nothing marks."""

from __future__ import annotations

import random

import pytest
from tidewire.llm.html_text import main_text

PROSE = ["The first paragraph of this article is long enough to be prose by any measure at all.", "A second paragraph follows it, and it says a good many words more, so that it is dense too.", "The third one ends the article with some last remarks that nobody will ever read again."]
SAID = ["I do not agree with a single word of this article, which is far too long for me anyway.", "What a wonderful article, I have read it three times by now and shall read it once more.", "First of all, nobody asked; second, I have seen all of this in another place years ago.", "A fourth reader has something to say as well, and says it at quite some length in here."]
P = "".join(f"<p>{x}</p>" for x in PROSE)
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li><li><a href='/c'>Contact</a></li></ul></nav>"


def test_a_list_of_links_in_an_article_stays():
    links = "".join(f"<li><a href='/{k}'>Source number {k}</a></li>" for k in range(3))
    want = [*PROSE, "Sources", *(f"Source number {k}" for k in range(3))]
    for kind in ("article", "main"):
        assert main_text(f"<body>{MENU}<{kind}>{P}<h2>Sources</h2><ul>{links}</ul></{kind}><footer>me</footer></body>").split("\n") == want
    split = f"<body>{MENU}<div><p>{PROSE[0]}</p><p>{PROSE[1]}</p><ul>{links}</ul><p>{PROSE[2]}</p></div></body>"
    assert main_text(split).split("\n") == [*PROSE[:2], *want[4:], PROSE[2]]


@pytest.mark.parametrize(
    "page",
    [
        "<div><h1>A headline</h1><div class=meta>12 May</div><div class=entry-content>{}</div></div>",
        "<header><h1>A headline</h1></header><main>{}</main>",
        "<div class=top><h1>A <em>headline</em></h1></div><div class=body>{}</div>",
        "<div><div><h1>A headline</h1></div><div>{}</div></div>",
        "<article><header><h1>A headline</h1></header>{}</article>",
    ],
)
def test_headlines_beside_the_body(page):
    assert main_text(f"<html><body>{MENU}{page.format(P)}<footer>&copy; somebody</footer></body></html>").split("\n") == ["A headline", *PROSE]


def test_names_of_sites_are_no_headlines():
    for head in ("<header><h1><a href='/'>My Site</a></h1></header>", f"<header><h1>My Site</h1>{MENU}<p>All the news of today</p></header>", "<div class=masthead><h1>My Site</h1></div>"):
        assert main_text(f"<body>{head}<article><h2>A headline</h2>{P}</article></body>").split("\n") == ["A headline", *PROSE]


@pytest.mark.parametrize("title", ["Comments", "3 Comments", "Comments (12)", "Reader comments", "Leave a reply", "Responses", "Join the discussion"])
def test_comments_that_nothing_marks(title):
    said = "".join(f"<div><p>{x}</p></div>" for x in SAID)
    for page in (f"<article><h1>T</h1>{P}</article><section><h2>{title}</h2>{said}</section>", f"<article><h1>T</h1>{P}<div><h3>{title}</h3>{said}</div></article>", f"<div><h1>T</h1>{P}<h2>{title}</h2>{said}</div>"):
        assert main_text(f"<body>{MENU}{page}<footer>me</footer></body>").split("\n") == ["T", *PROSE]
    assert main_text(f"<article><h1>T</h1>{P}<p>Comments are what readers write.</p><h2>Comments on the budget of 1990</h2>{said}</article>").split("\n") == ["T", *PROSE, "Comments are what readers write.", "Comments on the budget of 1990", *SAID]


def test_pages_put_together_at_random():
    """Another generator than the tables': what belongs to the article is known beforehand."""
    rng = random.Random(8)
    words = "river stone winter letter garden window morning paper silver harbour engine market".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    for _ in range(150):
        title, body = say(4), [say(rng.randrange(14, 40)) for _ in range(rng.randrange(3, 9))]
        parts, want = [f"<p>{x}</p>" for x in body], list(body)
        if rng.random() < 0.4:
            k = rng.randrange(1, len(parts))
            links = [say(3) for _ in range(4)]
            parts.insert(k, "<ul>" + "".join(f"<li><a href='#'>{x}</a></li>" for x in links) + "</ul>")
            want[k:k] = links
        inner = "".join(parts)
        shape = rng.choice(["<article><h1>{t}</h1>{b}</article>", "<main><h1>{t}</h1><div>{b}</div></main>", "<header><h1>{t}</h1></header><main>{b}</main>", "<div><h1>{t}</h1><div class=content>{b}</div></div>", "<div class=post><div><h1>{t}</h1></div><div>{b}</div></div>"])
        comments = "<section><h2>Comments</h2>" + "".join(f"<p>{say(20)}</p>" for _ in range(rng.randrange(1, 4))) + "</section>" if rng.random() < 0.4 else ""
        aside = f"<aside><h3>Related</h3><p>{say(12)}</p></aside>" if rng.random() < 0.5 else ""
        page = f"<html><body>{MENU}{shape.format(t=title, b=inner)}{aside}{comments}<footer><p>&copy; {say(9)}</p></footer></body></html>"
        assert main_text(page).split("\n") == [title, *want], page

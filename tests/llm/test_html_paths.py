"""Main text that names, short blocks or fallback elements cost before."""

from html.parser import HTMLParser

import pandas as pd
import pytest

from lexigrove.llm import html_extract
from lexigrove.llm.html_extract import main_text

LONG = "A long sentence, with a clause, and an end. " * 8


def test_names_do_not_hide_an_article():
    inner = f"<article><h1>Head</h1><p>{LONG}</p><section class='discussion'><p>We discuss.</p></section><div class='related-work'><p>Others did.</p></div></article>"
    want = f"Head\n{LONG.strip()}\nWe discuss.\nOthers did."
    assert main_text(f"<body><div class='content has-sidebar'>{inner}</div></body>") == want
    assert main_text(f"<body><div class='content has-sidebar'><p>{LONG}</p></div></body>") == LONG.strip()


def test_heading_and_intro_stay():
    page = f"<body><div><h1>Head, of it.</h1><p>Intro, short.</p><section><p>{LONG}</p><p>{LONG}</p></section></div></body>"
    assert main_text(page).split("\n")[:2] == ["Head, of it.", "Intro, short."]


def test_math_and_fallback_text():
    assert main_text("<article><p>As <math><mi>x</mi></math> grows, <object>see the text</object>.</p></article>") == "As x grows, see the text."


def test_a_long_advert_beside_a_short_article():
    assert main_text(f"<body><div class='ad'>{LONG}</div><article><h1>Head.</h1><p>Short.</p></article></body>") == "Head.\nShort."


MENU = "<ul class='menu'><li><a href='/a'>Home</a><li><a href='/b'>News</a><li><a href='/c'>About</a></ul>"
REMARKS = "<div class='comments'><div class='c'><p>Nice one, thanks.</p></div><div class='c'><p>I do not agree at all.</p></div></div>"
BODY = f"<h2>Part one</h2><p>{LONG}</p><p>{LONG}</p><ul><li>First</li><li>Second</li></ul><p>Short end.</p>"
WANT = ["Part one", LONG.strip(), LONG.strip(), "First", "Second", "Short end."]


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{MENU}<div id='content'>{BODY}</div>{REMARKS}<div class='footer'>Imprint</div></body>",
        f"<body><table><tr><td>{MENU}<td><div>{BODY}</div><td>Weather: fine.</table></body>",
        f"<body><main><header><h1>Top</h1></header>{BODY}</main><aside><p>{LONG}</p></aside>{REMARKS}</body>",
        f"<body><div class='wrap'><div class='col'>{MENU}</div><div class='post'>{BODY}</div><div class='col'><p>See also.</p></div></div></body>",
        f"<body><div class='cookie'><p>We use cookies.</p></div><section><div class='text'>{BODY}</div></section><form><p>{LONG}</p></form></body>",
        f"<body>{MENU}<center><font>{BODY}</font></center><div role='contentinfo'><p>{LONG}</p></div></body>",
    ],
)
def test_layouts(page):
    got = main_text(page).split("\n")
    assert [x for x in got if x != "Top"] == WANT


INNER = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
KEPT = f"Head\n{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{INNER}<section class='comments'><p>{LONG}</p><p>I see.</p></section></article>",
        f"<main><article>{INNER}</article><div id='comments'><article><p>{LONG}</p></article></div></main>",
        f"<article><div class='advert'><p>Buy now, cheap.</p></div>{INNER}</article>",
        f"<main>{INNER}<div class='cookie-notice'><p>We use cookies.</p></div></main>",
        f"<article>{INNER}<div class='related'><ul><li>Other one</li><li>{LONG}</li></ul></div></article>",
        f"<article>{INNER}<article><p>First remark, of a reader.</p><article><p>An answer.</p></article></article><article><p>{LONG}</p></article></article>",
        f"<body>{INNER}<div class='comments'><div><p>{LONG}</p></div><p>So it is.</p></div></body>",
        f"<body><div class='post'>{INNER}<div class='comment-list'>{'<p>' + LONG + '</p>'}{'<p>Yes.</p>' * 40}</div></div></body>",
        f"<article>{INNER}<div class='newsletter-signup box'>Write to us.</div><div id='share'>Share it</div></article>",
        f"<body><main class='no-comments'><div class='content with-sidebar'>{INNER}</div><div class='sidebar'><p>{LONG}</p></div></main></body>",
    ],
)
def test_what_is_set_apart_goes(page):
    assert main_text(page) == KEPT


def test_names_that_cover_the_page_say_nothing():
    assert main_text(f"<body><div class='comments'><h1>Head</h1><p>{LONG}</p></div></body>") == f"Head\n{LONG.strip()}"
    assert main_text(f"<article class='related-work'><h1>Head</h1><p class='notice-of-death'>{LONG}</p></article>") == f"Head\n{LONG.strip()}"


def test_scores_decide(monkeypatch):
    """With the ratios turned round, other blocks are chosen on nearly every page."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"]
    right, scores = [main_text(x) for x in pages], html_extract.path_scores
    monkeypatch.setattr(html_extract, "path_scores", lambda found: {p: 1 / (1e-9 + v) for p, v in scores(found).items()})
    assert sum(main_text(x) != y for x, y in zip(pages, right, strict=True)) > 0.9 * len(pages)


class Article(HTMLParser):
    """The blocks of the article element, read by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.held = False, [], ""

    def flush(self):
        if text := " ".join(self.held.split()):
            self.blocks.append(text)
        self.held = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "h1", "p", "footer"):
            self.flush()
        self.inside = tag == "article" or self.inside and tag != "footer"
        self.held += " " * (tag == "br")

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.flush()
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.held += data


def test_all_pages_against_another_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(rows).collect()}
    for page_id, page in rows.collect():
        reader = Article()
        reader.feed(page or "")
        reader.close()
        reader.flush()
        assert got[page_id] == "\n".join(reader.blocks), page_id


def test_odd_rows(spark):
    """Null and empty pages, repeated rows, a clashing column, a megabyte of unclosed inline adverts, an empty table."""
    big = f"<article><p>{LONG}{'<span class=ad>x' * 60_000}</p><p>{LONG}</p></article>"
    rows = [(1, None, "old"), (2, "", "old"), (3, "<p>a</p>", "old"), (3, "<p>a</p>", "old"), (4, big, None), (None, "plain", None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(pages).collect()]
    assert sorted(x for x in got if x[0] in (1, 2, 3)) == [(1, ""), (2, ""), (3, "a"), (3, "a")] and (None, "plain") in got
    text = next(t for i, t in got if i == 4)
    assert text.startswith(LONG.strip()) and text.endswith(LONG.strip())
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_markup():
    """Stray quotes, words of a sentence with a class of their own, dish lists, white space of all kinds."""
    assert main_text('<p title="x>lost</p><p>kept</p><p class="y">after.') == "lost\nkept\nafter."
    assert main_text("<p title='a > b' class=\"c\">text</p>") == "text"
    assert main_text("<article><p>Mind the <span class='notice'>gap</span> here.</p></article>") == "Mind the gap here."
    assert main_text("<main><ul class='menu-items'><li>Soup</li><li>Fish</li></ul></main>") == "Soup\nFish"
    assert main_text("<p>a&nbsp;&#8195;b\t&amp;\n c</p>") == "a b & c"

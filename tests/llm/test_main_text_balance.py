"""Comments, notices, sidebars and footers go, lists and tables stay, with odds that were trained on given pages."""

import pytest

from sparloom.llm import html_text

LONG = "Readers will know the place, a low hall of brick by the river, where the market was held until the war. It has been empty since, and the roof let in the rain; the town bought it last year."
ARTICLE = [f"{LONG} Part {k} of the story tells what was done, and by whom, until the doors were opened again." for k in range(8)]
BODY = "".join(f"<p>{x}</p>" for x in ARTICLE)
COMMENTS = [f"I was there on the day number {k}, and I must say that it was not as you tell it. My mother worked in that hall, and she would have laughed, truly." for k in range(6)]


@pytest.fixture(scope="module")
def odds(spark, sf):
    return html_text.train(spark.read.parquet(f"{sf}/pages.parquet"))


def of(odds, body):
    return html_text.extract(f"<html><head><title>Hall</title></head><body><nav><a href=x>Home</a></nav>{body}</body></html>", odds).split("\n\n")


PAGES = {
    "comments in the article": (f"<article>{BODY}<section class='comments'>" + "".join(f"<p>{c}</p>" for c in COMMENTS) + "</section></article>", ARTICLE),
    "comments after the article": (f"<article>{BODY}</article><div id='comments'>" + "".join(f"<div class='comment'><p>{c}</p></div>" for c in COMMENTS) + "</div>", ARTICLE),
    "comments that are articles": (f"<main><article>{BODY}</article><section id=comments>" + "".join(f"<article id=c{k}><p>{c}</p></article>" for k, c in enumerate(COMMENTS)) + "</section></main>", ARTICLE),
    "teasers in an aside": (f"<article>{BODY}</article><aside>" + "".join(f"<article><h3>Next</h3><p>{c}</p></article>" for c in COMMENTS) + "</aside>", ARTICLE),
    "one comment between paragraphs": (f"<article><p>{ARTICLE[0]}</p><div class='reader-comments'><p>{COMMENTS[0]}</p></div><p>{ARTICLE[1]}</p></article>", ARTICLE[:2]),
    "a notice": (f"<div class='cookie-notice'><p>{COMMENTS[0]}</p></div><article>{BODY}</article>", ARTICLE),
    "a notice between paragraphs": (f"<article><p>{ARTICLE[0]}</p><p class='notice'>{COMMENTS[0]}</p><p>{ARTICLE[1]}</p></article>", ARTICLE[:2]),
    "a sidebar": (f"<article>{BODY}</article><aside class=sidebar><p>{COMMENTS[0]}</p><p>{COMMENTS[1]}</p></aside>", ARTICLE),
    "a footer": (f"<article>{BODY}</article><footer><p>{COMMENTS[0]}</p></footer>", ARTICLE),
    "roles": (f"<article>{BODY}</article><div role=complementary><p>{COMMENTS[0]}</p></div><div role='contentinfo'><p>{COMMENTS[1]}</p></div>", ARTICLE),
    "a recipe": (f"<article><p>{ARTICLE[0]}</p><ul><li>2 eggs</li><li>salt</li><li>a cup of flour</li><li>milk</li></ul><p>{ARTICLE[1]}</p></article>", [ARTICLE[0], "2 eggs", "salt", "a cup of flour", "milk", ARTICLE[1]]),
    "a table": (f"<article><p>{ARTICLE[0]}</p><table><thead><tr><th>Year</th><th>Visitors</th></tr></thead><tr><td>1990</td><td>12</td></tr></table></article>", [ARTICLE[0], "Year", "Visitors", "1990", "12"]),
    "headings": (f"<article><h1>The hall</h1><p>{ARTICLE[0]}</p><h2>War</h2><p>{ARTICLE[1]}</p></article>", ["The hall", ARTICLE[0], "War", ARTICLE[1]]),
    "a list where no tag tells": (f"<div>{BODY}<ul><li>2 eggs</li><li>salt</li></ul><p>{ARTICLE[0]}</p></div>", [*ARTICLE, "2 eggs", "salt", ARTICLE[0]]),
    "comments of markup that end at once": (f"<!--><article><!---><p>{ARTICLE[0]}</p><!-- a --!><p>{ARTICLE[1]}</p></article>", ARTICLE[:2]),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(odds, name):
    body, want = PAGES[name]
    assert of(odds, body) == want


def test_given_pages_are_what_their_ancestors_say(spark, sf, odds):
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect():
        assert html_text.extract(r.html or "", odds) == "\n\n".join(b.text for b in html_text.blocks(r.html or "") if b.meaning > 0)


def test_the_cut_decides_where_the_look_is_against(odds, monkeypatch):
    body = f"<div>{BODY}<p><a href=x>See the plan</a></p><p>{ARTICLE[0]}</p></div>"
    assert "See the plan" in of(odds, body)
    monkeypatch.setattr(html_text, "NEXT", 0.0)
    monkeypatch.setattr(html_text, "SIBLING", 0.0)
    assert "See the plan" not in of(odds, body)

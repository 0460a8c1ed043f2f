"""Pages whose outer elements have names that speak of boilerplate."""

import pytest

from sparloom.llm import html_text

PARAGRAPHS = ["The council met on Monday to talk about the bridge, and it voted to repair it. The work starts in May.", "Residents had asked for it for years, they said. The old bridge was closed twice, last in winter."]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = "<nav><a href=x>Home</a> <a href=y>News</a></nav>"
WRAPPED = [
    *(f'<html><body>{MENU}<div class="{c}"><div>{BODY}</div></div></body></html>' for c in ("content-with-sidebar", "has-comments", "no-sidebar", "page_without_nav")),
    f'<html><body><form id="aspnetForm">{MENU}<div><div>{BODY}</div></div></form></body></html>',
    f'<html><body><form>{MENU}<article>{BODY}</article></form></body></html>',
    f'<html><body><div class="sidebar"><main>{BODY}</main></div></body></html>',
    f'<html><body>{MENU}<svg viewBox="0 0 1 1"/><article>{BODY}<math/></article><svg><path/></svg></body></html>',
]


@pytest.mark.parametrize("page", WRAPPED)
def test_wrapped_pages_keep_their_text(page):
    assert html_text.extract(page, html_text.weights({})) == "\n\n".join(PARAGRAPHS)


def test_header_of_an_article_stays():
    page = f"<html><body><header><a href=x>Site</a></header><article><header><h1>Bridge is repaired</h1></header>{BODY}</article></body></html>"
    assert html_text.extract(page, html_text.weights({})) == "\n\n".join(["Bridge is repaired", *PARAGRAPHS])

"""The cut decides where tags do not, and long pages take little more time than short ones."""

import time

import pytest

from sparloom.llm import html_text

TEXT = "The council met on Monday to talk about the bridge, and it voted to repair it. The work starts in May."


@pytest.mark.parametrize("page, want", [
    (f'<article class="post tag-search"><p>{TEXT}</p></article>', [TEXT]),
    (f'<div class="content no-sidebar"><article><p>{TEXT}</p></article></div>', [TEXT]),
    (f'<form><nav><a href=x>Home</a></nav><article><p>{TEXT}</p></article></form>', [TEXT]),
    (f'<article><header class="entry-header"><h1>Bridge is repaired</h1></header><p>{TEXT}</p></article>', ["Bridge is repaired", TEXT]),
    (f"<article><p>{TEXT} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>", [f"{TEXT} x=2"]),
])
def test_pages(page, want):
    assert html_text.extract(f"<html><body><div class=menu><a href=x>Home</a></div>{page}</body></html>", html_text.weights({})) == "\n\n".join(want)


def test_the_cut_overrules_a_block(monkeypatch):
    page = "<html><body><div>" + f"<p>{TEXT}</p><p><a href=x>See also</a></p><p>{TEXT}</p>" * 3 + "</div></body></html>"
    whole = html_text.extract(page, html_text.weights({}))
    monkeypatch.setattr(html_text, "NEXT", 0.0)
    monkeypatch.setattr(html_text, "SIBLING", 0.0)
    assert whole.count("See also") == 3 and "See also" not in html_text.extract(page, html_text.weights({}))


def test_a_page_of_forty_thousand_blocks():
    page = "<html><body>" + "".join(f"<div><p>{'word ' * (k % 50 + 1)}{'.' if k % 3 else ''}</p><p><a href=x>more</a></p></div>" for k in range(20_000)) + "</body></html>"
    began = time.time()
    assert len(html_text.blocks(page)) == 40_000
    html_text.extract(page, html_text.weights({}))
    assert time.time() - began < 10

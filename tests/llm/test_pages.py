"""Whole articles, and nothing else, from pages of markup that no weight was learnt from."""

from collections import Counter

import pytest

from loomgraph.llm import extract

NAV, FOOT = "<nav><a>n n</a><a>n</a></nav>", "<footer><p>n n n</p></footer>"


def p(letter: str, n: int) -> str:
    return f"<p>{' '.join([letter] * n)}</p>"


COMMENTS = f"<div class='comments'>{p('x', 30)}</div>"
LINKS = "<table><tr><td><a>x</a></td><td><a>x</a></td></tr><tr><td><a>x</a></td></tr></table>"
#: What stands between menu and footer, and its number of m words, which are the article; x words are not.
PAGES = {
    "a widget of text": (f"<div class='widget-text'>{p('m', 300)}</div>", 300),
    "a widget in an article": (f"<article><div class='elementor-widget widget-text'>{p('m', 300)}</div></article>", 300),
    "a widget area as main text": (f"<main><div class='widget-area'>{p('m', 200)}</div></main>", 200),
    "a menu of dishes": (f"<div class='menu-of-the-day'>{p('m', 200)}</div>", 200),
    "named for its comments": (f"<div class='article-with-comments'>{p('m', 200)}{COMMENTS}</div>", 200),
    "an article named for its comments": (f"<div class='article-with-comments'><article>{p('m', 200)}</article>{COMMENTS}</div>", 200),
    "an overlay": (f"<div class='response-wrapper overlay'>{p('m', 200)}</div>", 200),
    "two articles, one of 40 words": (f"<article>{p('m', 200)}</article><article>{p('m', 40)}</article>", 240),
    "two articles, one of 60 words": (f"<article>{p('m', 60)}</article><article>{p('m', 200)}</article>", 260),
    "links between two blocks": (f"<div class='content'>{p('m', 100)}</div>{LINKS}<div class='content'>{p('m', 150)}</div>", 250),
    "links between two main elements": (f"<main>{p('m', 100)}</main>{LINKS}<main>{p('m', 150)}</main>", 250),
    "a short article before a longer block": (f"<article>{p('m', 45)}</article><div>{p('x', 100)}</div>", 45),
    "columns and boxes beside an article": (f"<article>{p('m', 150)}</article><div class='col-right'>{p('x', 40)}</div><div class='promobox'>{p('x', 20)}</div>", 150),
    "a box amid an article": (f"<article>{p('m', 100)}<div class='promobox'>{p('x', 20)}</div>{p('m', 50)}</article>", 150),
    "no article element": (f"<div class='txt'>{p('m', 150)}</div><div class='col-right'>{p('x', 40)}</div><div class='promobox'>{p('x', 20)}</div><div class='user-opinions'>{p('x', 30)}</div>", 150),
    "more comments than text": (f"<article>{p('m', 100)}</article><div class='comments'>{p('x', 400)}</div>", 100),
    "more comments than text, no article element": (f"<div class='a'>{p('m', 150)}</div><div class='comments'>{p('x', 300)}</div>", 150),
    "articles that are related": (f"<article>{p('m', 100)}</article><div class='related'><article>{p('x', 30)}</article></div>", 100),
    "an aside amid an article": (f"<article>{p('m', 100)}<aside>{p('x', 30)}</aside>{p('m', 60)}</article>", 160),
    "a main column": (f"<div class='row'><div class='col-md-8'>{p('m', 150)}</div><div class='col-md-4 sidebar'>{p('x', 40)}</div></div>", 150),
    "nothing but notices": (f"<div class='cookie-notice'>{p('x', 12)}</div>", 0),
}


@pytest.mark.parametrize("name", PAGES)
def test_whole_articles_alone(name):
    body, words = PAGES[name]
    assert Counter(extract.main_text(f"<body>{NAV}{body}{FOOT}</body>", extract.learnt()).split()) == Counter({"m": words} if words else {})

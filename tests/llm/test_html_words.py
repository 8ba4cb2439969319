"""Words of classes and ids delete no text by themselves."""

import random

import pytest

from orbitframe.llm import html_text
from test_html_pages import FOOT, FORM, MENU, NOTICE, SIDE, TALK, prose

A, B_, C = prose(77, 3)


def words_in(extra):
    return f"<body>{MENU}<{{0}}><p>{A}</p>{extra}<p>{B_}</p></{{0}}>{FOOT}</body>"


#: What stands between two paragraphs of an article, and its text.
KEPT = [
    (f'<section id="discussion"><h2>Discussion</h2><p>{C}</p></section>', f"Discussion {C}"), (f'<h2 id="related-work">Related work</h2><p>{C}</p>', f"Related work {C}"), ('<h2 id="search">Search</h2>', "Search"),
    ('<h2 id="form-handling">Form handling</h2>', "Form handling"), ('<h2 id="menu">The menu</h2>', "The menu"), (f'<p class="notice">{C}</p>', C), (f'<div class="search-results-explained"><p>{C}</p></div>', C),
    ('<p>It has <em class="ad">an ad</em> in it, and <span id="footer-note">a note</span>.</p>', "It has an ad in it, and a note."), (f"<header><h1>Title</h1></header><p>{C}</p>", f"Title {C}"), ('<div class="banner"><h1>Title</h1></div>', "Title"),
    ("<p>a &l<b>t; b</b>, c</p>", "a &lt; b, c"), (f'<div id="reply-to-critics"><p>{C}</p></div>', C), (f'<ul class="menu"><li>{A}</li><li>{C}</li></ul>', f"{A} {C}"), (f'<div class="alert"><p>{A} {B_} {C}</p></div>', f"{A} {B_} {C}"),
    (f'<section id="widget"><h3 class="share">Sharing</h3><p class="social">{C}</p></section>', f"Sharing {C}"), (f'<div class="cookie-recipes"><p>{C}</p></div>', C), (f'<blockquote class="promo"><p>{C}</p></blockquote>', C), ('<table class="sidebar"><tr><td>one, two</td></tr></table>', "one, two"),
]


@pytest.mark.parametrize("home", ["article", "main"])
@pytest.mark.parametrize("case", range(len(KEPT)))
def test_text_of_an_article_stays(home, case):
    extra, text = KEPT[case]
    page = words_in(extra).format(home)
    assert html_text.main_text(page) == f"{A} {text} {B_}"


@pytest.mark.parametrize("seed", range(30))
def test_names_made_from_headings(seed):
    r = random.Random(seed)
    names = sorted(html_text.BOILER_WORDS | html_text.COMMENT_WORDS | {"discussion", "reply"})
    parts, sections, text = prose(seed, 6), "", []
    for p in parts:
        word, tag = r.choice(names), r.choice(["h2", "h3"])
        sections += f'<{tag} id="{word}">On {word}</{tag}><p id="{word}-{r.choice(names)}">{p}</p>'
        text += [f"On {word}", p]
    page = f"<body>{r.choice([MENU, NOTICE, ''])}<article><h1>All</h1>{sections}</article>{r.choice([FOOT, SIDE, TALK, FORM])}</body>"
    assert html_text.main_text(page) == " ".join(["All", *text])


@pytest.mark.parametrize("junk", [SIDE, FOOT, NOTICE, TALK, FORM, MENU, '<div class="ad">Buy it now, and here.</div>', '<div id="site-footer">Made by us.</div>', '<section id="comments"><p>Well said, I agree.</p></section>', '<div class="share-box">Share it.</div>'])
@pytest.mark.parametrize("place", ["before", "after", "inside"])
def test_boilerplate_goes(junk, place):
    put = lambda where: junk if place == where else ""
    page = f"<body>{put('before')}<article><h1>Title</h1><p>{A}</p>{put('inside') if 'id=\"site' not in junk and junk != FOOT else ''}<p>{B_}</p><p>{C}</p></article>{put('after')}</body>"
    assert html_text.main_text(page) == f"Title {A} {B_} {C}"


def test_boilerplate_in_the_deep():
    deep = "<div>" * 700
    assert html_text.main_text(f"<body>{deep}<nav>Menu, and more of it.</nav><p>{A}</p></body>") == A
    assert html_text.main_text(f"<body>{deep}<p>{A}</p><nav>Menu<ul><li>one</li></ul></nav>{'</div>' * 700}<p>{B_}</p></body>") == f"{A} {B_}"

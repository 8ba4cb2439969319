"""Pages without an article element, malformed pages, and the path ratios against a plain version."""

import random
import time

import brute as B
import pytest

from orbitframe.llm import html_text

MENU = '<ul class="menu"><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul>'
SIDE = '<div class="sidebar"><p>Side words, which are long enough, and have marks.</p></div>'
FOOT = '<div id="footer"><p>Copyright by us, all rights reserved, 2020.</p></div>'
NOTICE = '<div class="cookie-notice">We use cookies, as everybody does. <button>Fine</button></div>'
TALK = '<div class="comments"><h3>Two replies</h3><p>Well said, I agree with every word.</p><p>So do I, and more.</p></div>'
FORM = '<form action="/s"><label>Search</label> <input name="q"><p>Type words, then press the key.</p></form>'


def prose(seed, n):
    r = random.Random(seed)
    words = ["river", "stone", "light", "seven", "walks", "under", "paper", "north", "cloud", "table"]
    return [" ".join(r.choice(words) for _ in range(r.randint(8, 25))) + ", " + " ".join(r.choice(words) for _ in range(r.randint(5, 12))) + "." for _ in range(n)]


WRAPPERS = ['<div class="content">{}</div>', "<div><div>{}</div></div>", '<div class="layout has-sidebar">{}</div>', '<div class="post no-comments">{}</div>', '<div class="content-sidebar-wrap"><div>{}</div></div>', "<form method=post>{}</form>"]
JUNK = [("", ""), (MENU, FOOT), (NOTICE + MENU, TALK), (FORM, SIDE + FOOT), ("<nav>Menu, and more.</nav>", "<footer>End, at last.</footer>"), ('<div hidden="">Hidden words, many of them.</div>', TALK + FOOT)]


@pytest.mark.parametrize("wrapper", range(len(WRAPPERS)))
@pytest.mark.parametrize("junk", range(len(JUNK)))
def test_pages_without_article(wrapper, junk):
    parts = prose(10 * wrapper + junk, 5)
    before, after = JUNK[junk]
    body = f"<h1>A title &amp; more</h1><p>{parts[0]}</p><p>{parts[1]} <b>bold</b>\n text</p><h2>Part</h2><ul><li>{parts[2]}</li><li>{parts[3]}</li></ul><p>{parts[4]}</p>"
    page = f"<html><head><title>no</title><style>p {{}}</style></head><body>{before}{WRAPPERS[wrapper].format(body)}{after}</body></html>"
    assert html_text.main_text(page) == " ".join(["A title & more", parts[0], f"{parts[1]} bold text", "Part", *parts[2:]])


def test_junk_inside_of_the_article():
    a, b = prose(1, 2)
    page = f'<body><article><h1>Title</h1><p>{a}</p><div><a href="/n">Read next: other story</a></div><p>{b}</p><p><a href="/x">source</a></p>{TALK}</article></body>'
    assert html_text.main_text(page) == f"Title {a} {b} source"


def test_only_boilerplate():
    for page in (MENU, TALK, NOTICE, "<footer>End, at last.</footer>", "<form>Search</form>"):
        assert html_text.main_text(f"<body>{page}</body>") == ""


def test_ratios():
    r = random.Random(6)
    for _ in range(60):
        blocks = []
        for _ in range(r.randint(1, 25)):
            block = html_text.Block((0,), r.choice(["/html/body/p", "/html/body/div", "/html/body/div/p", "/html/body/ul/li"]))
            block.text = "".join(r.choice("abcd ,.") for _ in range(r.randint(1, 90)))
            block.link = r.choice([0, 0, len(block.text) // 2, len(block.text)])
            blocks.append(block)
        assert html_text.content_paths(blocks) == B.content_paths([(b.path, b.text, b.link) for b in blocks])


def test_malformed_pages_take_linear_time():
    n = 60_000
    pages = ["<a " + '"x" ' * n, "<" * n, "<a " * n, "<div>" * n + "</p>" * n, "<!" * n, "<span hidden>" * n, "<a \"'" * n, '<a "<b " ' * n, "<!--" * n, "<dl><dd><div>" + "<h1>" * n + "<dt></dt>" * n, "&#" * n, "<div " + "a-" * n + ">x"]
    for page in pages:
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 5, page[:20]
    assert html_text.main_text('<p>1 < 2, and <a href="x>y">so</a> on</p>') == "1 < 2, and so on"
    assert html_text.main_text("<p>an open quote: <a href=\"x>here</a>, and on</p>") == "an open quote: here, and on"

import html
import re

import numpy as np
import pytest

from threadloom.llm.html_text import extract, grow, judge, labelled_table, main_text, text_blocks

TREE = grow(*labelled_table())


def test_tree_fits_its_table():
    x, y = labelled_table()
    assert np.mean([(judge(TREE, r) >= 0.5) == b for r, b in zip(x, y, strict=True)]) == 1


LONG = "words that go on and on " * 8


@pytest.mark.parametrize(
    ("extra", "kept"),
    [
        ("<nav><ul><li><a href='/x'>One</a></li><li><a href=/y>Two</a></li></ul></nav>", ""),
        ("<header class='site-header'><p>Some Site with a longer slogan than usual</p></header>", ""),
        ("<aside><h3>More</h3><p>" + LONG + "</p></aside>", ""),
        ("<div class=\"sidebar widget\"><p>" + LONG + "</p></div>", ""),
        ("<div class='cookie-notice'>We use cookies. " + LONG + "</div>", ""),
        ("<form><p>Your name " + LONG + "</p><input name=x><button>Send</button></form>", ""),
        ("<section id=comments><h2>Comments</h2><article class='comment'><p>" + LONG + "</p></article></section>", ""),
        ("<div class=ad>" + LONG + "</div>", ""),
        ("<footer>&copy; site &middot; " + LONG + "</footer>", ""),
        ("<script>if (a < b) document.write('<p>no</p>')</script><style>p > b {}</style><!-- <p>no</p> -->", ""),
        ("<noscript><p>no script</p></noscript>", ""),
    ],
)
def test_only_the_article(extra, kept):
    page = f"<html><head><title>T</title></head><body>{extra}<main><article><h1>A  title</h1><p>First &amp; <b>best</b>\n para.<p>Short.</p><ul><li>An item of a list</li></ul></article></main>{extra}</body></html>"
    assert main_text(page, TREE) == "A title\n\nFirst & best para.\n\nShort.\n\nAn item of a list"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<html><head><title>x</title><meta charset=utf-8><article><h1>A title</h1><p>{LONG}</p></article>", f"A title\n\n{LONG.strip()}"),
        (f"<title>x</title><link rel=a href=b><main><p>{LONG}</p></main>", LONG.strip()),
        (f"<html><head><title>x</title><style>p {{}}</style><p>{LONG}<p>{LONG}", f"{LONG.strip()}\n\n{LONG.strip()}"),
        (f"<head><title>x</title>{LONG}<p>{LONG}", f"{LONG.strip()}\n\n{LONG.strip()}"),
        (f"<article class='post tag-search category-widgets'><p>{LONG}</p></article>", LONG.strip()),
        (f"<article><p>Press the <label>red</label> button. {LONG}</p></article>", f"Press the red button. {LONG.strip()}"),
        (f"<div class=page><div class=top><a href=/>Home</a> <a href=/a>All news</a></div><h1>A title of some words</h1><p>{LONG}</p><p>{LONG}</p><div class=related><a href=/b>Other {LONG}</a></div></div>", f"A title of some words\n\n{LONG.strip()}\n\n{LONG.strip()}"),
        (f"<table><tr><td><a href=/>Home</a><td><p>{LONG}</p><p>{LONG}</p></table>", f"{LONG.strip()}\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><div class='share-buttons'><a href=/s>Share</a></div><section class='comments'><article class=comment><p>{LONG}</p></article></section></article>", LONG.strip()),
    ],
)
def test_other_styles_of_pages(page, want):
    assert main_text(page, TREE) == want


def test_without_an_article_element():
    page = f"<body><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul><div><p>{LONG}</p><p>{LONG}</p></div><div id=footer>Imprint</div></body>"
    assert main_text(page, TREE) == f"{LONG.strip()}\n\n{LONG.strip()}"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<p class='", "<script>", "<!--", "a < b", "<article>&#x110000; &bogus; &amp", "<nav>" * 2000, "<p>" * 5000 + "</div>" * 5000])
def test_odd_markup_does_not_fail(page):
    assert isinstance(main_text(page, TREE), str)


def test_link_density():
    assert [b[1:3] for b in text_blocks("<div>one <a href=x>two three</a> four</div>")] == [(4, 0.5)]


def test_pages_of_the_driver(spark):
    """Against the markup of the generated pages, read another way."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row, got in zip(sorted(pages.collect(), key=lambda r: r.page_id), sorted(extract(pages).collect(), key=lambda r: r.page_id), strict=True):
        article = re.search(r"<article>(.*?)</article>", row.html, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x.replace("<b>", "").replace("</b>", ""))).split()) for x in re.split(r"</?(?:p|h1|h2|ul|li|blockquote)>", article)]
        assert got.text == "\n\n".join(p for p in parts if p)
        assert got.n_chars == len(got.text) and got.url == row.url


def test_table_rows(spark):
    rows = [(1, "u", None, 5), (1, "u", None, 5), (2, None, "<article><p>é ☃</p></article>", 1), (None, "x", "", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in extract(pages).collect()) == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "é ☃", 3)]
    assert extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "before",
    [
        "<svg class='icon' viewBox='0 0 1 1'/>",
        "<svg><style/><path d='M0 0'/></svg>",
        "<div><svg><path d='M0 0'></div>",
        "<video-player src=x></video-player><button-group><svg-icon></svg-icon></button-group><title-bar></title-bar>",
        "<form><label>Your name<input></form>",
        "<form><select><option>One<option>Two</form>",
        "<nav><button>Menu</nav>",
        "<p><label>Name",
        "<ul><li><button>A<li><label>B</ul>",
        "<button>Menu <b>now</b></button><noscript><p>no script</p></noscript>",
        "<p>" + "<label>" * 3 + "Name</p>",
        "<svg><foreignObject><p>drawn</p></foreignObject></svg>",
        "<math><mi>x</mi></math><iframe src=x></iframe ><textarea><main></textarea>",
    ],
)
def test_unread_elements_end_with_their_parent(before):
    page = f"<body>{before}<main><article><h1>A title</h1><p>First para. {LONG}</p><p>Second <button>Copy</button>para.</p></article></main></body>"
    assert main_text(page, TREE) == f"A title\n\nFirst para. {LONG.strip()}\n\nSecond para."


def test_many_unclosed_elements_take_linear_time():
    assert text_blocks("<div>" + "<object>" * 20000 + "x" + "</p>" * 20000 + "</div><p>seen") == [("seen", 1, 0.0, 0, 0, 1)]

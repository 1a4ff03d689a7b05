import html
import re

import pytest

from lodestone.llm import html_extract as hx

PROSE = "A sentence of the story that goes on for a while, so it is worth reading."


def test_weights_separate_words_from_tags():
    w = hx.default_weights()
    assert all(v < 0 for v in w.tag.values())
    assert w.word["in <article>"] > 0 > w.word["out of <article>"]


@pytest.mark.parametrize("scores", [[], [-1.0], [1, -2, 3, 4, -1, 2, -9, 5], [0.5, -0.1, 0.4]])
def test_best_run_is_the_maximum(scores):
    a, b = hx.best_run(scores)
    every = [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    assert sum(scores[a:b]) == pytest.approx(max([0.0, *every]))


@pytest.mark.parametrize("open_,end", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div>", "</div>")])
def test_layouts(open_, end):
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><header><a href='/'>Site</a></header>
      <nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav><div class='ad'>Buy now</div>
      {open_}<h1>Title &amp; more</h1><p>{PROSE}<p>{PROSE}<br>second &lt;line&gt; <a href='/x'>link</a></p><script>var t="</p>";</script>
      <ul><li>first</li><li>second</li></ul><p>{PROSE}</p>{end}
      <div id='comments'><p>I agree with all of this, well said by the author.</p></div><form><p>Leave your mail</p></form>
      <div class='cookie-notice'>We use cookies</div><footer>&copy; us</footer></body></html>"""
    assert hx.extract(page).split("\n\n") == ["Title & more", PROSE, f"{PROSE} second <line> link", "first", "second", PROSE]


@pytest.mark.parametrize("open_,end", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div>", "</div>")])
@pytest.mark.parametrize("aside", ["<form><p>{}</p></form>", "<div class='ad'>{}</div>", "<aside><h3>{}</h3></aside>", "<div class='related'><ul>{}</ul></div>"])
def test_long_asides_inside_the_article(open_, end, aside):
    inside = "<li>more to read here</li>" * 60 if "<ul>" in aside else "sign up for our letter " * 40
    menu = "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav>"
    page = f"<html><body>{menu}{open_}<h1>Title</h1><p>{PROSE}</p>{aside.format(inside)}<p>{PROSE}</p><p>{PROSE}</p>{end}<footer>about us</footer></body></html>"
    assert hx.extract(page).split("\n\n") == ["Title", PROSE, PROSE, PROSE]


def test_a_menu_parts_the_page():
    page = f"<body><div>A slogan</div><nav><ul><li><a href='/a'>Home page</a><li><a href='/b'>All news</a></ul></nav><div><p>{PROSE}</p></div></body>"
    assert hx.extract(page) == PROSE
    toc = "<nav class='toc'><ul>" + "<li><a href='#x'>part of it</a></li>" * 40 + "</ul></nav>"
    assert hx.extract(f"<body><article><p>{PROSE}</p>{toc}<p>{PROSE}</p></article></body>") == f"{PROSE}\n\n{PROSE}"


@pytest.mark.parametrize("tag", ["<p title=it's>", "<p title=5\">", "<p data-x=a'b\"c class=x>", "<p title='a > b' id=\"x's\">", "<p it's>", "<p title = \"a'b\" >", "<p title=>", "<p a=b=c'd>"])
def test_quotes_in_tags(tag):
    page = f"<article>{tag}one two three four</p><p>more text here and there</p></article>"
    assert hx.extract(page) == "one two three four\n\nmore text here and there"


def test_unclosed_links_end_with_their_block():
    page = f"<body><div><p><a href=/x>see this</div><div><a name=top><p>{PROSE}</p></div></body>"
    assert PROSE in hx.extract(page)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- never ends", "<script>x", "</p></div>", "<a href='x"])
def test_no_text(page):
    assert hx.extract(page) in ("", "<")


def test_whole_table_against_its_marked_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in hx.extract_pages(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<(?!/?(?:p|h1)\b)[^>]*>", " " if "<br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        want = "\n\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (2, None, f"<article><p>{PROSE}", "x"), (None, "v", "<p>" + "word " * 200_000, "x")]
    got = hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, len(PROSE), 999_999]
    assert hx.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

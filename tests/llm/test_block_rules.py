"""Each rule of the two passes decides some block: without it these tests fail."""

import html

import pytest
from pyspark.sql import functions as F

from windowmill.llm import html_text

DENSE = "This is the story of the town and of the people who lived in it for all of the years that it was there by the sea."
MID = "The river mouth harbour boats bring fish daily to the crowded wooden market stalls near old stone bridges where traders shout prices, weigh baskets, argue loudly, pack ice, load carts and sweep floors, count coins and leave."
SPARSE = "Red 12 Blue 13 Green 14 Black 15 White 16 Grey 17 Brown 18 Pink 19 Gold 20 Lime 21 Teal 22 Navy 23 Plum 24"
LINKS = '<p><a href=/>This is the first of the links</a> <a href=/x>and this is the other one of the links</a></p>'


def page(*blocks):
    return "<body>" + "".join(b if b.startswith("<") else f"<p>{b}</p>" for b in blocks) + "</body>"


def test_density_decides():
    assert html_text.extract(page(DENSE, SPARSE, DENSE)) == f"{DENSE}\n\n{DENSE}"


def test_length_decides():
    assert html_text.first_pass(MID, 0, False) == html_text.GOOD and html_text.first_pass(MID[:120], 0, False) is html_text.OPEN
    assert html_text.first_pass("This is the end of it", 0, False) is html_text.OPEN


def test_link_density_decides():
    assert html_text.extract(page(DENSE, LINKS)) == DENSE
    assert html_text.extract(page(f'<p>{DENSE} <a href="/x">More</a></p>')) == f"{DENSE} More"


def test_second_pass_decides():
    assert html_text.extract(page(DENSE, "Chapter two", DENSE)) == f"{DENSE}\n\nChapter two\n\n{DENSE}"
    assert html_text.extract(page(LINKS, "Read more", LINKS, DENSE)) == DENSE
    assert html_text.extract(page(DENSE, "By the sea", LINKS)) == f"{DENSE}\n\nBy the sea"  # the good neighbour where they disagree
    found = html_text.blocks(page(DENSE, "Chapter two", DENSE))
    label = [html_text.first_pass(t, n, dark) for t, n, dark, *_ in found]
    assert label == [html_text.GOOD, html_text.OPEN, html_text.GOOD] and html_text.second_pass(found, label) == [html_text.GOOD] * 3


def test_what_stands_outside_the_article_is_no_part_of_it():
    comment = f"<div><p>{DENSE} I was there too.</p></div>"
    inner = f"<h1>Heading</h1><p>{DENSE}</p><table><tr><td>{SPARSE}</td></tr></table><section class=related-work><h2>Related work</h2><p>{DENSE}</p></section><p class=legal>All of it is true.</p>"
    text = html_text.extract(f"<body><div>Home and News</div><div>1 May 2024</div><article>{inner}</article>{comment}<div id=comments><p>{DENSE}</p></div></body>")
    assert text == "\n\n".join(["Heading", DENSE, SPARSE, "Related work", DENSE, "All of it is true."])


def test_menu_of_bare_links():
    assert html_text.extract(page("<div><a href=/>Home</a> <a href=/n>News and more of the news</a></div>", DENSE)) == DENSE
    assert html_text.extract(page('<p><a name="top"/>' + DENSE + "</p>", "<br/>", '<img src="x"/>')) == DENSE


def plain(article):
    """The text of an article of h1 and p elements, by cutting at tags."""
    for cut in ("<h1>", "</h1>", "<p>", "</p>"):
        article = article.replace(cut, "\0")
    for tag in ("<b>", "</b>"):
        article = article.replace(tag, "")
    blocks = [" ".join(html.unescape(b.replace("<br>", " ")).split()) for b in article.split("\0")]
    return "\n\n".join(b for b in blocks if b)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_pages_equal_a_plain_cut_of_their_article(spark, size):
    for r in spark.read.parquet(f"/root/testdata/{size}/pages.parquet").collect():
        assert html_text.extract(r.html) == plain(r.html.partition("<article>")[2].partition("</article>")[0]), r.page_id


def test_odd_rows(spark):
    long = f"<article><p>{'This is a word of it. ' * 40_000}</p></article>"
    rows = [(1, "u", long), (1, "u", long), (1, "v", "<p>a</p>"), (2, None, None), (None, "w", "<!--"), (3, "x", "<p>&amp;&#x41;&nbsp;&unknown;</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars")})
    found = sorted((r.page_id or 0, r.url or "", r.n_chars, r.text[:9]) for r in html_text.main_text(pages).collect())
    size = 22 * 40_000 - 1
    assert found == [(0, "w", 0, ""), (1, "u", size, "This is a"), (1, "u", size, "This is a"), (1, "v", 1, "a"), (2, "", 0, ""), (3, "x", 12, "&A &unkno")]
    assert html_text.main_text(pages.filter("false")).count() == 0

"""Pages of other scripts, comments as articles, stray tags, what scripts part."""

import time

import pytest

from windowmill.llm import html_text

LONG = "This is the first paragraph of the article and it has a lot of words, as it is the text that is to be kept by the reader of the page, who has come to it for the story."
RUSSIAN = "Вчера вечером в городе открылась новая библиотека, и жители пришли посмотреть на неё. Директор сказал, что здесь будет десять тысяч книг, зал для чтения и детская комната."
CHINESE = "昨天晚上，城里的新图书馆开放了，许多居民前来参观。馆长说，这里将有一万本书、一个阅览室和一个儿童房间，欢迎大家常来。"
ITALIAN = "Ieri sera nella città è stata aperta la nuova biblioteca, e gli abitanti sono venuti a vederla. Il direttore ha detto che ci saranno diecimila libri, una sala di lettura e una stanza dei bambini."
MENU = "<ul><li><a href=/>Начало</a></li><li><a href=/n>Новости и статьи</a></li></ul>"


@pytest.mark.parametrize("text", [RUSSIAN, CHINESE, ITALIAN])
def test_no_language_gives_an_empty_text(text):
    assert html_text.extract(f"<body>{MENU}<div><p>{text}</p><p>{text}</p></div><div class=ad>{text}</div></body>") == f"{text}\n\n{text}"


def test_comments_and_teasers_are_no_articles():
    page = f"<body><article><h1>Heading</h1><p>{LONG}</p></article><section class=discussion><article class='comment-body'><p>{LONG} I was there.</p></article></section><article class='teaser related'><p>{LONG}</p></article></body>"
    assert html_text.extract(page) == f"Heading\n\n{LONG}"
    assert html_text.extract(f"<body><article class='post related-posts-on'><p>{LONG}</p></article></body>") == LONG


def test_rights_are_no_text():
    assert html_text.extract(f"<body><div><p>{LONG}</p><p>Copyright 2024 by the town and all of its people. All rights reserved.</p></div></body>") == LONG


def test_the_end_of_an_article_is_kept_behind_links():
    links = "<ul><li><a href=/a>This is the first of the links</a></li></ul>"
    assert html_text.extract(f"<article><p>{LONG}</p>{links}<p>It was late.</p></article>") == f"{LONG}\n\nIt was late."


def test_a_script_parts_no_paragraph():
    assert html_text.extract(f"<article><p>{LONG} one <script>x</script> two</p></article>") == f"{LONG} one two"


@pytest.mark.parametrize("tags", [("<b>", "</i>"), ("<i><p><b>", "</i>"), ("<p><b>", "</x>"), ("<b>", "<p>"), ("<div>", "</p>")])
def test_stray_tags_take_time_in_proportion(tags):
    page = tags[0] * 60_000 + LONG + tags[1] * 60_000
    began = time.process_time()
    assert LONG in html_text.extract(page)
    assert time.process_time() - began < 5


@pytest.fixture(scope="module")
def renamed():
    """Pages without any article element, and the blocks of their articles."""
    import pandas

    pages = pandas.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    return [(h.replace("<article>", "<div>").replace("</article>", "</div>"), html_text.extract(h).split("\n\n")) for h in pages]


def kept(renamed):
    """The share of the articles' blocks that the rules find by themselves, and how many others."""
    from collections import Counter

    found = [(Counter(html_text.extract(h).split("\n\n")), Counter(blocks)) for h, blocks in renamed]
    return sum((a & b).total() for a, b in found) / sum(b.total() for _, b in found), sum((a - b - Counter([""])).total() for a, b in found)


def test_the_passes_find_articles_by_themselves(renamed):
    share, others = kept(renamed)
    assert share >= 0.97 and others == 0


def test_without_either_pass_they_do_not(renamed, monkeypatch):
    first, second = html_text.first_pass, html_text.second_pass
    monkeypatch.setattr(html_text, "second_pass", lambda found, label: [x if x is not html_text.OPEN else html_text.BAD for x in label])
    assert kept(renamed)[0] < 0.9
    monkeypatch.setattr(html_text, "second_pass", second)
    monkeypatch.setattr(html_text, "first_pass", lambda text, linked, hidden, *_: html_text.BAD if hidden else html_text.GOOD)
    assert kept(renamed)[1] > 0 or kept([(h.replace("<nav>", "<div>").replace("</nav>", "</div>"), b) for h, b in renamed])[1] > 0
    monkeypatch.setattr(html_text, "first_pass", first)

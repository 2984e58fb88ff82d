"""Names that hint at boilerplate, on elements that hold the article."""

import pytest

from windowmill.llm import html_text

LONG = "This is the first paragraph of the article and it has a lot of words, as it is the text that is to be kept by the reader of the page, who has come to it for the story that was told in it and for nothing else at all."
ARTICLE = f"<h1>Heading</h1><p>{LONG}</p><p>Short one.</p>"
KEPT = f"Heading\n\n{LONG}\n\nShort one."


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar content", "no-sidebar", "search-result legal"])
def test_hinted_containers_keep_the_article(name):
    assert html_text.extract(f"<body><div class='{name}'><main><article>{ARTICLE}</article></main></div></body>") == KEPT
    assert html_text.extract(f"<body><div class='{name}'>{ARTICLE}</div></body>") == KEPT


@pytest.mark.parametrize("start, end", [("<div class=ad>", "</div>"), ("<div id='comments'>", "</div>"), ("<div class='cookie-notice'>", "</div>"), ("<nav>", "</nav>"), ("<aside>", "</aside>")])
def test_hard_drops_stay(start, end):
    assert html_text.extract(f"<body><article>{ARTICLE}</article>{start}<p>{LONG}</p>{end}</body>") == KEPT


def test_short_blocks_of_a_side_column_stay_out():
    assert html_text.extract(f"<body><div class='sidebar'><p>Read this too</p><p>And that</p></div><article>{ARTICLE}</article></body>") == KEPT

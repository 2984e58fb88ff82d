"""Main-text extraction from HTML by two passes of block rules.

A page is cut into blocks at block-level tags. Blocks inside navigation, headers
outside an article, footers, asides, forms, scripts and the like, hidden elements,
or elements whose whole class or id is that of an advert, notice or comment list,
are boilerplate from the start.

The first pass classifies every other block by stop-word density, length and link
density: mostly links is bad; dense, or long and not sparse, is good; long and
sparse is bad, or undecided inside an article, where tables and lists stand; short
is undecided. A name that hints at boilerplate, as one part of a class or id outside
an article, asks for a longer and denser block.

On a page of a language whose stop words are not known, sentence marks stand for them,
and where no block is good, the long ones without links are.

In the second pass an undecided block takes the label of its nearest decided
neighbours on its side of the article's bounds, which count as good, and in the same
hinted element, the good one where they disagree. If there are none, it is good inside an article and
bad inside hinted elements; elsewhere it is good only on a page where nothing is
decided. Where an article or main element holds a good block, what stands outside
all of them is no part of the article.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
DROPPED = frozenset("script style noscript template svg math iframe object canvas head nav footer aside form button select textarea dialog menu audio video map".split())
RAW = frozenset("script style noscript template textarea title svg math iframe canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?\w*|consent|gdpr|notice\w*|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|sidebar|side|widget|menu|nav\w*|breadcrumbs?|pagination|pager|footer|foot|masthead|toolbar|comments?|commentlist|disqus|respond|replies|reply|search|skip|copyright|legal|disclaimer)(?:$|[\s_-])"
)
#: Whole names that are boilerplate whatever they hold.
EXACT = re.compile(
    r"(?:ads?|advert|adverts|advertisements?|advertising|adsense|sponsor|sponsors|sponsored|notices?|gdpr|cookies?|(?:ads?|advert\w*|sponsor\w*|promo\w*)[_-](?:box|banner|block|slot|unit|container|wrapper)|(?:cookies?|gdpr|consent|privacy)[_-](?:notice|banner|bar|popup|consent|message)|comments?|comments?[_-](?:list|section|area|form)|commentlist|disqus|disqus[_-]thread)"
)
#: Names of articles that are comments on another, or point to others.
NO_ARTICLE = re.compile(r"(?:comments?|reply|replies|teasers?|related|recommend(?:ed|ation)?s?|promos?|sponsored)(?:[_-](?:body|item|post|content|box|entry|article|card|link)s?)?")
#: Marks that end or part sentences, in any script.
_MARKS = re.compile(r"[.!?,;:…。、，！？；：؟،۔।]")
_RIGHTS = re.compile(r"^\W*(?:copyright\b|\(c\)|©)|all rights reserved", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
STOP_WORDS = frozenset(
    """a an and are as at be by for from had has have he her his in is it its not of on or she that the their there they this to was were which will with you
    le la les l de des du d un une et en est que qui dans pour pas sur au aux avec ce cette il elle ils on par plus ou se sont son sa
    der die das den dem des ein eine einer eines und ist in im zu zur zum nicht mit auf für von sich auch als an am es sie er wie bei aus nach
    el la los las de del y en un una que es se no por con para su al lo como más o pero sus le ha""".split()
)
GOOD_DENSITY, LOW_DENSITY, LINKED, SHORT, LONG = 0.20, 0.10, 0.5, 70, 200
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/][^>]*\Z|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
#: A slash that closes the element, not the end of a value as in ``<a href=/>``.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
GOOD, BAD, OPEN = 1, 0, None


def _judge(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """(boilerplate whatever it holds, a name hints at boilerplate) of an element by itself."""
    if name in DROPPED or (name == "header" and not in_article):
        return True, False
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False, False
    if name in ("html", "body", "main"):
        return False, False
    if name == "article":  # comments and teasers are articles as well
        named = " ".join("".join(values) for key, *values in _ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id"))
        return any(NO_ARTICLE.fullmatch(part) for part in named.lower().split()), False
    hint = False  # names inside an article tell nothing about its text
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True, False
        if key == "role" and value in ROLES:
            return True, False
        if key in ("class", "id"):
            if any(EXACT.fullmatch(part) for part in value.split()):
                return True, False
            hint = hint or not in_article and bool(HINTS.search(re.sub(r"[^a-z0-9\s_-]", " ", value)))
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
    return False, hint


def blocks(html: str) -> list[tuple[str, int, bool, bool, int]]:
    """(text, characters in links, boilerplate, in an article, hinted element or 0) of each block in page order."""
    out: list[tuple[str, int, bool, bool, int]] = []
    stack: list[tuple[str, bool, int]] = []  # name, boilerplate, outermost hinted element since the last article
    where: dict[str, list[int]] = defaultdict(list)  # the places of open elements by name, and of block elements, so that no tag walks the stack
    standing: list[int] = []
    text: list[str] = []
    linked = in_link = 0
    articles, dark, hinted, hints = 0, False, 0, 0

    def end() -> None:
        nonlocal linked
        joined = " ".join(unescape("".join(text)).split())
        if joined:
            out.append((joined, min(linked, len(joined)), dark, articles > 0, hinted))
        text.clear()
        linked = 0

    def push(name: str) -> None:
        where[name].append(len(stack))
        if name in BLOCKS:
            standing.append(len(stack))
        stack.append((name, dark, hinted))

    def pop() -> None:
        name = stack.pop()[0]
        where[name].pop()
        if name in BLOCKS:
            standing.pop()

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.match(html, at)
        if m is None:
            break
        at = m.end()
        closing, name, attributes, words = m.groups()
        if words is not None:
            text.append(words)
            if in_link:
                linked += len(words.strip())
            continue
        if name is None:
            continue
        name = name.lower()
        block = name in BLOCKS or name in DROPPED
        if closing:
            depth = where[name][-1] if where.get(name) else None
            if name == "a":
                in_link = max(0, in_link - 1)
            if depth is None:
                if block:
                    end()
                continue
            if block:
                end()
            elif standing and standing[-1] >= depth:
                continue  # a stray inline end tag closes no block
            while len(stack) > depth:
                articles -= stack[-1][0] in ("article", "main")
                pop()
            dark, hinted = stack[-1][1:] if stack else (False, 0)
            continue
        if name in ("br", "wbr"):
            text.append(" " if name == "br" else "")
            continue
        if block and name not in RAW:  # what is skipped whole ends no block
            end()
        if name in VOID or (name not in RAW and _CLOSED.search(attributes)):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else size
            continue
        if name == "a":
            in_link = 1  # a link ends where the next one starts
        if name in ("p", "li", "dt", "dd", "tr", "td", "th") or (block and stack and stack[-1][0] == "p"):
            closes = {"p"} if name not in ("dt", "dd", "td", "th") else {"p", "dt", "dd", "td", "th"}
            while stack and (stack[-1][0] in closes or stack[-1][0] not in BLOCKS and where.get("p") or (name in ("li", "tr") and stack[-1][0] == name)):
                if stack[-1][0] == "a":
                    in_link = max(0, in_link - 1)
                pop()
            dark, hinted = stack[-1][1:] if stack else (False, 0)
        if name == "body":
            if where.get("head"):  # a head that was not closed ends here
                while stack and where["head"]:
                    pop()
            dark, hinted = stack[-1][1:] if stack else (False, 0)
        hide, hint = _judge(name, attributes, articles > 0)
        hide, group = dark or hide, 0 if name in ("article", "main") else hinted
        if hint and not group:
            group = hints = hints + 1
        if not block and (hide, group) != (dark, hinted):
            end()
        dark, hinted = hide, group
        articles += name in ("article", "main")
        push(name)
    end()
    return out


def density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(text: str, linked: int, hidden: bool, in_article: bool = False, hinted: bool = False, foreign: bool = False) -> int | None:
    """``foreign``: on a page of a language without known stop words, sentence marks stand for them."""
    if hidden or linked > LINKED * len(text) or (not in_article and len(text) < LONG and _RIGHTS.search(text)):
        return BAD
    if len(text) < (LONG if hinted else SHORT) // (2 if foreign and text[len(text) // 2] > "\u2e80" else 1):  # signs that are words or syllables say more
        return OPEN
    if foreign:
        return GOOD if len(_MARKS.findall(text)) * 100 >= len(text) and not hinted else OPEN
    dense = density(text)
    if dense >= GOOD_DENSITY or (not hinted and dense >= LOW_DENSITY and len(text) >= LONG):
        return GOOD
    if dense >= LOW_DENSITY and not hinted:
        return OPEN
    return OPEN if in_article else BAD


def second_pass(found: list[tuple[str, int, bool, bool, int]], label: list[int | None]) -> list[int | None]:
    """Labels where each undecided block has taken that of its nearest decided neighbours, if it has any."""
    near: list[list[int]] = [[] for _ in found]
    for order in (range(len(found)), range(len(found) - 1, -1, -1)):
        last: dict[tuple[bool, int], int] = {}
        for i in order:
            _, _, hidden, *place = found[i]
            if label[i] is OPEN and tuple(place) in last:
                near[i].append(label[last[tuple(place)]])
            elif label[i] is OPEN and place[0]:
                near[i].append(GOOD)  # the bounds of an article count as good
            elif label[i] is not OPEN and not hidden:
                last[tuple(place)] = i
    return [max(others) if own is OPEN and others else own for own, others in zip(label, near, strict=True)]


def extract(html: str | None) -> str:
    """The article's blocks, white space collapsed, joined by an empty line."""
    found = blocks(html or "")
    foreign = not any(density(text) >= (LOW_DENSITY + GOOD_DENSITY) / 2 for text, _, hidden, *_ in found if not hidden and len(text) >= SHORT // 2)
    label = [first_pass(text, linked, hidden, inside, hinted > 0, foreign) for text, linked, hidden, inside, hinted in found]
    if GOOD not in label:  # the long blocks without links stand for dense ones
        label = [GOOD if not (linked or hidden or hinted) and len(text) >= SHORT and not _RIGHTS.search(text) else x for x, (text, linked, hidden, _, hinted) in zip(label, found, strict=True)]
    label = second_pass(found, label)
    article = any(x != BAD and inside for x, (*_, inside, _) in zip(label, found, strict=True))
    decided = any(x is not OPEN and not hidden for x, (_, _, hidden, *_) in zip(label, found, strict=True))
    kept = []
    for (text, _, _, inside, hinted), x in zip(found, label, strict=True):
        if x is OPEN:
            x = GOOD if inside or not (hinted or decided) else BAD
        if x == GOOD and (inside or not article):
            kept.append(text)
    return "\n\n".join(kept)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h) for h in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row, without a shuffle: page_id, url, text, n_chars.

    A null, empty or text-free html gives an empty text. Broken or cut markup is
    read as far as it goes. Null ids and urls, and repeated rows, stay as they
    are; other columns are ignored.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(_run, f"page_id {own.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the main text of all pages."""
    from windowmill.llm import common

    return main_text(common.table(spark, sf_dir, "pages"))

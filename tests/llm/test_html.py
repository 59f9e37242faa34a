import html as stdlib
import re
from collections import Counter

import pytest

from lettermill.llm import html

PROSE = "The first thing that is of note in this text is that it has words of the kind that are in prose. "


def brute(page):
    """The article of the synthetic pages: all between the article tags, without mark-up."""
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    return " ".join(stdlib.unescape(re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", re.sub(r"</?(?:p|br|h1)\b[^>]*>", " ", inside))).split())


def test_pages(spark):
    for folder in ("sf0.01", "sf0.1"):
        for r in spark.read.parquet(f"/root/testdata/{folder}/pages.parquet").collect():
            assert html.main_text(r["html"]) == brute(r["html"]), r["page_id"]


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("   ", ""),
        ("<p>unclosed <b", ""),
        ("<article><p>a &lt;b&gt; &amp; c&nbsp;d</article>", "a <b> & c d"),
        ("<article><h1>T</h1><p>One<i>two</i>.<br>Three</p><div class='comments'><p>" + PROSE + "</p></div></article>", "T Onetwo. Three"),
        ("<main><form><p>" + PROSE + "</p></form><p>Ok.</p><script>var a='</p>';</script></main>", "Ok."),
        ("<body><nav><a href=x>Home</a></nav><h1>Title here</h1><p>" + PROSE * 2 + "</p><p>Short one.</p><p>" + PROSE + "</p><ul><li><a href=1>more</a></ul><footer>" + PROSE + "</footer></body>", f"Title here {(PROSE * 2).strip()} Short one. {PROSE.strip()}"),
        ("<div id='cookie-notice'>" + PROSE + "</div><div class=content><p>" + PROSE + "</p></div>", PROSE.strip()),
        ("<article><!-- x --><p>a<!-- never ends", "a"),
        ("<article><p>a < b</p></article>", "a < b"),
        ("<article><p>a</p><aside>" + PROSE + "</aside><p>b</p></article><section id=comments><p>" + PROSE + "</p></section>", "a b"),
        ("<article><header><h1>T</h1></header><p>x y</p></article>", "T x y"),
        ("<article class='post'><p title='a > b'>x</p><svg><text>no</text></svg></article>", "x"),
    ],
)
def test_cases(page, text):
    assert html.main_text(page).strip() == text


def test_broken_pages_stay_linear():
    for page in ("<" * 200_000, "<a " * 100_000, "<!--" * 100_000, "<script>" * 50_000, "&" * 200_000, "<div>" * 100_000, "<p a='" * 50_000, "</div>" * 100_000, "<textarea>" * 50_000):
        html.main_text(page)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (2, "u", "<article>x</article>", "t"), (2, "u", "<article>x</article>", "t"), (None, None, "<p>", "t")], "page_id long, url string, html string, text string")
    assert sorted((tuple(r) for r in html.extract_main_text(df).collect()), key=str) == sorted([(1, None, ""), (2, "u", "x"), (2, "u", "x"), (None, None, "")], key=str)
    assert html.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<nav><ul>" + "<li><span>go" * 64 + "</ul></nav><p>" + PROSE * 2 + "</p>", (PROSE * 2).strip()),
        ("<div class=menu>" + "<font>x" * 500 + "</div><article><p>a b</p></article>", "a b"),
        ("<article><p data-x='" + "<b>no</b> " * 5000 + "'>x</p></article>", "x"),
        ('<article><p>a</p><img src="data:image/svg+xml,' + "<path d='M0'/>" * 4000 + '"><p>b</p></article>', "a b"),
    ],
)
def test_no_reach(page, text):
    assert html.main_text(page).strip() == text


def test_quotes_stay_linear():
    for page in ("<p a='>'\"" * 60_000, "<p a='>" * 100_000, "<p a=\">'" * 60_000, "<div><span>" * 50_000 + "</p></div>" * 50_000):
        html.main_text(page)


def test_words_decide_without_the_article_mark(spark):
    """With the article's tag a plain div, at least 99 % of its words stay and no word of the furniture comes in."""
    for folder in ("sf0.01", "sf0.1"):
        lost = total = 0
        for r in spark.read.parquet(f"/root/testdata/{folder}/pages.parquet").collect():
            page = re.sub(r"<(/?)article>", r"<\1div>", r["html"])
            want, got = Counter(brute(r["html"]).split()), Counter(html.main_text(page).split())
            assert not got - want, r["page_id"]
            lost, total = lost + (want - got).total(), total + want.total()
        assert lost <= 0.01 * total


LIST = "<ul>" + "".join(f"<li><a href=/{k}>Topic number {k}</a></li>" for k in range(12)) + "</ul>"
SHORT = "Not long."


@pytest.mark.parametrize(
    "page, text",
    [
        # Only words and links speak here: no tag or class says anything.
        (f"<div>{LIST}</div><div><h1>On kinds of texts</h1><p>{PROSE * 2}</p><p>{SHORT}</p><p>{PROSE}</p></div><div>{LIST}</div>", f"On kinds of texts {(PROSE * 2).strip()} {SHORT} {PROSE.strip()}"),
        (f"<div><p>{SHORT}</p></div>", ""),
        (f"<div><p>{SHORT}</p><p>{PROSE * 2}</p></div>", f"{SHORT} {(PROSE * 2).strip()}"),
        (f"<div>{LIST}<p>{SHORT}</p></div><div><p>{PROSE * 2}</p></div>", (PROSE * 2).strip()),
        (f"<div><p>{'<a href=x>word</a> ' * 30}</p></div><div><p>{'tokio osaka kioto ' * 20}</p></div>", ("tokio osaka kioto " * 20).strip()),
        # Inside an article link density still counts.
        (f"<article><p>{PROSE * 2}</p><div>{LIST}</div></article>", (PROSE * 2).strip()),
        # Prose outside of the article has to be long.
        (f"<article><p>{SHORT}</p></article><div><p>{PROSE}</p></div>", SHORT),
        (f"<article><p>{SHORT}</p></article><div><p>{PROSE * 4}</p></div>", f"{SHORT} {(PROSE * 4).strip()}"),
        # A form around the whole page is no furniture.
        (f"<form action=/><div class=menu>{LIST}</div><div><h1>Title</h1><p>{PROSE * 2}</p></div><form><p>{PROSE}</p></form></form>", f"Title {(PROSE * 2).strip()}"),
    ],
)
def test_both_passes(page, text):
    assert html.main_text(page) == text

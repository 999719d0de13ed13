"""Main text against what pages were made of, and edge cases."""

from __future__ import annotations

import html as escapes
import re

from tillsight.llm import htmltext

SENTENCES = [f"This is sentence {i} of the article & it says something <about> topic {i}." for i in range(12)]


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><script>if (a<b) x('</p>');</script></head><body>{body}</body></html>"


def article(lines, open_="<article>", close="</article>"):
    return open_ + "".join(f"<p>{escapes.escape(x)}</p>" for x in lines) + close


NOISE = (
    "<header><div>Site name</div><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies on this site to improve what you see every day.</div>"
    "<aside><p>Read also this long teaser about other things that happened today.</p></aside>"
)
AFTER = (
    "<section id=comments><p>I do not agree with this article at all, it is far too long.</p></section>"
    "<form><p>Write to us</p><input><button>Send</button></form><div class=ad>Buy this thing now, it is cheap and good.</div>"
    "<footer>&copy; 2024</footer>"
)


def test_article_among_noise():
    assert htmltext.main_text(page(NOISE + article(SENTENCES) + AFTER)) == "\n".join(SENTENCES)


def test_without_article_element():
    for open_, close in (("<div id=content>", "</div>"), ("<div>", "</div>"), ("<main>", "</main>")):
        assert htmltext.main_text(page(NOISE + article(SENTENCES, open_, close) + AFTER)) == "\n".join(SENTENCES)


def test_inside_the_article():
    inner = "<article><header><h1>Title  here</h1></header><p>Short.</p>" + article(SENTENCES, "", "")
    inner += "<div class='share social'>Share this</div><ul><li>one<li>two</ul><p>a<br>b&nbsp;c\n d</p></article>"
    assert htmltext.main_text(page(NOISE + inner + AFTER)) == "\n".join(["Title here", "Short.", *SENTENCES, "one", "two", "a b c d"])


def test_unmarked_rest_and_telling_classes():
    lines = SENTENCES[:4]
    rest = "<div>" + "".join(f"<p>Reader {i} writes a long answer that nobody marked as such.</p>" for i in range(6)) + "</div>"
    nested = "<div class='wrap has-sidebar'>" + article(lines, "<article class='post no-comments'>") + rest + "</div>"
    assert htmltext.main_text(page(NOISE + nested + AFTER)) == "\n".join(lines)
    comments = "<div class=responses>" + article(SENTENCES[6:], "<article class=comment>") + "</div>"
    assert htmltext.main_text(page(article(lines) + comments)) == "\n".join(lines)
    several = article(lines) + article(SENTENCES[4:8])
    assert htmltext.main_text(page(NOISE + several + AFTER)) == "\n".join(SENTENCES[:8])


def test_sections_with_listed_words_stay():
    half = len(SENTENCES) // 2
    for open_ in ("<section id='search-order'>", "<section id=discussion>", "<section id='login-flow'>", "<div class='related-work'>"):
        close = "</div>" if "div" in open_ else "</section>"
        for outer in ("article", "main"):
            inner = article(SENTENCES[:half], "", "") + article(SENTENCES[half:], open_, close)
            text = htmltext.main_text(page(NOISE + f"<{outer}>{inner}</{outer}>" + AFTER))
            assert text == "\n".join(SENTENCES), (open_, outer)
    inner = "<header class='entry-header'><h1>Title</h1></header><div class='entry-content'>" + article(SENTENCES, "", "") + "</div>"
    inner += "<h2 id=comments>Comments</h2><p>Last words.</p>"
    got = htmltext.main_text(page(NOISE + f"<article>{inner}</article>" + AFTER))
    assert got == "\n".join(["Title", *SENTENCES, "Comments", "Last words."])


def test_comments_beside_the_article_go():
    comments = "<div id=comments><p>I do not agree with this article at all, it is far too long.</p></div>"
    for outer in ("<main>", "<main><div class=content>"):
        assert htmltext.main_text(page(NOISE + outer + article(SENTENCES) + comments + "</main>" + AFTER)) == "\n".join(SENTENCES)


def test_inner_containers_do_not_replace_the_whole():
    card = article(SENTENCES[8:], "<article>")
    assert htmltext.main_text(page(NOISE + article(SENTENCES[:8], "<main>", "") + card + "</main>" + AFTER)) == "\n".join(SENTENCES)
    story = article(SENTENCES[:10], "<div class=story>", "</div>") + article(SENTENCES[10:], "<div>", "</div>")
    assert htmltext.main_text(page(NOISE + story + AFTER)) == "\n".join(SENTENCES)
    assert htmltext.main_text(page(NOISE + f"<main>{story}</main>" + AFTER)) == "\n".join(SENTENCES)
    two = article(SENTENCES[:10]) + article(SENTENCES[10:])
    assert htmltext.main_text(page(NOISE + two + AFTER)) == "\n".join(SENTENCES)


def test_names_with_listed_words_outside_of_articles():
    half = article(SENTENCES[:6], "", "") + article(SENTENCES[6:], "<div class='login-steps'>", "</div>")
    assert htmltext.main_text(page(NOISE + f"<div id=post>{half}</div>" + AFTER)) == "\n".join(SENTENCES)
    for name in ("site-footer", "main-nav-wrapper", "cookie-banner-2", "comments-area", "sidebar-right", "related-posts"):
        noise = f"<div class='{name}'><p>Some words that are not part of the article at all, but long.</p></div>"
        assert htmltext.main_text(page(noise + article(SENTENCES, "<div>", "</div>") + noise)) == "\n".join(SENTENCES), name


def test_no_container_loses_nothing():
    two = article(SENTENCES[:3], "<div>", "</div>") + article(SENTENCES[3:], "<div>", "</div>")
    assert htmltext.main_text(page(NOISE + two + AFTER)) == "\n".join(SENTENCES)
    bare = "<h1>Title</h1>" + article(SENTENCES, "", "") + "<p>End.</p>"
    assert htmltext.main_text(page(NOISE + bare + AFTER)) == "\n".join(["Title", *SENTENCES, "End."])
    links = "<div><a href=a>One thing</a> <a href=b>Another thing to read</a></div>"
    assert htmltext.main_text(page(links + bare + links)) == "\n".join(["Title", *SENTENCES, "End."])


def test_unclosed_elements_before_the_article():
    for tag in ("nav", "aside", "header"):
        got = htmltext.main_text(page(f"<{tag}><p>Other things to read</p>" + article(SENTENCES) + AFTER))
        assert got == "\n".join(SENTENCES), tag
    closed = "<aside>" + article(SENTENCES[:2], "<article class=x>") + "</aside>" + article(SENTENCES[2:])
    assert htmltext.main_text(page(closed)) == "\n".join(SENTENCES[2:])


def test_broken_markup():
    text = htmltext.main_text(page(NOISE + "<article><h1>A &am</h1><p><b>B &amp;lt; c<br><p>D</b> e<p>f") + "")
    assert text == "A &am\nB &lt; c\nD e\nf"


def test_edge_cases(spark):
    long = page(article(["word " * 200_000 + "end & more"]))
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "  \n", None), (4, "u", "plain text", "x"), (5, "u", long, "x"),
            (5, "u", long, "x"), (6, "u", page(NOISE), "x"), (None, None, page(article(["é日🙂"])), None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    got = htmltext.extracted(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: (r.text, r.n_chars) for r in got.collect()}
    assert got.count() == len(rows)
    assert found[1] == found[2] == found[3] == ("", 0) and found[4] == ("plain text", 10)
    assert found[5][0].endswith("word end & more") and found[5][1] == 200_000 * 5 + 10
    assert found[None] == ("é日🙂", 3)
    assert htmltext.query(pages.limit(0)).count() == 0


def test_given_pages(spark, folder):
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    for row in rows:
        body = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        parts = (" ".join(escapes.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert htmltext.main_text(row.html) == "\n".join(x for x in parts if x)


def test_smoothing_and_threshold():
    import numpy as np

    values = htmltext.smoothed(np.array([0.0, 0, 0, 90, 100, 95, 0, 0, 0]))
    assert np.argmax(values) == 4 and abs(htmltext.smoothed(np.ones(5)) - 1).max() < 1e-12
    assert htmltext.threshold(np.array([1.0, 2, 50, 60])) == 26

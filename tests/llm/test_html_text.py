import html
import re
import time

import numpy as np
import pytest

from changelens.llm import html_text
from changelens.llm.html_text import main_text
from changelens.llm.queries import op6_html_text

P1 = "The first paragraph of the story, long enough to be the main text of any page that has one at all, and so on."
P2 = "The second paragraph is about as long as the first one and closes the story without further ado, one hopes."


def plain(page):
    """The blocks of the only article of a page, split at the tags that the tables have."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = op6_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


def test_windows_decide_without_an_article_element(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        assert main_text(r.html.replace("<article", "<div").replace("</article", "</div")) == plain(r.html)


def by_definition(found, trusted=False):
    """Places of the lines that stay: each window, each light line's neighbours and each pair of neighbouring lines looked at anew."""
    n, half = len(found), html_text.WINDOW // 2
    inside = lambda a, b: a.start <= b.start and b.end <= a.end
    related = lambda a, b: inside(a, b) or inside(b, a)
    told = lambda i: trusted and found[i].in_story
    sums = [sum(found[k].weight for k in range(n) if abs(k - i) <= half and (related(found[k].section, found[i].section) or (told(k) and told(i)))) for i in range(n)]
    least = min(html_text.ENOUGH, html_text.SHARE * max(sums, default=0))
    surge = [found[i].weight > 0 and sums[i] >= least for i in range(n)]
    story = any(surge[i] and told(i) for i in range(n))
    stay = []
    for i in range(n):
        here = found[i].section
        before = next((found[k].section for k in range(i - 1, -1, -1) if surge[k]), None)
        after = next((found[k].section for k in range(i + 1, n) if surge[k]), None)
        between = before and after and (inside(before, here) and inside(after, here) or before.outer == here.outer == after.outer)
        same = found[i].weight and any(x and (x.start, x.end) == (here.start, here.end) for x in (before, after))
        stay.append(bool(found[i].text) and bool(surge[i] or between or same or (story and told(i))))
    runs, mine = [], [i for i in range(n) if stay[i] and story and told(i)]
    for i in (k for k in range(n) if stay[k] and k not in mine):
        previous = next((k for k in range(i - 1, -1, -1) if found[k].text), None)
        joined = runs and previous == runs[-1][-1] and (related(found[previous].section, found[i].section) or found[previous].section.outer == found[i].section.outer)
        runs[-1].append(i) if joined else runs.append([i])
    runs += [mine] if mine else []
    heaviest = max((sum(found[i].weight for i in run) for run in runs), default=0)
    return sorted(i for run in runs if sum(found[i].weight for i in run) >= html_text.SHARE * heaviest for i in run)


LONG = "A paragraph of the story that is a good deal longer than all the others, as the story has much to say here. " * 8


@pytest.mark.parametrize(
    "inner, text",
    [
        (f"<section><p>{LONG}</p></section><section><h2>Sec</h2><p>A small note of text.</p></section>", [LONG.strip(), "Sec", "A small note of text."]),
        (f"<section><p>{LONG}</p></section><section><p>One.</p></section><section><p>Two.</p></section><div><div><p>Three.</p></div></div>", [LONG.strip(), "One.", "Two.", "Three."]),
        (f"<p>{LONG}</p></article><article><p>Another article that has no more than sixty characters in it.</p>", [LONG.strip(), "Another article that has no more than sixty characters in it."]),
        (f"<p>{LONG}</p><ul><li><a href=/a>First link</a></li><li><a href=/b>Second link</a></li></ul>", [LONG.strip(), "First link", "Second link"]),
        (f"<div><p>{LONG}</p></div><div><p><a href=/c>A paragraph that is one link</a></p></div>", [LONG.strip(), "A paragraph that is one link"]),
    ],
)
def test_nothing_of_an_article_is_lost(inner, text):
    page = "<html><body><nav><a href=/>Home</a></nav><div><p>Beside the story.</p></div><article>{}</article><div class=sidebar><p>More of it all.</p></div><footer>All rights</footer></body></html>"
    assert main_text(page.format(inner)).split("\n\n") == text
    assert main_text(page.format(inner.replace("<p>A", '<p class="ad">Buy</p><p>A', 1))).split("\n\n") == text


def test_surges_and_dives_by_definition(spark):
    rng = np.random.default_rng(6)
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for _ in range(400):  # trees of elements with lines of any weight
        parts, depth = [], 0
        for _ in range(int(rng.integers(1, 40))):
            kind = rng.integers(6)
            if kind == 0:
                parts.append(rng.choice(["<div>", "<section>", "<td>", '<div class="ad">', "<article>"]))
            elif kind == 1:
                parts.append(rng.choice(["</div>", "</section>", "</td>", "</article>"]))
            else:
                text = "x" * int(rng.choice([1, 5, 20, 70, 200]))
                parts.append(f"<p><a>{text}</a></p>" if kind == 2 else f"<p>{text}</p>")
        pages.append("".join(parts))
    for page in pages:
        found = html_text.lines(page)
        for trusted in (False, True):
            assert html_text.kept(found, trusted) == by_definition(found, trusted)


@pytest.mark.parametrize(
    "extra",
    [
        "<nav><ul><li><a href=/>Home page of the site</a></ul></nav>",
        "<header><div>The Daily Site, since 1999, every day of the week and on holidays</div></header>",
        '<div class="sidebar"><h3>More</h3><p>Other texts that have nothing to do with this one, but are long enough to count.</p></div>',
        "<aside><p>Other texts that have nothing to do with this one, but are long enough to count.</p></aside>",
        '<div id="cookie-notice"><p>We use cookies to make this site better for you, whatever you think of it.</p></div>',
        '<div role="alert">Something is wrong with this site, and has been wrong for a very long time indeed.</div>',
        '<div class="ad">Buy this thing now, it is much better than the other thing and costs much less than that.</div>',
        "<form><p>Write to us, your opinion matters very much to us, at least so we say here.</p><input name=a><button>Go</button></form>",
        "<script>var a = '<p>not a text, but a program with a paragraph in it, and quite a long one</p>';</script>",
        "<style>p::before { content: 'a style sheet with some long text in it, longer than most of them' }</style>",
        "<!-- <p>a comment with a paragraph in it that nobody is ever going to see, long as it may be</p> -->",
        '<section id="comments"><h3>2 comments</h3><p>I do not agree with this at all, and I will tell you why in many words now.</p></section>',
        "<footer><p>All rights reserved, all wrongs reversed, and whatever else one writes down there.</p></footer>",
        '<p class="ad">Buy this thing now, it is much better than the other thing and costs much less.',
        '<div class="promo">Never closed<p>',
        '<div class="page-side-bar"><p>Other texts that have nothing to do with this one, but are long enough to count.</p></div>',
        '<div style="display: none">Some text that is in the page but never shown to anybody who looks at it at all</div>',
    ],
)
@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main>%s</main>", "<div class=x>%s</div>", "%s"])
def test_boilerplate_goes(extra, frame):
    story = f"<h1>A title</h1><p>{P1}<p>{P2}</p>"
    want = f"A title\n\n{P1}\n\n{P2}"
    body = f"<html><body>{frame % story}{extra}" + ("" if "Never" in extra else "</body></html>")
    if "Never" not in extra:
        assert main_text(body) == want
    assert main_text(f"<html><body>{extra}{frame % story}</body></html>") == want


def test_surge_and_dive_without_any_names():
    links = "".join(f"<div><a href=/{i}>A link to the page number {i}</a></div>" for i in range(12))
    assert main_text(f"<body>{links}<div>{P1}</div><div>{P2}</div>{links}</body>") == f"{P1}\n\n{P2}"


def test_short_paragraphs_of_an_article_stay():
    assert main_text(f"<article><p>{P1 * 20}</p><p>a</p><p>b</p><p>c</p><p>d</p></article><p>{P2}</p>").split("\n\n")[1:] == ["a", "b", "c", "d"]


def test_captions_tables_and_an_articles_own_header_stay():
    page = f"<body><article><header><h1>T</h1></header><p>{P1}</p><figure><img alt=x><figcaption>Caption</figcaption></figure><table><tr><td>1<td>2</table><aside>Aside</aside><p>{P2}</p></article>"
    assert main_text(page) == f"T\n\n{P1}\n\nCaption\n\n1\n\n2\n\n{P2}"


def test_references_and_white_space():
    assert main_text("<p>a &amp;lt; b&nbsp;&#233;&#x1F642;\n\t c<br>d <b>e</b>f</p>") == "a &lt; b é🙂 c d ef"


def test_hostile_pages_are_quick():
    begun = time.time()
    for page in ("<a " * 100_000, '<a "' * 100_000, "<div>" * 50_000, "<div class=ad>" * 20_000 + "x", "<!--" * 100_000, "<script>" * 50_000, "x" * 3_000_000, "&" * 200_000, "<p class=ad>" * 20_000):
        main_text(page)
    assert time.time() - begun < 20


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (2, "", 7), (3, "just words", 7), (4, "<nav>menu</nav>", 7), (None, f"<p>{'word ' * 60_000}</p>", 7)], "page_id long, html string, text int")
    got = sorted((r.page_id or 0, len(r.text)) for r in html_text.extract(df).collect())
    assert got == [(0, 299_999), (1, 0), (2, 0), (2, 0), (3, 10), (4, 0)]
    assert html_text.extract(df.limit(0)).count() == 0

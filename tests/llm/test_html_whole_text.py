"""Main text that a name, an attribute's value or a teaser must not cost."""

import pytest

from changelens.llm.html_text import main_text

P1 = "The first paragraph of the story, long enough to be the main text of any page that has one at all, and so on."
P2 = "The second paragraph is about as long as the first one and closes the story without further ado, one hopes."
STORY, WANT = f"<p>{P1}</p><p>{P2}</p>", f"{P1}\n\n{P2}"


@pytest.mark.parametrize(
    "attributes",
    ['class="content has-sidebar"', 'class="overflow-hidden"', 'class="page-no-sidebar"', 'title="a hidden gem"', 'data-id="ad"', 'data-role="navigation"', "data-hidden=1", 'class="promo"', "id=widget"],
)
@pytest.mark.parametrize("inner", ["%s", "<article>%s</article>"])
def test_a_wrapper_stays(attributes, inner):
    side = '<div class="sidebar"><p>Other texts that have nothing to do with this one.</p></div>'
    assert main_text(f"<body><div {attributes}>{inner % STORY}{side}</div></body>") == WANT


def test_a_small_named_element_and_a_long_discussion_go():
    assert main_text(f'<body><div class="x">{STORY}</div><div class="promo"><p>{P1[:90]}</p></div></body>') == WANT
    assert main_text(f'<body><div class="x">{STORY}</div><div class="comments">{f"<p>{P2}</p>" * 9}</div></body>') == WANT


def test_teasers_do_not_cost_the_main_text():
    cards = "".join(f"<article><h3>Card {i}</h3></article>" for i in range(3))
    assert WANT in main_text(f"<body>{cards}<div>{STORY}</div></body>")


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout has-sidebar"><article>{STORY}</article></div>',
        f'<div id="wrapper" class="site header-fixed"><article>{STORY}</article></div>',
        f'<div id="header"><article>{STORY}</article></div>',
        f"<form><div>{STORY}</div></form>",
        f"<aside><article>{STORY}</article></aside>",
        f'<div hidden><main>{STORY}</main></div><nav>menu</nav>',
        f"<article>teaser</article><div class=post>{STORY}</div>",
    ],
)
def test_what_holds_the_main_text_stays(page):
    assert WANT in main_text(f"<body>{page}</body>")


def test_parts_of_an_article_named_after_their_matter_stay():
    page = f'<article><p>{P1}</p><section id="related-work"><p>{P2}</p></section><p class="copyright-law">{P1[:60]}</p><p>{P2}</p></article>'
    assert main_text(page) == "\n\n".join([P1, P2, P1[:60], P2])
    for name in ("related-posts", "ad", "top-ad", "comments-area", "side-bar", "share links"):
        assert main_text(f'<article><p>{P1}</p><div class="{name}"><p>{P2}</p></div><p>{P2}</p></article>') == WANT


def test_teasers_in_a_sidebar_go():
    cards = "".join(f"<article><p>{P1[:70]}</p></article>" for _ in range(3))
    assert main_text(f"<body><article>{STORY}{STORY}</article><aside>{cards}</aside></body>") == f"{WANT}\n\n{WANT}"

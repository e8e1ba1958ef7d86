import pytest

from fluxmere.llm import html_extract

P = "The mill by the weir was sold last week to a baker from the next valley, who means to grind his own flour."
Q = "Its wheel has stood still for forty years, and the new owner says that it will turn again by spring."
NAV = '<nav><a href="/">Home</a></nav>'
ARTICLE = f"<h1>Mill sold</h1><p>{P}</p><p>{Q}</p>"
TREE = html_extract.trained()


@pytest.mark.parametrize(
    "page",
    [
        f'{NAV}<div class="content-sidebar-wrap"><main><article>{ARTICLE}</article></main></div>',
        f'{NAV}<main class="has-sidebar">{ARTICLE}</main>',
        f'{NAV}<article class="post with-widget">{ARTICLE}</article>',
        f'{NAV}<div class="elementor-widget-wrap"><div class="widget"><article>{ARTICLE}</article></div></div>',
        f'{NAV}<div id="no-sidebar"><div role="main">{ARTICLE}</div></div>',
        *(f"{NAV}<{x}><article>{ARTICLE}</article>" for x in ("button", "select", "object", "noscript", "svg")),
    ],
)
def test_article_stays(page):
    assert html_extract.main_text(page, TREE) == f"Mill sold\n{P}\n{Q}"


@pytest.mark.parametrize(
    "rest",
    [
        f'<div id="comments"><article class="comment"><p>{Q}</p></article></div>',
        f'<div class="comments"><article><p>{Q}</p></article></div>',
        f'<aside class="sidebar"><article><p>{Q}</p></article></aside>',
        f'<div style="display:none"><article><p>{Q}</p></article></div>',
        f'<div class="sidebar"><p>{Q}</p></div>',
        f"<script><p>{Q}</p>",
    ],
)
def test_furniture_goes(rest):
    assert html_extract.main_text(f"{NAV}<article><h1>Mill sold</h1><p>{P}</p></article>{rest}", TREE) == f"Mill sold\n{P}"

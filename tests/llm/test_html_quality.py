"""Quality of the extraction on pages that are not in the labelled table, and edge cases."""

from fluxmere.llm import html_extract

A = "Seven ships lay in the harbour that night, and not one of them had a crew on board."
B = "Nobody knows who untied the ropes."
C = "Our shop has all you need for the garden, from seeds to wheelbarrows, at the best price."
MENU = '<a href="/a">Start</a> <a href="/b">Travel</a> <a href="/c">Money</a> <a href="/d">Weather</a>'
#: (page, its article's blocks)
PAGES = [
    (f"<html><body><div id=nav>{MENU}</div><article><h1>Ships</h1><p>{A}<p>{B}</article><div class='advert'>{C}</div></body></html>", ["Ships", A, B]),
    (f"<header><p>{MENU}</p></header><main><h1>Ships</h1><section><p>{A}</p><ul><li>One</li><li>Two</li></ul></section></main><aside><p>{C}</p></aside>", ["Ships", A, "One", "Two"]),
    (f"<div class='page-header'>{MENU}</div><div class='entry-content'><p>{A}</p><blockquote><p>{B}</p></blockquote></div><div class='comments-area'><p>{A} I was there.</p></div>", [A, B]),
    (f"<div>{MENU}</div><div><h1>Ships</h1><p>{A}</p><p>{B}</p><p>{A}</p></div><div>{MENU}</div>", ["Ships", A, B, A]),
    (f"<div class='has-sidebar'><main class='content-sidebar-wrap'><article><p>{A}</p><p>{B}</p></article></main><div class='widget'>{C}</div></div>", [A, B]),
    (f"<article><p>Let <math><mi>x</mi></math> be here. {B}</p><p><svg><title>icon</title><text>Figure</text></svg></p><p>{A}</p></article>", [f"Let x be here. {B}", "Figure", A]),
    (f"<article><p>{A}</p><button>Share<p>{B}</p></article><footer>{C}</footer>", [A, "Share", B]),
    (f"<article><p>{A}</p><form><label>Mail</label><button>Go</button></form><p>{B}</p></article>", [A, B]),
    (f"<div role=navigation>{MENU}</div><div role=main><p>{A} <a href=/x>{B}</a></p></div><div role=contentinfo>{C}</div>", [f"{A} {B}"]),
    (f"<main><article><h2>Ships</h2><p>{A}</p></article><article class='related'><p>{C}</p></article></main><div class='cookie-banner'>{B} We use cookies.</div>", ["Ships", A]),
]


def test_unseen_layouts():
    tree = html_extract.trained()
    right = wrong = missed = 0
    for page, want in PAGES:
        got = [x for x in html_extract.main_text(page, tree).split("\n") if x]
        hit = sum(min(got.count(x), want.count(x)) for x in set(want))
        right, wrong, missed = right + hit, wrong + len(got) - hit, missed + len(want) - hit
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.95, (right, wrong, missed)


def test_edges(spark):
    schema = "page_id long, url string, html string, text string"
    long = "<article>" + "".join(f"<p>{A} {k}</p>" for k in range(20_000)) + "</article>"
    rows = [(1, "u", PAGES[0][0], "t"), (1, "u", PAGES[0][0], "t"), (2, None, None, None), (None, "v", "", "t"), (3, "w", long, "t"), (4, "x", "<<<>>><p", "t"), (5, "y", "<div>" * 5000 + A, "t")]
    got = html_extract.extract(spark.createDataFrame(rows, schema).repartition(2)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == "\n".join(PAGES[0][1]) and by[2] == by[None] == "" and by[3].count("\n") == 19_999 and by[5] == A
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0

"""Main text of web pages: text blocks classified by a decision tree.

A page is cut into flat blocks. A block's features are its word count and link density,
those of its neighbours, and whether its enclosing elements mark it as article or as page
furniture. The tree is grown on the blocks of the small labelled pages in ``LABELLED``.
Pages are mapped one by one; nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks
from .storage import ship

_P = "The river rose through the night and by morning the lower fields were under water, said the keeper of the lock."
_Q = "Nobody was hurt, though two bridges remain closed until engineers have looked at them."
_S = "It ended."
_T = "Prices for grain fell in the third week of March, after two months in which they had only gone up."
_U = "Wie die Stadt am Abend mitteilte, bleibt das Bad bis zum Ende der Ferien geschlossen."
_V = "Stir the flour into the butter and let it brown a little before you add the milk, a cup at a time."
_W = "Le musée ouvre ses portes à dix heures, sauf le lundi."
_X = "Where x is the length of the side, the area is its square."
_TOP = '<div class="top"><a href="/in">Sign in</a> <a href="/join">Join us</a> <span>Tuesday, 4 March</span></div>'
_LINKS = '<a href="/1">Ten best walks by the sea</a> <a href="/2">Why the bridge was built</a> <a href="/3">A letter to the mayor</a>'
_NAV = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>'
#: (page, texts of its article's blocks): the labelled table.
LABELLED: tuple[tuple[str, tuple[str, ...]], ...] = (
    (f'<body><nav>{_NAV}</nav><div class="ad">Buy boots today in our shop, the best for any weather.</div><article><h1>Flood</h1><p>{_P}</p><p>{_S}</p><p>{_Q}</p></article><footer>All rights reserved 2020</footer></body>', ("Flood", _P, _S, _Q)),
    (f'<body><header><h2>Daily Page</h2>{_NAV}</header><main><h1>Flood in town</h1><p>{_P} <a href="/x">See map</a></p><p>{_S}</p></main><aside><h3>Most read</h3><p>{_Q}</p></aside></body>', ("Flood in town", _P + " See map", _S)),
    (f'<body><div id="menu">{_NAV}</div><div class="post-content"><h1>Flood</h1><p>{_P}</p><p>{_S}</p><ul><li>First point</li><li>Second point</li></ul></div><div id="comments"><h3>Comments</h3><p>{_Q} I saw it all from my window.</p></div></body>', ("Flood", _P, _S, "First point", "Second point")),
    (f'<body><div>{_NAV}</div><div><h1>Flood in the lower town</h1><p>{_P}</p><p>{_Q}</p></div><div><a href="/a">About us</a> <a href="/c">Contact</a> <a href="/p">Privacy</a></div></body>', ("Flood in the lower town", _P, _Q)),
    (f'<article><header><h1>Title of it</h1></header><p>{_P}</p><blockquote>{_Q}</blockquote><div class="share"><a href="/f">Share</a></div><p>{_S}</p><p><a href="/all">Read the full report here</a></p></article><form>Name and password are needed to sign in to this page</form>', ("Title of it", _P, _Q, _S, "Read the full report here")),
    (f'<div class="cookie-notice">{_Q} We use cookies to make this page better for all of our readers.</div><div class="page"><p>{_P}</p><p>{_Q}</p></div><div class="footer">{_P}</div>', (_P, _Q)),
    (f"<p>{_P}</p><p>{_Q}</p><p>{_P}</p>", (_P, _Q, _P)),
    (f"{_P}", (_P,)),
    (f'<main><article><p>{_P}</p></article><section class="related"><a href="/1">Another flood</a><p>{_Q}</p></section></main><div><p>{_Q}</p></div>', (_P,)),
    (f'<div><a href="/1">{_NAV}</a></div><article><p>{_S}</p></article><div>Page 1 of 2</div><div>{_Q}</div>', (_S,)),
    (f'<article><p>{_P}</p><aside>{_Q}</aside><form><p>Your e-mail</p></form><ol class="comments"><li>{_P}</li></ol></article>', (_P,)),
    ("<p>Short note.</p>", ("Short note.",)),
    (f'<nav>{_NAV}</nav><article><h1>Flood</h1><p>{_P}</p><p>{_Q}</p></article>', ("Flood", _P, _Q)),
    (f'<div><p>{_Q}</p></div><main><p>{_P}</p><p><a href="/x">{_Q}</a></p><p><a href="/y">Map</a></p><p>{_S}</p></main>', (_P, _Q, "Map", _S)),
    (f'<div>{_P}</div><div><a href="/a">{_Q}</a></div><div><a href="/b">{_P}</a></div><div><a href="/c">More</a></div>', (_P,)),
    (f'<article><p>{_S}</p></article><div><p>{_P}</p><p>{_Q}</p></div>', (_S,)),
    (f'<p>{_P}</p><p>{_S}</p>', (_P, _S)),
    ("<h1>Only a title</h1><p>One line.</p>", ("Only a title", "One line.")),
    (f'{_TOP}<div class="content"><h2>Grain</h2><p>{_T}</p><p>By our own reporter</p><p>{_S}</p></div><div class="more">{_LINKS}</div><div>Call us on 555 0100</div>', ("Grain", _T, "By our own reporter", _S)),
    (f'<header>{_TOP}</header><main><p>{_U}</p><table><tr><td>Montag</td><td>9 Uhr</td></tr></table><p>{_S}</p></main><footer><p>{_W}</p></footer>', (_U, "Montag", "9 Uhr", _S)),
    (f'<div class="wrap"><div class="menu">{_LINKS}</div><div class="main"><h1>White sauce</h1><ol><li>{_V}</li><li>Salt it.</li></ol></div><div class="sidebar"><h3>More recipes</h3>{_LINKS}<p>{_W}</p></div></div>', ("White sauce", _V, "Salt it.")),
    (f'<section><h2>Area</h2><p>{_X}</p><pre>x * x</pre><p>{_T}</p></section><section class="ads"><p>{_V}</p></section><p><a href="/t">Terms</a> | <a href="/i">Imprint</a></p>', ("Area", _X, "x * x", _T)),
    (f'<article><p>{_W}</p><figure><figcaption>The entrance hall</figcaption></figure><p>{_U}</p></article><div>{_LINKS}</div><section id="comments"><article class="comment"><p>{_T}</p></article></section>', (_W, "The entrance hall", _U)),
    (f'<div>{_TOP}</div><div>{_LINKS}</div><div><p>{_T}</p><p>{_V}</p><p>{_X}</p></div><div>{_LINKS}</div>', (_T, _V, _X)),
    (f'<body>{_LINKS}<p>{_U}</p><p>{_W}</p><p>Read on: <a href="/p2">the second part of this report</a></p></body>', (_U, _W, "Read on: the second part of this report")),
    (f'<main><h1>News</h1><p>{_T}</p><div role="alert">{_W}</div><div class="newsletter">{_V}</div><p>{_S}</p></main>', ("News", _T, _S)),
    (f'<div>{_NAV}</div><h1>Only a title</h1><p>One line.</p><p>{_Q}</p><div><a href="/n">Next page</a></div>', ("Only a title", "One line.", _Q)),
)


def features(found: list[Block]) -> list[tuple[int, ...]]:
    """main, boiler, page has main, words, link density in %, the same two of the block before and after, heading."""
    density = [100 * b.linked // max(1, b.words) for b in found]
    has_main = any(b.main and not b.boiler for b in found)
    out = []
    for k, b in enumerate(found):
        before = (found[k - 1].words, density[k - 1]) if k else (0, 0)
        after = (found[k + 1].words, density[k + 1]) if k + 1 < len(found) else (0, 0)
        out.append((int(b.main), int(b.boiler), int(has_main), b.words, density[k], *before, *after, int(b.heading)))
    return out


Tree = bool | tuple[int, float, "Tree", "Tree"]


def grow(rows: list[tuple[int, ...]], labels: list[bool], depth: int = 6) -> Tree:
    """A binary tree of least Gini impurity; of equal splits the first feature and least threshold."""
    count = Counter(labels)
    if depth == 0 or len(count) < 2:
        return count[True] >= count[False] and bool(labels)
    best = None
    for f in range(len(rows[0])):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            at = (a + b) / 2
            left = [y for r, y in zip(rows, labels, strict=True) if r[f] <= at]
            right = [y for r, y in zip(rows, labels, strict=True) if r[f] > at]
            gini = sum(2 * len(s) * (p := sum(s) / len(s)) * (1 - p) for s in (left, right))
            if best is None or gini < best[0] - 1e-9:
                best = (gini, f, at)
    if best is None:
        return count[True] >= count[False]
    _, f, at = best
    sides = [[(r, y) for r, y in zip(rows, labels, strict=True) if (r[f] <= at) == low] for low in (True, False)]
    return (f, at, *(grow([r for r, _ in s], [y for _, y in s], depth - 1) for s in sides))


def trained(labelled: tuple[tuple[str, tuple[str, ...]], ...] = LABELLED) -> Tree:
    rows, labels = [], []
    for page, wanted in labelled:
        found, left = blocks(page), Counter(wanted)
        kept = [False] * len(found)
        for k in sorted(range(len(found)), key=lambda k: (found[k].boiler, not found[k].main, k)):
            if left[found[k].text] > 0:
                kept[k] = True
                left[found[k].text] -= 1
        rows += features(found)
        labels += kept
    return grow(rows, labels)


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    kept = []
    for block, row in zip(found, features(found), strict=True):
        node = tree
        while not isinstance(node, bool):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        if node:
            kept.append(block.text)
    return "\n".join(kept)


def _run(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", tree) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages(page_id, url, html)``.

    ``text`` is the article's blocks, one a line; empty if there is none or html is null.
    Repeated rows and null ids are kept as they come; other columns are not read.
    """
    ship(pages.sparkSession)
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(_run(trained()), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))

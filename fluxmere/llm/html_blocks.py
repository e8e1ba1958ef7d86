"""Flat text blocks of an HTML page, with what a classifier looks at."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements with nothing that a browser shows as running text: code, controls of forms, and what stands in where a medium can't be shown.
RAW = frozenset("script style noscript template textarea iframe object select button title audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = BLOCK - frozenset("p hr li dt dd td th tr tbody thead tfoot caption h1 h2 h3 h4 h5 h6 summary legend html".split())
ITEM = frozenset("p li dt dd td th tr".split())
BOILER_TAGS = frozenset("nav aside footer form menu dialog".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
_BOILER = re.compile(
    r"^(?:nav\w*|menu\w*|side|sidebar\w*|footer\w*|header|masthead|topbar|banners?|ads?\d*|ad(?:box|unit|slot|sense|wrap\w*|container|space)|advert\w*|sponsor\w*|promos?|promotions?|cookies?|consent|gdpr|notices?|alerts?|"
    r"comments?\w*|disqus\w*|respond|repl(?:y|ies)|discussion|share\w*|sharing|social\w*|related\w*|recommend\w*|popular|trending|breadcrumbs?|crumbs?|pagination|pager|subscri\w+|newsletters?|signup|login|search\w*|"
    r"widgets?|tagcloud|copyright|toolbar|popups?|modals?|overlay|skip|feedback|forms?|rail|hidden|disclaimer)$"
)
_MAIN = re.compile(r"^(?:content|article\w*|posts?|entry|story|main\w*|body|maincontent|text|prose)$")
#: Marks that hold for an article too: comments and teasers are often articles themselves.
_OTHERS = re.compile(r"^(?:comments?\w*|disqus\w*|respond|repl(?:y|ies)|discussion|related\w*|recommend\w*|popular|trending|hidden|ads?\d*|advert\w*|sponsor\w*|promos?|promotions?)$")
#: Elements whose text is no markup: without an end they take the rest of the page. Other raw ones go on as markup.
TO_THE_END = frozenset("script style textarea title".split())
_ATTR = re.compile(r"""\b(class|id|role|itemprop|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^A-Za-z0-9]+")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_NEXT = re.compile(r"[\"'>]")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    main: bool
    boiler: bool
    heading: bool


@dataclass
class _Open:
    name: str
    main: bool = False
    boiler: bool = False
    #: Whether only class or id tokens of layout mark it, which an article or main element within takes back.
    weak: bool = True


@dataclass
class _Page:
    stack: list[_Open] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    link: bool = False
    heading: bool = False

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(p for p, _ in self.parts).split())
            if text:
                linked = sum(len(p.split()) for p, link in self.parts if link)
                top = self.stack[-1] if self.stack else _Open("")
                self.blocks.append(Block(text, len(text.split()), linked, top.main, top.boiler, self.heading))
        self.parts = []

    def open(self, name: str, tag: str) -> None:
        block = name in BLOCK
        if block:
            self.end_block()
            self.link = False
            self.heading = name in ("h1", "h2", "h3", "h4", "h5", "h6")
            if self.stack and self.stack[-1].name == "p":
                self.stack.pop()
            if name in ("li", "tr", "td", "th", "dt", "dd") and self.stack and self.stack[-1].name == name:
                self.stack.pop()
        if name in VOID:
            if name == "br":
                self.parts.append((" ", self.link))
            return
        if name == "a":
            self.link = True
            return
        if name in CONTAINER or (name in ITEM or name in ("span", "h1", "h2", "h3", "h4", "h5", "h6")) and "=" in tag:
            outer = self.stack[-1] if self.stack else _Open("")
            main, boiler, weak, article = self.kind(name, tag, outer.main)
            kept = outer.boiler and not (article and not boiler and outer.weak)
            if name in CONTAINER or main or boiler:
                self.stack.append(_Open(name, outer.main or main, kept or boiler, (outer.weak or not kept) and (weak or not boiler)))

    @staticmethod
    def kind(name: str, tag: str, inside: bool) -> tuple[bool, bool, bool, bool]:
        """main, boiler, whether boiler by tokens of layout only, whether an article or main element."""
        main = name in ("article", "main")
        boiler = name in BOILER_TAGS or name == "header" and not inside
        weak = article = False
        if "=" in tag or " hidden" in tag:
            tokens: list[str] = []
            for key, a, b, c in _ATTR.findall(tag):
                key, value = key.lower(), a or b or c
                if key in ("class", "id"):
                    if name not in ("body", "html"):
                        tokens += [t.lower() for t in _SPLIT.split(_CAMEL.sub(" ", value)) if t]
                elif key == "role":
                    main |= value.lower() in ("main", "article")
                    boiler |= value.lower() in BOILER_ROLES
                elif key == "itemprop":
                    main |= value.lower() in ("articlebody", "text")
                elif key == "style":
                    boiler |= "display:none" in value.lower().replace(" ", "")
                elif key == "aria-hidden":
                    boiler |= value.lower() == "true"
                else:
                    boiler = True
            article = main
            if tokens:
                marks = [t for t in tokens if _BOILER.match(t) and not (t == "header" and inside)]
                if article:
                    marks = [t for t in marks if _OTHERS.match(t)]
                weak = not boiler and not any(map(_OTHERS.match, marks))
                boiler |= bool(marks)
                main |= name in ("div", "section", "td") and any(_MAIN.match(t) for t in tokens)
        return main and not boiler, boiler, weak, article or name in ("article", "main")

    def close(self, name: str) -> None:
        if name in BLOCK:
            self.end_block()
            self.link = self.heading = False
        if name == "a":
            self.link = False
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].name == name:
                del self.stack[k:]
                break


def _tag_end(text: str, at: int) -> int:
    """Just after the > of a tag, quoted values skipped; without one the nearest > or the end."""
    found = _NEXT.search(text, at)
    while found and found.group() != ">":
        close = text.find(found.group(), found.end())
        if close < 0:
            plain = text.find(">", at)
            return len(text) if plain < 0 else plain + 1
        found = _NEXT.search(text, close + 1)
    return found.end() if found else len(text)


def blocks(text: str) -> list[Block]:
    """Every non-empty text block in page order. A comment, tag, script, style, textarea or title that never ends takes the rest with it."""
    page, at, n = _Page(), 0, len(text)
    endless: set[str] = set()
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            page.parts.append((html.unescape(text[at:]), page.link))
            break
        after = text[lt + 1 : lt + 2]
        if not (after.isascii() and after.isalpha()) and after not in ("/", "!", "?") or not after:
            page.parts.append((html.unescape(text[at : lt + 1]), page.link))
            at = lt + 1
            continue
        if lt > at:
            page.parts.append((html.unescape(text[at:lt]), page.link))
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if after in "!?":
            end = text.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if after == "/":
            end = text.find(">", lt)
            name = _NAME.match(text, lt + 2)
            if name:
                page.close(name.group().lower())
            at = n if end < 0 else end + 1
            continue
        end = _tag_end(text, lt + 1)
        name = _NAME.match(text, lt + 1).group().lower()
        tag = text[lt:end]
        at = end
        if name in RAW and name not in endless and not tag.endswith("/>"):
            close = re.compile(rf"</{name}[\s/>]", re.I).search(text, end)
            if close or name in TO_THE_END:
                at = n if not close else _tag_end(text, close.start() + 1)
                continue
            endless.add(name)
        page.open(name, tag)
    page.end_block()
    return page.blocks

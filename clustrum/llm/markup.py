"""Blocks of text of an HTML page, each with what the markup says of it: one pass over the tags, no tree."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: What the markup says of a block: chrome, nothing, a content region, an article.
CHROME, OPEN, REGION, ARTICLE = -1, 0, 1, 2


class Piece(NamedTuple):
    text: str
    mark: int
    #: Whether most of its characters stand in links.
    links: bool


_TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*+>|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|/?[a-zA-Z][^>]*+>)", re.S
)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|itemprop|aria-hidden|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?=[\s/>]|$))", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody tfoot thead tr ul caption option".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CHROME_TAGS = frozenset("nav aside footer menu dialog search noscript template svg canvas object audio video head math".split())
_FORM_TAGS = frozenset("form fieldset button select option datalist label input".split())
_ROLES = {
    **dict.fromkeys("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist status".split(), CHROME),
    "main": REGION, "article": ARTICLE,
}
# Words of class names and ids by which sites name their parts.
_CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promoted banner sidebar side rail menu menus submenu nav navbar navigation navi breadcrumb breadcrumbs crumbs "
    "footer foot header masthead topbar toolbar cookie cookies consent notice notices gdpr ccpa popup popover modal overlay lightbox alert newsletter subscribe subscription signup signin login register search "
    "searchbox share sharing sharebar social follow related recommended recommendations recommend trending popular teaser teasers widget widgets pagination pager skip copyright legal disclaimer tags tagcloud "
    "outbrain taboola adsbygoogle paywall form forms announcement hidden offscreen".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion reader readers feedback reviews".split())
_CONTENT_WORDS = frozenset("article content post entry story main".split())
_ARTICLE_WORDS = frozenset("articlebody articletext articlecontent postcontent postbody entrycontent storybody".split())
_LAYOUT_WORDS = frozenset("with without has no layout".split())
_WRAP_WORDS = frozenset("wrap wrapper container outer inner area".split())


def _judge(name: str, attrs: str) -> tuple[int | None, bool]:
    """(mark of the element or None, whether an article inside it may still be one)."""
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)} if attrs.strip() else {}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return CHROME, False
    if name in _CHROME_TAGS:
        return CHROME, False
    role = _ROLES.get(found.get("role", "").lower())
    if role == CHROME:
        return CHROME, True
    if name in ("html", "body"):
        return None, True
    named = f"{found.get('class', '')} {found.get('id', '')}"
    tokens = [{w.lower() for w in _WORD.findall(t)} for t in named.split()]
    words = set().union(*tokens) if tokens else set()
    whole = {re.sub(r"[^a-z]", "", t.lower()) for t in named.split()}
    if name in _HEADINGS:
        return (CHROME, False) if words & {"hidden", "ad", "ads"} else (None, True)
    # names such as with-sidebar or content-sidebar-wrap tell what is inside beside the content
    own = [t for t in tokens if not t & _LAYOUT_WORDS and not (t & _CONTENT_WORDS and t & _WRAP_WORDS)]
    if any(t & _COMMENT_WORDS for t in own):
        return CHROME, False
    if any(t & _CHROME_WORDS and not (t & {"article", "post", "entry", "story"} and t & {"header", "head", "masthead"}) for t in own):
        return CHROME, True
    if name in _FORM_TAGS:
        return CHROME, True
    if name == "article" or role == ARTICLE or "articlebody" in found.get("itemprop", "").lower() or whole & _ARTICLE_WORDS or any("article" in t and t & {"body", "content", "text"} for t in tokens):
        return ARTICLE, True
    if name == "main" or role == REGION or (words & _CONTENT_WORDS and name in ("div", "section", "td")):
        return REGION, True
    return (CHROME if name == "header" else None), True


class _Page:
    """The open elements that matter, and the block that is being read."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = []
        self.mark, self.reach = OPEN, True
        self.names: dict[str, int] = {}
        self.text: dict[int, list[str]] = {}
        self.linked: dict[int, int] = {}
        self.in_link = 0
        self.out: list[Piece] = []

    def flush(self) -> None:
        for mark, parts in self.text.items():
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                self.out.append(Piece(text, mark, 2 * self.linked.get(mark, 0) > len(raw)))
        self.text, self.linked = {}, {}

    def add(self, raw: str) -> None:
        self.text.setdefault(self.mark, []).append(raw)
        if self.in_link:
            self.linked[self.mark] = self.linked.get(self.mark, 0) + len(raw)

    def open(self, name: str, attrs: str, known: dict) -> None:
        if name in _BLOCK:
            self.flush()
            if self.names.get("p"):
                self.close("p")
            if name in ("li", "dt", "dd", "tr", "option"):
                self._end_sibling(name)
        if name in ("td", "th", "br"):
            self.add(" ")
        if name == "a":
            self.in_link = 1
        key = (name, attrs)
        if key not in known:
            if len(known) > 20_000:
                known.clear()
            known[key] = _judge(name, attrs)
        own, reach = known[key]
        if name in _VOID:
            return
        mark = self.mark
        if own == CHROME:
            # an article's own header holds its title
            mark = CHROME if not (name == "header" and mark > OPEN and "header" not in attrs) else mark
        elif own is not None and mark != CHROME:
            mark = max(mark, own)
        elif own is not None and self.reach and name in ("article", "main"):
            mark = own
        reach = reach and self.reach if mark == CHROME else True
        if name in _BLOCK or mark != self.mark or self.names.get(name):
            self.stack.append((name, self.mark, self.reach))
            self.names[name] = self.names.get(name, 0) + 1
            self.mark, self.reach = mark, reach

    def _pop(self) -> str:
        name, self.mark, self.reach = self.stack.pop()
        self.names[name] -= 1
        return name

    def _end_sibling(self, name: str) -> None:
        """An item ends the one before it in its list."""
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in ("ul", "ol", "dl", "table", "menu", "div", "select"):
                return
            if self.stack[at][0] == name or {self.stack[at][0], name} == {"dt", "dd"}:
                while len(self.stack) > at:
                    self._pop()
                return

    def close(self, name: str) -> None:
        if name in _BLOCK:
            self.flush()
        if name == "a":
            self.in_link = 0
        if not self.names.get(name):
            return
        if name not in _BLOCK and not any(n == name for n, _, _ in self.stack[-40:]):
            return
        while self._pop() != name:
            pass


def pieces(page: str | None, known: dict | None = None) -> list[Piece]:
    """The blocks of text of a page in order; none for null, empty or text-free pages.

    Scripts, styles, titles, comments and tags aren't text. Character references are decoded once, white space becomes one
    blank. Block elements part blocks; a line break or a cell's edge is white space. Tags may be left open, overlap or be cut
    off. `known` keeps judged tags from call to call.
    """
    if not page:
        return []
    known = {} if known is None else known
    state, at = _Page(), 0
    last = page.rfind(">") + 1
    while at < last:
        m = _TAG.search(page, at, last)
        if m is None:
            break
        if m.start() > at:
            state.add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            continue
        name = m["name"]
        if name is None:
            if m[0].startswith("<!--") and not m[0].endswith(("-->", "->", "--!>")):
                at = len(page)  # a comment that is never closed
            continue
        name = name.lower()
        if m["close"]:
            state.close(name)
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        state.open(name, m["attrs"] or "", known)
    if at < len(page):
        tail = page[at:]
        # a tag that the page's end cuts off is no text
        cut = re.search(r"</?[a-zA-Z!?]", tail)
        state.add(tail[: cut.start()] if cut else tail)
    state.flush()
    return state.out

"""Main text of web pages by tag-path ratios (operator 5).

A page's text nodes are grouped by the root-to-leaf path of block tags (with class and id) they lie on.
Each path has two ratios, text length and punctuation by node; both are smoothed over the
paths in page order and multiplied, and links in the text count against it; in an ``article`` or ``main``
element the ratio counts ``_LANDMARK`` times. Paths whose fused ratio reaches a threshold, a share of the
spread over the page, are content; so are headings beside content. Paths through an element that by its tag,
role, or the whole of a class or id is a menu, header, footer, sidebar, notice, advert, form, share bar or comment
list are never content; where such a word is but a part of a longer name (``market-share``), it
counts outside of ``article`` and ``main`` only, and an article within goes free. A path is kept or dropped whole, so a short paragraph stays with
the long ones.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from meridian.llm.common import appended

_RAW = "script|style|title|textarea|xmp|iframe|noembed|noframes|noscript|template|svg|math|object|select"
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<raw>{_RAW})\b(?:"[^"]*"|'[^']*'|[^>"'])*>.*?(?:</(?P=raw)\s*>|\Z)
    |</(?P<end>[a-z][a-z0-9:-]*)[^>]*(?:>|\Z)
    |<(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.I | re.S | re.X)
_ATTR = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：¿¡]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search
    section summary table tbody td tfoot th thead tr ul head""".split())
_CLOSES_P = _BLOCK - {"html", "body", "head"}
#: An opening tag ends an open one of these, up to the element that holds them.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
             "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"})}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOILERPLATE_TAGS = frozenset("nav footer aside form head dialog button menu search fieldset".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
_BOILERPLATE_NAMES = frozenset("""ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs
    captcha comment comments consent cookie cookies copyright discussion disqus footer form gdpr header hidden login masthead
    menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted
    promotion related replies respond responses share sharing sidebar sidebars signup skip social sponsor sponsored subscribe
    subscription toolbar topbar widget widgets""".split())
#: Words that add nothing to such a name: ``comment-list`` is a comment list, ``market-share`` is no share bar.
_PLAIN_NAMES = frozenset("""area bar bottom box boxes button buttons container inner item items left link links list outer page
    panel posts right section site slot top unit wrap wrapper""".split())
_LEAST, _LANDMARK, _SMOOTH = 0.2, 4.0, np.array([0.25, 0.5, 0.25])


@dataclass
class _Block:
    path: str
    inside: bool   # of an article or main element
    barred: bool   # of boilerplate
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if "=" in raw else {}


_FREE, _DOUBTFUL, _BARRED = range(3)


def _barred(tag: str, attrs: dict[str, str], raw: str, inside: bool) -> int:
    """Whether an element is boilerplate by itself: surely, or, outside of the article, by a part of its name."""
    if tag in _BOILERPLATE_TAGS or tag == "header" and not inside or attrs.get("role", "").lower() in _BOILERPLATE_ROLES:
        return _BARRED
    if tag in ("html", "body", "main") or not raw.strip():
        return _FREE
    if "idden" in raw.lower() and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"""=\s*(?:"[^"]*"|'[^']*')""", " ", raw), re.I):
        return _BARRED
    if attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return _BARRED
    doubt = _FREE
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = {w.lower() for w in _SPLIT.split(name) if w and not w.isdigit()}
        if words & _BOILERPLATE_NAMES:
            if words <= _BOILERPLATE_NAMES | _PLAIN_NAMES:
                return _BARRED
            doubt = doubt if inside or tag == "article" else _DOUBTFUL
    return doubt


def blocks(page: str) -> list[_Block]:
    """The text blocks of a page in order: runs of text between the tags of block elements."""
    stack: list[tuple[str, str, bool, int]] = [("", "", False, _FREE)]  # tag, path, inside, barred
    found: list[_Block] = []
    now: _Block | None = None
    links, at = 0, 0

    def text(raw: str) -> None:
        nonlocal now
        if not raw:
            return
        if now is None:
            if raw.isspace():
                return
            tag, path, inside, barred = next(e for e in reversed(stack) if e[0] in _BLOCK or not e[0])
            now = _Block(path, inside, max(barred, stack[-1][3]) > _FREE, bool(_HEADINGS & {e[0] for e in stack[-3:]}))
            found.append(now)
        now.parts.append(raw)
        if links:
            now.linked += len(raw)

    def close(names: set[str] | frozenset[str], until: set[str] | frozenset[str] = frozenset()) -> None:
        nonlocal links, now
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                links -= sum(e[0] == "a" for e in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    for m in _TOKEN.finditer(page):
        text(html.unescape(page[at:m.start()]))
        at = m.end()
        if m["end"]:
            tag = m["end"].lower()
            if tag in _BLOCK:
                now = None
            close({tag}, frozenset() if tag in _BLOCK else _BLOCK)
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag in ("br", "hr"):
                text(" ")
            if tag in _BLOCK or tag == "hr":
                now = None
                if tag in _CLOSES_P or tag == "hr":
                    close({"p"}, _BLOCK - {"p"})
                if tag in _SIBLINGS:
                    close(*_SIBLINGS[tag])
            if tag in _VOID or m["attrs"].endswith("/") and tag not in _BLOCK:
                continue
            attrs = _attributes(m["attrs"])
            _, path, inside, barred = stack[-1]
            if tag in ("article", "main") and barred == _DOUBTFUL:
                barred = _FREE
            barred = max(barred, _barred(tag, attrs, m["attrs"], inside))
            inside = inside or tag in ("article", "main")
            if tag in _BLOCK:
                name = ".".join([tag, *attrs.get("class", "").split()])
                path = f"{path}/{name}#{attrs['id']}" if "id" in attrs else f"{path}/{name}"
            links += tag == "a"
            stack.append((tag, path, inside, barred))
    text(html.unescape(page[at:]))
    return found


def main_text(page: str | None) -> str:
    """Content blocks of a page, white space inside each as one space, joined by a line feed."""
    rows = [(b, " ".join("".join(b.parts).split())) for b in blocks(page or "")]
    rows = [(b, t) for b, t in rows if t]
    free = [(b, t) for b, t in rows if not b.barred]
    if not free:
        return ""
    paths = {p: i for i, p in enumerate(dict.fromkeys(b.path for b, _ in free))}
    stats = np.zeros((4, len(paths)))  # nodes, characters, punctuation, linked characters
    for b, t in free:
        stats[:, paths[b.path]] += 1, len(t), len(_PUNCTUATION.findall(t)), min(b.linked, len(t))
    nodes, chars, marks, linked = stats
    plain = 1 - linked / np.maximum(chars, 1)
    smooth = [np.convolve(np.pad(x / nodes, 1, mode="edge"), _SMOOTH, "valid") for x in (chars * plain, marks + 0.5)]
    prior = np.ones(len(paths))
    for b, _ in free:
        if b.inside:
            prior[paths[b.path]] = _LANDMARK
    fused = np.sqrt(smooth[0] * smooth[1]) * plain * prior
    chosen = fused >= _LEAST * max(fused.std(), fused.max() / 2)
    keep = [chosen[paths[b.path]] for b, _ in free]
    for k in range(len(free) - 2, -1, -1):  # a heading stays with the content that follows it
        keep[k] = keep[k] or free[k][0].heading and keep[k + 1]
    return "\n".join(t for (_, t), k in zip(free, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``pages`` with the main text of each row and its code points. Null and empty pages, and
    pages without content, have an empty text; broken markup is read as far as it goes. Rows that repeat
    a page are extracted each; columns that have a new one's name are replaced, others pass through."""
    def start():
        def one(page: str | None) -> list:
            found = main_text(page)
            return [found, len(found)]
        return one

    return appended(pages, f"{text_col} string, {chars_col} long", [html_col], start)

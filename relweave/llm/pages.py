"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame

from relweave.llm.scratch import arrow, clean, map_batches

#: lines of one sliding window, and text a window has at a surge
WINDOW = 3
SURGE_CHARS = 80
#: a line in an article or main element weighs as much as a line this many times as long
HOME_WEIGHT = 4
#: a surge has at least this part of the heaviest window
SURGE_SHARE = 0.25

# Elements and names with a meaning of their own in web pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea noscript template iframe svg object canvas video audio math".split())
AWAY = frozenset("head nav footer aside form button select menu dialog label input fieldset".split())
AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar widget related recommended share sharing social footer pagination pager toolbar copyright "
    "disclaimer search skip".split())
TALK_NAMES = frozenset("comment comments reply replies disqus discussion respond".split())
TOP_NAMES = frozenset("header masthead topbar".split())
#: words that name the shape of a container, not what it holds
SHAPE_NAMES = frozenset(
    "area bar block body bottom box btn button buttons card col column container content entry form group header heading "
    "icon icons inline inner item items left link links list main meta outer page panel post posts right row section site "
    "slot small stories story text thread title top unit wrap wrapper".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CLOSES_P = BLOCK - {"br", "body", "html"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z]+")


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(raw)} if raw.strip(" /\n\t") else {}


def _kind(name: str, raw: str, inside: bool) -> str | None:
    """``away`` or ``talk`` for an element that never belongs to the article, else nothing."""
    if name in AWAY or (name == "header" and not inside):
        return "away"
    a = _attributes(raw)
    if not a or name in ("html", "body", "main"):
        return None
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return "away"
    if a.get("role") in AWAY_ROLES:
        return "away"
    if len(name) == 2 and name[0] == "h" and name[1].isdigit():
        return None
    # generators make the ids of an article's sections from its headings
    tokens = a.get("class", "").split() + ([] if inside and name == "section" else a.get("id", "").split())
    names = [set(_NAME.findall(t)) for t in tokens]
    if any(_says(x, TALK_NAMES) for x in names):
        return "talk"
    if name != "article" and any(_says(x, AWAY_NAMES) or (not inside and _says(x, TOP_NAMES)) for x in names):
        return "away"
    return None


def _says(words: set[str], wanted: frozenset[str]) -> bool:
    """Whether a class or id is one of the wanted words, alone or with words that only add a
    shape: ``related-posts`` but not ``related-work``."""
    return bool(words & wanted) and words <= wanted | AWAY_NAMES | SHAPE_NAMES


class _Line:
    __slots__ = ("text", "linked", "home", "heading")

    def __init__(self, text: str, linked: int, home: int, heading: bool):
        self.text, self.linked, self.home, self.heading = text, linked, home, heading


def page_lines(html: str) -> list[_Line]:
    """Lines of a page in order: text outside of markup, cut at block elements.

    ``linked`` counts characters of links, ``home`` numbers the article or main element around
    the line (0: none). Elements that are never article text leave an empty line.
    """
    out: list[_Line] = []
    parts: list[str] = []
    stack: list[str] = []
    homes: list[tuple[int, int]] = []  # depth and number of open article or main elements
    skip, why, linked, link, n_homes, heading = -1, "", 0, 0, 0, False

    def end_line() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        out.append(_Line(text, min(linked, len(text)), homes[-1][1] if homes else 0, heading))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if skip < 0 and text:
            parts.append(text)
            if link:
                linked += len(text.strip())

    def close_to(depth: int) -> None:
        nonlocal skip, link
        link -= sum(x == "a" for x in stack[depth:])
        del stack[depth:]
        while homes and homes[-1][0] >= depth:
            homes.pop()
        if skip >= depth:
            skip = -1

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3])
            continue
        raw = m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if name in BLOCK and skip < 0:
                end_line()
            if name in stack:
                close_to(len(stack) - 1 - stack[::-1].index(name))
                if name in BLOCK and skip < 0 and not parts and name[0] == "h" and name[1:].isdigit():
                    heading = False
            continue
        if name in RAW:
            if not raw.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if name in BLOCK and skip < 0:
            end_line()
        if name in CLOSES_P and "p" in stack:
            place = len(stack) - 1 - stack[::-1].index("p")
            if not any(x in ("article", "section", "div", "td", "li", "main") for x in stack[place:]):
                close_to(place)
        if name in VOID or raw.endswith("/"):
            continue
        kind = _kind(name, raw, bool(homes))
        if skip >= 0 and name in ("article", "main") and kind is None and why == "away" and stack[skip] in ("div", "span", "section", "ul", "nav", "header"):
            close_to(skip)  # an unclosed menu or notice ends where the article starts
        stack.append(name)
        if name == "a":
            link += 1
        heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if skip < 0:
            if kind:
                skip, why = len(stack) - 1, kind
                out.append(_Line("", 0, homes[-1][1] if homes else 0, False))
            elif name in ("article", "main") and not (name == "article" and homes and stack[homes[-1][0]] == "article"):
                n_homes += 1
                homes.append((len(stack) - 1, n_homes))
    if skip < 0:
        end_line()
    return out


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in order, joined by one line end; empty if none.

    The text length of each line, without links, is summed over sliding windows of lines; lines
    of an article or main element weigh more. Windows of at least a quarter of the heaviest one
    are surges. The text runs from the dive before the first surge to the dive behind the last
    one, with everything between, lines of links too. A dive is the edge of the windows without
    text; where the heaviest window lies in an article or main element, that element's edge.
    Headings right before a surge belong to it. No surge of another kind of place counts: if
    the heaviest window lies outside of such elements, those between are left out.
    """
    if not html:
        return ""
    lines = [x for x in page_lines(html) if x.text]
    chosen = distribution([_weight(x) for x in lines], [x.home for x in lines], [x.heading for x in lines])
    return "\n".join(lines[i].text for i in chosen)


def distribution(weight: list[int], home: list[int], heading: list[bool]) -> list[int]:
    """Numbers of the lines between the dives around the first and the last surge.

    ``weight`` is a line's text outside of links, ``home`` numbers its article or main element.
    """
    n = len(weight)

    def windows(of):
        return [sum(of[i:i + WINDOW]) for i in range(n)]

    lifted = [w * (HOME_WEIGHT if h else 1) for w, h in zip(weight, home)]
    sums = windows(lifted)
    peak = max(sums, default=0)
    if not peak:
        return []
    heaviest = [max(range(i, min(i + WINDOW, n)), key=lambda k: (lifted[k], -k)) for i in range(n)]
    surges = [i for i in range(n) if sums[i] >= max(peak * SURGE_SHARE, min(SURGE_CHARS, peak))]
    if home[heaviest[sums.index(peak)]]:
        homes = {home[heaviest[i]] for i in surges} - {0}
        return [k for k in range(n) if home[k] in homes]
    plain = windows([0 if h else w for w, h in zip(weight, home)])
    surges = [i for i in surges if not home[heaviest[i]]]
    start, stop = surges[0], surges[-1]
    while start and plain[start - 1]:
        start -= 1
    while stop < n and plain[stop]:
        stop += 1
    kept = [k for k in range(start, stop) if not home[k]]
    while kept and not weight[kept[0]] and not heading[kept[0]]:
        kept.pop(0)
    while kept and not weight[kept[-1]]:
        kept.pop()
    return kept


def _weight(line: _Line) -> int:
    """Characters outside of links, none for a line that is mostly link."""
    return 0 if 2 * line.linked > len(line.text) else len(line.text) - line.linked


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row; whole pages are read in batches.

    Null or empty html gives an empty text; null ids and addresses are carried along; repeated
    rows are extracted each; an empty table gives no rows.
    """
    schema = "page_id long, url string, text string, n_chars long"

    def extract(b):
        texts = [main_text(h.as_py()) for h in b.column("html")]
        yield arrow(schema, page_id=b.column("page_id"), url=b.column("url"), text=texts, n_chars=[len(t) for t in texts])

    return map_batches(clean(pages, page_id="long", url="string", html="string"), extract, schema)
